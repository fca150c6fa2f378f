"""Queries over lookups, scorers, story flags and prompt text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import dimensions
from touchline.catalog.registry import register
from touchline.catalog import shot_queries  # noqa: F401  (its SQL blocks are used here)
from touchline.catalog.feed import Feed
from touchline.catalog.views import BLOCKS, FOCUS, SEASON, player_name, raw_results, sql, table, v_match, v_season
from touchline.functions.numbers import safe_int
from touchline.functions.names import fold_accents, initials, surname
from touchline.operators import briefs, enrich, lookup, prompts, scorers, shots
from touchline.operators.joins import attach
from touchline.operators.results import score_line

# --- dimensions made of the users of the events ----------------------------


BLOCKS["stats_dim"] = ([], """
  SELECT CAST(user_id + 1 AS INTEGER) AS ord,
         'First' || (user_id % 7) || CASE WHEN user_id % 3 = 0 THEN ' Middle Last' ELSE ' Last' END || user_id AS name,
         CAST(user_id % 15 AS INTEGER) AS goals, CAST(user_id % 9 AS INTEGER) AS assists, CAST(user_id % 34 AS INTEGER) AS apps,
         CAST(user_id % 40 AS DOUBLE) / 4 AS xg,
         CASE WHEN user_id % 10 = 0 THEN 'top scorer' ELSE 'note ' || (user_id % 4) END AS note
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 < 2""")
BLOCKS["names"] = (["ev"], "SELECT DISTINCT player FROM ev WHERE player IS NOT NULL")
BLOCKS["stats"] = (["stats_dim", "names"], """
  SELECT n.player, d.name AS stats_name, d.goals, d.assists, d.apps, d.xg, d.note
  FROM (SELECT player, coalesce(
          (SELECT min(ord) FROM stats_dim WHERE name = player),
          (SELECT min(ord) FROM stats_dim WHERE contains(lower(name), lower(split_part(player, ' ', 2))))) AS ord
        FROM names) n LEFT JOIN stats_dim d ON d.ord = n.ord""")
BLOCKS["cry_dim"] = ([], """
  SELECT CAST(user_id + 1 AS INTEGER) AS ord,
         CASE user_id % 4 WHEN 0 THEN 'Last' || user_id WHEN 1 THEN 'Dr First' || (user_id % 7) || ' Last' || user_id || ' Junior'
              ELSE 'First' || (user_id % 7) || ' Last' || user_id END AS name,
         'GOL ' || (user_id % 5) AS cry,
         CASE user_id % 6 WHEN 0 THEN 'German' WHEN 1 THEN 'French' WHEN 2 THEN 'Spanish' ELSE 'Dutch' END AS language,
         'flag' AS flag
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 < 3 AND user_id % 5 > 0""")
BLOCKS["cries"] = (["cry_dim", "names"], """
  SELECT n.player, coalesce(d.cry, 'GOAAAAAL!') AS goal_cry, coalesce(d.language, 'English') AS goal_language,
         coalesce(d.flag, '🌍') AS goal_flag
  FROM (SELECT player, coalesce(
          (SELECT min(ord) FROM cry_dim WHERE name = player),
          (SELECT min(ord) FROM cry_dim WHERE contains(lower(name), lower(player)) OR contains(lower(player), lower(name)))) AS ord
        FROM names) n LEFT JOIN cry_dim d ON d.ord = n.ord""")


@register(sql("SELECT * FROM stats", "stats"))
def season_stats_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Season statistics by exact name, else by surname."""
    return Feed(spark, sf).stats


@register(sql("SELECT * FROM cries", "cries"))
def goal_cry_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Goal cry by exact name, else by containment either way, else the default."""
    return Feed(spark, sf).cries


@register(sql(
    """SELECT player, lower(split_part(player, ' ', 2)) AS last_name,
       translate(player, 'áéíóúüöäñ', 'aeiouuoan') AS folded FROM names""", "names",
))
def surnames(spark: SparkSession, sf: str) -> DataFrame:
    """Surname and accent-free form of every player name."""
    player = F.col("player")
    return Feed(spark, sf).player_names.select(
        "player", surname(player).alias("last_name"), fold_accents(player).alias("folded")
    )


@register("""
    SELECT n_name AS team, coalesce(background, '#d20515') AS background, coalesce(foreground, '#ffffff') AS foreground,
           upper(left(replace(replace(n_name, '''', ''), '.', ''), 3)) AS initials
    FROM nation LEFT JOIN (SELECT n_name AS team, '#00000' || n_regionkey AS background, '#fffff' || n_regionkey AS foreground
                           FROM nation WHERE n_nationkey % 4 > 0) c ON c.team = n_name""")
def team_badges(spark: SparkSession, sf: str) -> DataFrame:
    """Colours with a default, and initials, of every team."""
    nation = table(spark, sf, "nation")
    region = F.col("n_regionkey").cast("string")
    colours = nation.filter(F.col("n_nationkey") % 4 > 0).select(
        F.col("n_name").alias("team"),
        F.concat(F.lit("#00000"), region).alias("background"),
        F.concat(F.lit("#fffff"), region).alias("foreground"),
    )
    background, foreground = dimensions.DEFAULT_COLOURS
    teams = nation.select(F.col("n_name").alias("team"))
    coloured = lookup.with_default(
        teams, colours, "team", {"background": background, "foreground": foreground}
    )
    return coloured.withColumn("initials", initials(F.col("team")))


# --- pairs -----------------------------------------------------------------

BLOCKS["xg"] = (["fixtures"], """
  SELECT f.match_id, f.home_team, f.away_team, f.home_fd, f.away_fd,
         CAST(round(coalesce(sum(CAST(e.shot_xg AS DECIMAL(18,6))) FILTER (e.team = f.home_team), 0), 3) AS DOUBLE) AS home_xg,
         CAST(round(coalesce(sum(CAST(e.shot_xg AS DECIMAL(18,6))) FILTER (e.team = f.away_team), 0), 3) AS DOUBLE) AS away_xg
  FROM fixtures f LEFT JOIN ev e ON e.match_id = f.match_id AND e.type = 'Shot' GROUP BY ALL""")
BLOCKS["pair_xg"] = (["xg", "v_match"], """
  SELECT m.match_id, m.season, m.match_date, m.home_team AS home_fd, m.away_team AS away_fd, m.home_goals, m.away_goals,
         CASE WHEN x.match_id IS NOT NULL THEN x.home_xg ELSE r.away_xg END AS home_xg,
         CASE WHEN x.match_id IS NOT NULL THEN x.away_xg ELSE r.home_xg END AS away_xg
  FROM v_match m
  LEFT JOIN xg x ON x.home_team = m.home_team AND x.away_team = m.away_team
  LEFT JOIN xg r ON r.home_team = m.away_team AND r.away_team = m.home_team""")


def pair_xg_of(spark: SparkSession, sf: str) -> DataFrame:
    feed = Feed(spark, sf)
    xg = shots.match_xg(feed.events, feed.feed_named)
    per_pair = lookup.latest_per_pair(xg, ["home_xg", "away_xg"], "match_id")
    results = v_match(spark, sf).withColumnsRenamed({"home_team": "home_fd", "away_team": "away_fd"})
    return lookup.pair_values(results, per_pair, "home_xg", "away_xg", ["match_id"])


@register(sql("SELECT match_id, home_fd, away_fd, home_xg, away_xg FROM pair_xg", "pair_xg"))
def xg_pair_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """xG of results by exact pair, else turned round from the reverse pair."""
    return pair_xg_of(spark, sf).select("match_id", "home_fd", "away_fd", "home_xg", "away_xg")


@register(sql(
    """SELECT x.match_id, CASE WHEN x.home_fd = 'NATION_3' AND x.home_xg IS NOT NULL AND x.away_xg IS NOT NULL
       THEN CAST(CAST(round(CAST(x.home_xg AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS VARCHAR) || ' xG '
            || CAST(CAST(round(CAST(x.away_xg AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS VARCHAR)
       ELSE 'HT ' || CASE WHEN match_id % 17 = 3 OR match_id % 19 = 3 OR match_id % 23 = 3 THEN 0 ELSE match_id * 3 % 7 END
         || ' – ' || CASE WHEN match_id % 17 = 4 OR match_id % 19 = 4 OR match_id % 23 = 4 THEN 0 ELSE match_id * 4 % 8 END END AS score_line
       FROM pair_xg x""", "pair_xg",
))
def score_lines(spark: SparkSession, sf: str) -> DataFrame:
    """xG line of the focus team's matches, half-time line of the others."""
    half = raw_results(spark, sf).select(
        "match_id", safe_int(F.col("HTHG").try_cast("double")).alias("_hh"), safe_int(F.col("HTAG").try_cast("double")).alias("_ha"),
    )
    line = score_line(F.col("home_fd") == "NATION_3", F.col("home_xg"), F.col("away_xg"), F.col("_hh"), F.col("_ha"))
    return pair_xg_of(spark, sf).join(half, "match_id").select("match_id", line.alias("score_line"))


@register(sql(
    """SELECT f.match_id, CAST(coalesce(a.round, b.round, 0) AS INTEGER) AS match_round FROM fixtures f
       LEFT JOIN (SELECT home_team, away_team, arg_max(round, match_id) AS round FROM v_season GROUP BY ALL) a
         ON a.home_team = f.home_team AND a.away_team = f.away_team
       LEFT JOIN (SELECT home_team, away_team, arg_max(round, match_id) AS round FROM v_season GROUP BY ALL) b
         ON b.home_team = f.away_team AND b.away_team = f.home_team""", "fixtures", "v_season",
))
def round_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Round of a match by pair in the results, the last meeting counts; 0 without one."""
    feed = Feed(spark, sf)
    named = v_season(spark, sf).withColumnsRenamed({"home_team": "home_fd", "away_team": "away_fd"})
    per_pair = lookup.latest_per_pair(named, ["round"], "match_id")
    asked = feed.feed_named.drop("match_round")
    return lookup.pair_round(asked, per_pair, ["match_id"]).select("match_id", "match_round")


@register(sql(
    """SELECT w.home_team AS want_home, w.away_team AS want_away, k.match_id, k.index, k.event_type, k.minute
       FROM (SELECT DISTINCT home_team, away_team FROM v_match) w
       JOIN (SELECT e.*, f.home_team, f.away_team FROM keyev e JOIN fixtures f USING (match_id)) k
         ON (k.home_team = w.home_team AND k.away_team = w.away_team)
         OR (k.home_team = w.away_team AND k.away_team = w.home_team
             AND NOT EXISTS (SELECT 1 FROM keyev e JOIN fixtures f USING (match_id)
                             WHERE f.home_team = w.home_team AND f.away_team = w.away_team))""",
    "keyev", "v_match",
))
def rows_of_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Key events of wanted pairs: exact order first, the reverse only without it."""
    feed = Feed(spark, sf)
    events = shots.key_events(feed.events, feed.feed_named)
    wanted = v_match(spark, sf).select(
        F.col("home_team").alias("home_fd"), F.col("away_team").alias("away_fd")
    ).distinct()
    found = lookup.rows_of_pairs(events, wanted, ["index"])
    return found.select("want_home", "want_away", "match_id", "index", "event_type", "minute")


@register(sql(
    """SELECT match_id FROM fixtures f WHERE EXISTS (SELECT 1 FROM v_match m WHERE m.home_goals = f.match_round % 5
       AND ((m.home_team = f.home_team AND m.away_team = f.away_team) OR (m.home_team = f.away_team AND m.away_team = f.home_team)))""",
    "fixtures", "v_match",
))
def either_orientation(spark: SparkSession, sf: str) -> DataFrame:
    """Matches whose pair met in the results, in either order, with a given number of home goals."""
    met = v_match(spark, sf).select(
        F.col("home_team").alias("_h"), F.col("away_team").alias("_a"), "home_goals"
    ).distinct()
    pair = lookup.same_pair([F.col("home_fd"), F.col("away_fd")], [F.col("_h"), F.col("_a")])
    wanted = pair & (F.col("match_round") % 5 == F.col("home_goals"))
    return Feed(spark, sf).feed_named.join(met, wanted, "left_semi").select("match_id")


@register(sql(
    "SELECT match_id, home_fd, away_fd FROM fixtures WHERE match_id IN (SELECT match_id FROM keyev WHERE event_type = 'red_card')",
    "fixtures", "keyev",
))
def matches_with_content(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that have a dismissal."""
    feed = Feed(spark, sf)
    found = lookup.with_content(feed.fixtures, feed.reds, ["match_id"])
    return found.select("match_id", "home_fd", "away_fd")


# --- scorers ---------------------------------------------------------------

BLOCKS["scorer_list"] = ([], """
  SELECT 2024 AS season, CAST(user_id + 1 AS INTEGER) AS ord, 'First' || (user_id % 7) || ' Last' || user_id AS name,
         'Team ' || (user_id % 5) AS team, CAST(user_id % 15 AS INTEGER) AS goals
  FROM (SELECT DISTINCT user_id FROM events)""")
BLOCKS["estimates"] = (["scorer_list", "fixtures"], """
  SELECT * FROM (
    SELECT s.season, r.round, s.ord, s.name, s.team,
           CAST(greatest(round_even(s.goals * (CAST(r.round AS DOUBLE) / (SELECT max(match_round) FROM fixtures)), 0), 0) AS BIGINT) AS estimate
    FROM scorer_list s CROSS JOIN (SELECT DISTINCT match_round AS round FROM fixtures) r)
  WHERE estimate > 0 OR round >= 5""")
BLOCKS["goal_rows"] = (["shots"], """
  SELECT s.season, s.round, s.player, s.index FROM (
    SELECT 2024 AS season, f.match_round AS round, s.player, s.index FROM shots s JOIN fixtures f USING (match_id)
    WHERE s.is_goal = 1 AND s.team_fd = 'Team 3' AND s.player IS NOT NULL) s""")
BLOCKS["actual"] = (["goal_rows"], """
  SELECT r.season, r.round, g.player, count(*) AS goals, min(g.index) AS seen_at
  FROM (SELECT DISTINCT 2024 AS season, match_round AS round FROM fixtures) r JOIN goal_rows g ON g.round <= r.round
  GROUP BY r.season, r.round, g.player""")
BLOCKS["overridden"] = (["estimates", "actual"], """
  SELECT e.season, e.round, e.ord, e.name, e.team, e.estimate, coalesce(h.goals, e.estimate) AS goals,
         h.goals IS NOT NULL AS is_counted
  FROM estimates e LEFT JOIN (
    SELECT e.round, e.name, arg_min(a.goals, a.seen_at) AS goals FROM estimates e
    JOIN actual a ON a.round = e.round AND contains(lower(e.name), lower(split_part(a.player, ' ', 2)))
    WHERE e.team = 'Team 3' GROUP BY e.round, e.name) h ON h.round = e.round AND h.name = e.name AND e.team = 'Team 3'""")


def last_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return Feed(spark, sf).fixtures.groupBy("season").agg(F.max("match_round").alias("last_round"))


def scorer_list(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    active = table(spark, sf, "events").select("user_id", F.year("ts").alias("season")).distinct()
    return active.select(
        "season",
        (u + 1).cast("int").alias("ord"),
        player_name(u).alias("name"),
        F.concat(F.lit("Team "), (u % 5).cast("string")).alias("team"),
        (u % 15).cast("int").alias("goals"),
    )


def estimates_of(spark: SparkSession, sf: str) -> DataFrame:
    return scorers.estimated(scorer_list(spark, sf), last_rounds(spark, sf), SEASON)


def actual_of(spark: SparkSession, sf: str) -> DataFrame:
    feed = Feed(spark, sf)
    rounds = feed.fixtures.select("match_id", "season", F.col("match_round").alias("round"))
    goals = feed.key_events.filter((F.col("event_type") == "goal") & (F.col("team_fd") == FOCUS))
    placed = attach(goals, rounds, ["match_id"], ["index"], "inner").withColumn("seen_at", F.col("index"))
    return scorers.actual(placed.select("season", "round", "player", "seen_at"), SEASON, last_rounds(spark, sf))


def overridden_of(spark: SparkSession, sf: str) -> DataFrame:
    return scorers.override(estimates_of(spark, sf), actual_of(spark, sf), SEASON, FOCUS)


@register(sql("SELECT * FROM estimates", "estimates"))
def scorer_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Season goals spread over the rounds."""
    return estimates_of(spark, sf)


@register(sql("SELECT * FROM actual", "actual"))
def scorer_actual(spark: SparkSession, sf: str) -> DataFrame:
    """Counted goals of the focus team's players up to every round."""
    return actual_of(spark, sf)


@register(sql("SELECT * FROM overridden", "overridden"))
def scorer_override(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates replaced by counted goals of the focus team."""
    return overridden_of(spark, sf)


@register(sql(
    """SELECT season, round, rank, name, team, goals FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY season, round ORDER BY goals DESC, ord) AS INTEGER) AS rank
         FROM overridden WHERE goals > 0) WHERE rank <= 20""", "overridden",
))
def top_scorers(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty best scorers after every round."""
    able = scorers.contenders(scorer_list(spark, sf), SEASON, FOCUS)
    estimates = scorers.estimated(able, last_rounds(spark, sf), SEASON)
    return scorers.top_scorers(scorers.override(estimates, actual_of(spark, sf), SEASON, FOCUS), SEASON)


# --- briefs ----------------------------------------------------------------

BLOCKS["sides"] = (["fixtures"], """
  SELECT match_id, home_fd AS focus, away_fd AS opponent, true AS focus_home, home_fd, away_fd, match_round FROM fixtures
  UNION ALL SELECT match_id, away_fd, home_fd, false, home_fd, away_fd, match_round FROM fixtures""")
BLOCKS["totals"] = (["sides", "shots"], """
  SELECT s.*, CAST(coalesce(CASE WHEN s.focus_home THEN t.h ELSE t.a END, 0) AS INTEGER) AS goals_for,
         CAST(coalesce(CASE WHEN s.focus_home THEN t.a ELSE t.h END, 0) AS INTEGER) AS goals_against,
         coalesce(t.late, false) AS late_drama, coalesce(t.early, false) AS early_goal
  FROM sides s LEFT JOIN (
    SELECT match_id, count(*) FILTER (is_goal = 1 AND team_fd = home_fd) AS h,
           count(*) FILTER (is_goal = 1 AND team_fd <> home_fd) AS a,
           bool_or(is_goal = 1 AND minute > 85) AS late, bool_or(is_goal = 1 AND minute < 15) AS early
    FROM shots GROUP BY match_id) t ON t.match_id = s.match_id""")
BLOCKS["briefs"] = (["totals", "keyev", "xg"], """
  SELECT match_id, focus, opponent, focus_home, home_fd, away_fd, match_round, goals_for, goals_against,
         CAST(round(CAST(own_xg AS DECIMAL(28,6)), 2) AS DOUBLE) AS xg_for,
         CAST(round(CAST(other_xg AS DECIMAL(28,6)), 2) AS DOUBLE) AS xg_against,
         d > 0 AS won, d = 0 AS drew, d < 0 AS lost, d >= 4 AS easy_win, d >= 5 AS ran_riot,
         t <= 3 AND abs(d) = 1 AS tight_game, t >= 5 AND abs(d) = 1 AS action_packed, d = 0 AND t >= 4 AS entertaining_draw,
         match_round = (SELECT max(match_round) FROM fixtures) AS final_round, match_round = 29 AS title_round,
         coalesce(own_xg < CAST(0.3 AS DOUBLE), false) AS few_chances, coalesce(own_xg > other_xg * 2, false) AS dominant_xg,
         red_minute IS NOT NULL AS has_red_card, red_card_team, red_minute, late_drama, early_goal, unbeaten, champion
  FROM (SELECT b.*, s.losses = 0 AS unbeaten, s.place = 1 AS champion, goals_for - goals_against AS d, goals_for + goals_against AS t,
               CASE WHEN focus_home THEN x.home_xg ELSE x.away_xg END AS own_xg,
               CASE WHEN focus_home THEN x.away_xg ELSE x.home_xg END AS other_xg,
               r.team AS red_card_team, r.minute AS red_minute
        FROM totals b LEFT JOIN xg x ON x.match_id = b.match_id
        JOIN (SELECT focus, count(*) FILTER (goals_for < goals_against) AS losses, row_number() OVER (ORDER BY
                sum(CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) DESC,
                sum(goals_for - goals_against) DESC, sum(goals_for) DESC, focus) AS place
              FROM totals GROUP BY focus) s ON s.focus = b.focus
        LEFT JOIN (SELECT match_id, arg_min(team_fd, index) AS team, arg_min(minute, index) AS minute FROM keyev
                   WHERE event_type = 'red_card' GROUP BY match_id) r ON r.match_id = b.match_id)""")
BLOCKS["scorers"] = (["shots"], """
  SELECT match_id, team_fd, player, count(*) AS goals, arg_min(minute, CAST(minute AS BIGINT) * 1000000000 + index) AS first_minute,
         min(CAST(minute AS BIGINT) * 1000000000 + index) AS first_at
  FROM shots WHERE is_goal = 1 AND player IS NOT NULL GROUP BY match_id, team_fd, player""")
BLOCKS["lists"] = (["scorers"], """
  SELECT match_id, team_fd AS focus, list(player ORDER BY first_at) AS scorers,
         coalesce(list(player ORDER BY player) FILTER (goals >= 2), []) AS brace_scorers,
         coalesce(list(player ORDER BY player) FILTER (goals >= 3), []) AS hattricks
  FROM scorers GROUP BY match_id, team_fd""")
@register(sql("SELECT match_id, home_fd, away_fd, focus, opponent, focus_home FROM sides", "sides"))
def match_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Every match seen from both sides."""
    return briefs.sides(Feed(spark, sf).fixtures)


@register(sql(
    """SELECT match_id, focus, opponent, focus_home, home_fd, away_fd, goals_for, goals_against, late_drama, early_goal
       FROM totals""", "totals",
))
def match_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Goals for and against and goal-time flags per match and side."""
    feed = Feed(spark, sf)
    return briefs.match_totals(feed.shots_once, feed.fixtures)


@register(sql("SELECT * FROM briefs", "briefs"))
def match_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Story flags per match and side."""
    return Feed(spark, sf).briefs_once


@register(sql("SELECT * FROM briefs WHERE focus = 'Team 3'", "briefs"))
def match_flags_of_team(spark: SparkSession, sf: str) -> DataFrame:
    """Story flags of one team's matches."""
    return Feed(spark, sf, FOCUS).briefs_once


@register(sql(
    "SELECT match_id, team_fd, player, goals, first_minute, goals >= 2 AS is_brace, goals >= 3 AS is_hattrick FROM scorers",
    "scorers",
))
def brace_hattrick(spark: SparkSession, sf: str) -> DataFrame:
    """Goals per scorer of a match, braces and hat-tricks marked."""
    found = briefs.scorers_of_match(Feed(spark, sf).shots_once)
    return found.withColumn("first_minute", F.col("first_at.minute")).drop("first_at")


@register(sql(
    """SELECT match_id, focus, array_to_string(scorers, ', ') AS scorers, array_to_string(brace_scorers, ', ') AS brace_scorers,
       array_to_string(hattricks, ', ') AS hattricks FROM lists""", "lists",
))
def scorer_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Scorers, brace and hat-trick players of a side as lists."""
    lists = briefs.scorer_lists(briefs.scorers_of_match(Feed(spark, sf).shots_once))
    return lists.select("match_id", "focus", *[
        F.array_join(c, ", ").alias(c) for c in ("scorers", "brace_scorers", "hattricks")
    ])


@register(sql(
    """SELECT s.match_id, s.team_fd AS focus, s.player, t.goals, t.assists, t.apps, t.xg, t.note FROM scorers s JOIN stats t USING (player)
       WHERE t.stats_name IS NOT NULL""", "scorers", "stats",
))
def scorer_context(spark: SparkSession, sf: str) -> DataFrame:
    """Season statistics of the scorers of a side."""
    feed = Feed(spark, sf)
    context = briefs.scorer_context(briefs.scorers_of_match(feed.shots_once), feed.stats)
    listed = context.select("match_id", "focus", F.explode("scorer_context").alias("player", "_s"))
    return listed.select("match_id", "focus", "player", "_s.*")


BLOCKS["numbered"] = (["seq"], """
  SELECT *, CAST(CASE WHEN is_goal = 1 THEN sum(coalesce(is_goal, 0)) OVER (
            PARTITION BY match_id, team_fd, coalesce(player, '') ORDER BY minute, kind, index ROWS UNBOUNDED PRECEDING)
            ELSE 1 END AS INTEGER) AS goal_number FROM seq""")
BLOCKS["hb"] = (["numbered", "briefs", "scorers", "stats"], """
  SELECT match_id, focus, highlight_idx, item_type, index, player, team_fd, minute, opponent, focus_home, goals_for,
         goals_against, own AS own_score, other AS other_score, score_after, score_at, xg, outcome, x, y,
         goal AS is_goal, goal AND mine AS is_own_goal_for, goal AND NOT mine AS is_goal_against,
         goal AND mine AND own = 1 AND other = 0 AND minute < 15 AS is_opener,
         goal AND mine AND own = other AS is_equaliser, goal AND mine AND own = other + 1 AS is_go_ahead,
         goal AND NOT mine AND other < own AS is_consolation, goal AND NOT mine AND other = own AS opp_equaliser,
         goal AND NOT mine AND other > own AS opp_takes_lead,
         goal AND mine AND own = goals_for AND other = goals_against AS is_winner,
         goal AND xg < CAST(0.08 AS DOUBLE) AS is_low_xg_goal, goal AND xg > CAST(0.5 AS DOUBLE) AS is_high_xg_goal,
         goal AND xg < CAST(0.05 AS DOUBLE) AS is_screamer, shot AND minute > 85 AS late_drama,
         shot AND mine AND mg = 2 AND goal_number = 2 AS brace,
         shot AND mine AND mg >= 3 AND goal_number = 3 AS hattrick_complete,
         shot AND mine AND mg >= 3 AND goal_number > 3 AS hattrick_extend,
         shot AND coalesce(note = 'top scorer', false) AS is_top_scorer, shot AND coalesce(sg >= 5, false) AS is_key_player,
         NOT shot AND minute < 40 AS early_red, NOT shot AND NOT mine AS is_opponent_red,
         CASE WHEN shot THEN sg END AS season_goals, CASE WHEN shot THEN apps END AS season_apps,
         CASE WHEN shot THEN note END AS player_note
  FROM (SELECT q.*, b.focus, b.opponent, b.focus_home, b.goals_for, b.goals_against, q.item_type = 'shot' AS shot,
               coalesce(q.is_goal = 1, false) AS goal, q.team_fd = b.focus AS mine, coalesce(c.goals, 0) AS mg,
               CASE WHEN b.focus_home THEN q.home_score ELSE q.away_score END AS own,
               CASE WHEN b.focus_home THEN q.away_score ELSE q.home_score END AS other,
               t.goals AS sg, t.apps, t.note
        FROM (SELECT * EXCLUDE (x, y), CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM numbered) q
        JOIN briefs b ON b.match_id = q.match_id
        LEFT JOIN scorers c ON c.match_id = q.match_id AND c.team_fd = q.team_fd AND c.player = q.player
        LEFT JOIN stats t ON t.player = q.player)""")


@register(sql("SELECT match_id, highlight_idx, player, is_goal, goal_number FROM numbered", "numbered"))
def goal_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """How many goals of the player a highlight makes."""
    columns = ["match_id", "highlight_idx", "player", "is_goal", "goal_number"]
    return briefs.goal_numbers(Feed(spark, sf).sequence).select(*columns)


@register(sql("SELECT * FROM hb", "hb"))
def highlight_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Story flags of every highlight, per side."""
    return Feed(spark, sf).highlight_briefs


# --- text ------------------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_fill(template: str, **named: str) -> str:
    """SQL for ``prompts.fill``."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            parts.append(f"coalesce(CAST({named.get(piece[1:-1], piece[1:-1])} AS VARCHAR), '')")
        elif piece:
            parts.append(sql_text(piece))
    return "(" + " || ".join(parts) + ")"


def sql_list(entries: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in entries)
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


# The phrases are written out, so that the SQL does not share them with the code.
_HOOK_LIST = sql_list([
    ("final_round AND unbeaten", sql_fill("This completes a whole season unbeaten for {focus}")),
    ("final_round AND champion", sql_fill("{focus} finish the season as champions")),
    ("title_round AND champion AND goals_for > goals_against",
     sql_fill("A win in the title run-in for {focus}, champions in the end")),
    ("goals_for - goals_against >= 5", sql_fill("{focus} ran riot, winning {goals_for}-{goals_against}")),
    ("goals_for - goals_against = 1 AND goals_for + goals_against <= 3",
     sql_fill("A tight {goals_for}-{goals_against} win — {focus} had to dig deep")),
    ("goals_against - goals_for = 1 AND goals_for + goals_against <= 3",
     sql_fill("A tight {goals_for}-{goals_against} defeat — {focus} fell just short")),
    ("red_minute IS NOT NULL", sql_fill("{red_card_team} reduced to ten men")),
    ("len(hattricks) > 0", sql_fill("{first} completed a hat-trick", first="hattricks[1]")),
    ("coalesce(len(hattricks), 0) = 0 AND len(brace_scorers) > 0",
     sql_fill("{first} bagged a brace", first="brace_scorers[1]")),
    ("len(scorers) > 0", sql_fill(
        "goals from {names}",
        names="array_to_string(list_transform(scorers[1:3], lambda s: split_part(s, ' ', 2)), ', ')")),
])
BLOCKS["hooked"] = (["briefs", "lists"], f"""
  SELECT * EXCLUDE (found), CASE WHEN len(found) = 0 THEN {sql_fill("{focus} {goals_for}-{goals_against} {opponent}")}
         ELSE array_to_string(found[1:4], '; ') END AS hooks
  FROM (SELECT b.*, l.scorers, l.brace_scorers, l.hattricks, {_HOOK_LIST} AS found
        FROM briefs b LEFT JOIN lists l USING (match_id, focus))""")


@register(sql("SELECT match_id, focus, hooks FROM hooked", "hooked"))
def story_hooks(spark: SparkSession, sf: str) -> DataFrame:
    """Story hooks per match and side."""
    feed = Feed(spark, sf)
    return prompts.hooks(feed.briefs_once, feed.hook_players).select("match_id", "focus", "hooks")


_MATCH_LABELS = [
    ("goals_for - goals_against >= 5", "Ran riot — won by 5+"),
    ("goals_for - goals_against >= 4", "Easy win — won by 4+"),
    ("goals_for + goals_against >= 5 AND abs(goals_for - goals_against) = 1", "Action-packed — 5+ goals, tight margin"),
    ("goals_for + goals_against <= 3 AND abs(goals_for - goals_against) = 1", "Tight game — few goals, 1-goal margin"),
    ("goals_for = goals_against AND goals_for >= 2", "Entertaining draw — 4+ goals"),
    ("goals_for = goals_against AND goals_for < 2", "Goalless or tight draw"),
    ("final_round", "Final matchday"),
    ("final_round AND unbeaten", "Unbeaten all season"),
    ("final_round AND champion", "Champions"),
    ("title_round AND champion AND goals_for > goals_against", "Title run-in of the later champions"),
    ("late_drama", "Late drama — goal after 85'"),
    ("early_goal", "Early goal — before 15'"),
    ("red_minute IS NOT NULL", "Red card — {red_card_team} (min {red_minute})"),
    ("few_chances", "Very few chances — xG only {xg_for}"),
    ("dominant_xg", "Dominated xG: {xg_for} vs {xg_against}"),
    ("len(hattricks) > 0", "Hat-trick — {three}"),
    ("coalesce(len(hattricks), 0) = 0 AND len(brace_scorers) > 0", "Brace — {two}"),
]


@register(sql(
    "SELECT match_id, focus, array_to_string(" + sql_list([
        (c, sql_fill(t, three="hattricks[1]", two="brace_scorers[1]")) for c, t in _MATCH_LABELS
    ]) + ", ' · ') AS labels FROM hooked", "hooked",
))
def match_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a brief for review."""
    feed = Feed(spark, sf)
    return prompts.match_labels(feed.briefs_once, feed.hook_players)


@register(sql(
    "SELECT match_id, focus, highlight_idx, array_to_string(" + sql_list([
        (n, sql_fill(t)) for n, t in prompts.HIGHLIGHT_LABELS
    ]) + ", ' · ') AS labels FROM hb", "hb",
))
def highlight_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of every highlight for review."""
    return prompts.highlight_labels(Feed(spark, sf).highlight_briefs)


_BRIEF = [
    "match_id", "focus", "opponent", "focus_home", "home_fd", "away_fd", "match_round", "goals_for", "goals_against",
    "xg_for", "xg_against", "won", "drew", "lost", "easy_win", "ran_riot", "tight_game", "action_packed",
    "entertaining_draw", "final_round", "title_round", "few_chances", "dominant_xg", "has_red_card", "red_card_team",
    "red_minute", "late_drama", "early_goal", "unbeaten", "champion",
]
_LISTS = ["scorers", "brace_scorers", "hattricks"]
_HIGHLIGHT = [
    "match_id", "focus", "highlight_idx", "item_type", "index", "player", "team_fd", "minute", "opponent", "focus_home",
    "goals_for", "goals_against", "own_score", "other_score", "score_after", "score_at", "xg", "outcome", "x", "y",
    "is_goal", "is_own_goal_for", "is_goal_against", "is_opener", "is_equaliser", "is_go_ahead", "is_consolation",
    "opp_equaliser", "opp_takes_lead", "is_winner", "is_low_xg_goal", "is_high_xg_goal", "is_screamer", "late_drama",
    "brace", "hattrick_complete", "hattrick_extend", "is_top_scorer", "is_key_player", "early_red", "is_opponent_red",
    "season_goals", "season_apps", "player_note",
]


def _packed(columns: list[str]) -> str:
    return "CAST(to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in columns) + ")) AS VARCHAR) AS brief"


@register(sql(f"SELECT match_id, focus, {_packed([*_BRIEF, *_LISTS])} FROM hooked", "hooked"))
def brief_json(spark: SparkSession, sf: str) -> DataFrame:
    """Whole briefs of matches as JSON."""
    feed = Feed(spark, sf)
    return prompts.brief_json(feed.briefs_once.select(*_BRIEF), feed.scorer_lists.select("match_id", "focus", *_LISTS))


@register(sql(f"SELECT match_id, focus, highlight_idx, {_packed(_HIGHLIGHT)} FROM hb", "hb"))
def highlight_json(spark: SparkSession, sf: str) -> DataFrame:
    """Whole briefs of highlights as JSON."""
    return prompts.highlight_json(Feed(spark, sf).highlight_briefs.select(*_HIGHLIGHT))


_ORDINAL = """minute || CASE WHEN minute % 100 BETWEEN 11 AND 13 THEN 'th' WHEN minute % 10 = 1 THEN 'st'
  WHEN minute % 10 = 2 THEN 'nd' WHEN minute % 10 = 3 THEN 'rd' ELSE 'th' END"""
_FINAL = "{goals_for}-{goals_against}"


def _outcome(won: str, drew: str, lost: str) -> str:
    return (f"CASE WHEN goals_for > goals_against THEN {sql_fill(won)} "
            f"WHEN goals_for = goals_against THEN {sql_fill(drew)} ELSE {sql_fill(lost)} END")


_PULLED = f"{{opponent}} pull one back, making it {{score_after}} — it ends {_FINAL}"
_MOMENT = f"""CASE
  WHEN is_own_goal_for THEN CASE
    WHEN own_score = 1 AND other_score = 0 THEN {sql_fill("opening goal — {focus} take the lead")}
    WHEN own_score > other_score + 1 THEN {sql_fill("making it {score_after} — {focus} in command")}
    WHEN own_score = other_score + 1 AND own_score = goals_for AND other_score = goals_against
      THEN {sql_fill(f"the winner — final score will be {_FINAL}")}
    WHEN own_score = other_score + 1 THEN {sql_fill("{focus} go ahead, score now {score_after}")}
    ELSE {sql_fill("goal for {focus}, score now {score_after}")} END
  WHEN is_goal_against THEN CASE
    WHEN other_score > own_score THEN {_outcome(
        f"{{opponent}} take the lead — but {{focus}} recover to win {_FINAL}",
        f"{{opponent}} take the lead — but {{focus}} recover to draw {_FINAL}",
        f"{{opponent}} lead {{score_after}} — {{focus}} lose {_FINAL}")}
    WHEN other_score = own_score THEN {_outcome(
        f"{{opponent}} equalise — but {{focus}} go on to win {_FINAL}",
        f"{{opponent}} equalise — it ends {_FINAL}",
        f"{{opponent}} equalise — {{focus}} go on to lose {_FINAL}")}
    ELSE {_outcome(
        f"consolation for {{opponent}}, making it {{score_after}} — {{focus}} win {_FINAL}", _PULLED, _PULLED)} END
  ELSE {sql_fill("chance for {team_fd}, score {score_after}")} END"""
_BEFORE_OWN = "own_score - CASE WHEN is_own_goal_for THEN 1 ELSE 0 END"
_BEFORE_OTHER = "other_score - CASE WHEN is_goal_against THEN 1 ELSE 0 END"
_INSIDE = "coalesce(nullif(x, 0.0), 90.0) > 84"
_QUALITY = " ".join(
    f"WHEN xg > CAST({least} AS DOUBLE) THEN CASE WHEN {_INSIDE} THEN {sql_text(a)} ELSE {sql_text(b)} END"
    for least, a, b in prompts.SHOT_QUALITY
)
_LEAST_IN, _LEAST_OUT = prompts.SHOT_QUALITY_LEAST
BLOCKS["texts"] = (["hb"], f"""
  SELECT *, {_ORDINAL} AS minute_text,
    CASE WHEN item_type = 'shot' THEN CASE WHEN focus_home THEN ({_BEFORE_OWN}) || '-' || ({_BEFORE_OTHER})
      ELSE ({_BEFORE_OTHER}) || '-' || ({_BEFORE_OWN}) END END AS score_before,
    CASE WHEN item_type = 'shot' THEN {_MOMENT} END AS moment,
    CASE WHEN item_type = 'shot' THEN CASE {_QUALITY} WHEN {_INSIDE} THEN {sql_text(_LEAST_IN)}
      ELSE {sql_text(_LEAST_OUT)} END END AS shot_quality,
    CASE {" ".join(f"WHEN {n} THEN {sql_text(t)}" for n, t in prompts.MILESTONES.items())} ELSE '' END AS milestone,
    CASE WHEN item_type = 'shot' THEN CASE WHEN player_note IS NOT NULL THEN {sql_fill(prompts.PLAYER_KNOWN)}
      ELSE {sql_fill(prompts.PLAYER_UNKNOWN)} END END AS player_context,
    CASE WHEN item_type <> 'shot' THEN CASE WHEN is_opponent_red THEN {sql_fill(prompts.RED_IMPACT_OPPONENT)}
      ELSE {sql_fill(prompts.RED_IMPACT_OWN)} END END AS impact
  FROM hb""")
_TEXT_COLUMNS = [
    "match_id", "focus", "highlight_idx", "minute_text", "score_before", "moment", "shot_quality", "milestone",
    "player_context", "impact",
]


@register(sql(f"SELECT {', '.join(_TEXT_COLUMNS)} FROM texts", "texts"))
def highlight_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of every highlight: minute, scores, moment, quality, milestone, player, impact."""
    return prompts.highlight_texts(Feed(spark, sf).highlight_briefs).select(*_TEXT_COLUMNS)


_FRAME = prompts.Frame()
BLOCKS["context"] = (["ev"], """
  SELECT s.match_id, s.index,
    concat_ws(', ', lower(s.shot_type), CASE WHEN s.shot_technique <> 'Normal' THEN lower(s.shot_technique) END,
      CASE WHEN s.play_pattern <> 'Regular Play' THEN lower(s.play_pattern) END,
      CASE WHEN p.player IS NOT NULL THEN CASE WHEN p.pass_cross THEN 'cross from ' ELSE 'assist from ' END || p.player END)
      AS shot_context
  FROM ev s LEFT JOIN ev p ON p.match_id = s.match_id AND p.event_id = s.key_pass_id AND p.type = 'Pass'
  WHERE s.type = 'Shot'""")
_LANGUAGE_NOTES = " ".join(f"WHEN {sql_text(l)} THEN {sql_text(n)}" for l, n in dimensions.LANGUAGE_NOTES)
BLOCKS["prompts"] = (["hooked", "texts", "cries", "context"], f"""
  SELECT match_id, focus, home_fd, away_fd, match_round, 'intro' AS content_type, -1 AS highlight_idx, '' AS player,
         0 AS minute, 0 AS is_goal, 'intro' AS event_type,
         {sql_fill(_FRAME.intro, nickname="'The Threes'", stadium="'Third Park'")} AS prompt FROM hooked
  UNION ALL
  SELECT match_id, focus, home_fd, away_fd, match_round, 'highlight', highlight_idx, player, minute,
         CAST(is_goal AS INTEGER), item_type,
         CASE WHEN item_type <> 'shot' THEN {sql_fill(
             _FRAME.red_card, side="CASE WHEN is_opponent_red THEN opponent ELSE focus END")}
         ELSE {sql_fill(
             _FRAME.highlight,
             kind="CASE WHEN is_goal THEN 'GOAL' ELSE 'shot' END",
             milestone_line=f"CASE WHEN milestone <> '' THEN {sql_fill(_FRAME.milestone_line)} END",
             context_line=f"CASE WHEN shot_context <> '' THEN {sql_fill(_FRAME.context_line)} END",
             language_line=f"CASE WHEN language_note IS NULL THEN {sql_fill(prompts.LANGUAGE_LINE)} "
                           f"ELSE {sql_fill(prompts.LANGUAGE_LINE_NOTED)} END",
             ending="CASE WHEN final_round AND unbeaten THEN " + sql_fill(
                 "IMPORTANT: This is the final matchday of the unbeaten season of {focus}. "
                 "End with [reverently] and a single phrase about history.")
             + " ELSE " + sql_text("End with [warmly] and a brief reflection connecting to the season story.") + " END",
             opponent_line=f"CASE WHEN team_fd <> focus THEN {sql_text(_FRAME.opponent_line)} END",
         )} END
  FROM (SELECT t.*, b.home_fd, b.away_fd, b.match_round, b.final_round, b.unbeaten, c.goal_cry, x.shot_context,
               CASE c.goal_language {_LANGUAGE_NOTES} END AS language_note
        FROM texts t JOIN briefs b ON b.match_id = t.match_id AND b.focus = t.focus
        LEFT JOIN cries c ON c.player = t.player
        LEFT JOIN context x ON x.match_id = t.match_id AND x.index = t.index AND t.item_type = 'shot')""")


@register(sql("SELECT * FROM prompts", "prompts"))
def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    """All prompts of all matches, per side."""
    feed = Feed(spark, sf)
    context = enrich.shot_context(feed.events)
    texts = enrich.with_context(prompts.highlight_texts(feed.highlight_briefs), context)
    facts = feed.briefs
    highlights = prompts.highlight_prompts(
        texts, facts, feed.cries, dimensions.language_notes(spark)
    )
    intros = prompts.intro_prompts(prompts.hooks(feed.briefs, feed.hook_players), "The Threes", "Third Park")
    return prompts.prompt_table(intros, highlights, facts)
