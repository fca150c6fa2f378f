"""Queries over events: shots, scores, xG, key events, highlights, players."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import dimensions
from touchline.catalog.registry import register
from touchline.catalog.feed import Feed, raw_lineups
from touchline.catalog.views import BLOCKS, FOCUS, feed_matches, sql, table, team_dimension
from touchline.functions.numbers import rounded, exact
from touchline.operators import conform, enrich, lineups, report, sequence, shots

SHOT_FIELDS = [
    "match_id", "index", "home_fd", "away_fd", "match_date", "team_fd", "player", "minute", "x", "y",
    "xg", "is_goal", "outcome", "technique", "body_part", "home_score", "away_score", "score_after",
]


# --- names, predicates, coordinates ----------------------------------------


@register(sql(
    "SELECT match_id, season, match_date, match_round AS match_week, home_team, away_team, home_fd, away_fd, "
    "home_score, away_score FROM fixtures", "fixtures",
))
def name_conform(spark: SparkSession, sf: str) -> DataFrame:
    """Matches with the results file's team names; unknown names pass through."""
    return feed_matches(spark, sf)


@register(sql(
    """SELECT name, count(*) AS uses FROM (SELECT home_team AS name FROM fixtures UNION ALL SELECT away_team FROM fixtures)
       WHERE name NOT IN (SELECT feed_name FROM teams) GROUP BY name""", "fixtures",
))
def unmapped_names(spark: SparkSession, sf: str) -> DataFrame:
    """Team names the dimension does not know."""
    return conform.unmapped_names(Feed(spark, sf).fixtures, team_dimension(spark, sf), ["home_team", "away_team"])


@register(sql(
    "SELECT index, shot_outcome AS from_json, shot_outcome AS from_text FROM ev WHERE type = 'Shot'", "ev",
))
def nested_names(spark: SparkSession, sf: str) -> DataFrame:
    """A name out of JSON with a name field and out of plain text."""
    events = Feed(spark, sf).events.filter(F.col("type") == conform.SHOT)
    as_json = F.to_json(F.struct(F.lit(97).alias("id"), F.col("shot_outcome").alias("name")))
    return events.select(
        "index",
        conform.name_of(as_json).alias("from_json"),
        conform.name_of(F.col("shot_outcome")).alias("from_text"),
    )


@register(sql(
    """SELECT type, count(*) AS events, count(*) FILTER (shot_outcome = 'Goal') AS goals,
       count(*) FILTER (coalesce(bad_behaviour_card, foul_committed_card) IN ('Red Card', 'Second Yellow')) AS reds
       FROM ev WHERE type IN ('Shot', 'Bad Behaviour', 'Foul Committed', 'Substitution') GROUP BY type""", "ev",
))
def event_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the event types in use, goals and dismissals."""
    card = conform.card_of(F.col("bad_behaviour_card"), F.col("foul_committed_card"))
    used = F.col("type").isin(conform.SHOT, conform.MISCONDUCT, conform.FOUL, conform.SUBSTITUTION)
    return Feed(spark, sf).events.filter(used).groupBy("type").agg(
        F.count("*").alias("events"),
        F.count_if(conform.is_goal(F.col("shot_outcome"))).alias("goals"),
        F.count_if(conform.is_red(card)).alias("reds"),
    )


@register(sql(
    """SELECT match_id, home_fd, away_fd, index, team_fd, player, minute, x, y, xg, is_goal, outcome, technique, body_part,
       match_date, home_score, away_score, home_score || '-' || away_score AS score_after FROM shots""", "shots",
))
def running_score(spark: SparkSession, sf: str) -> DataFrame:
    """All shots with the score after each, in event order."""
    return Feed(spark, sf).shots_once.select(*SHOT_FIELDS)


@register(sql(
    """SELECT f.match_id, f.home_fd, f.away_fd, f.match_date,
       CAST(round(coalesce(sum(CAST(e.shot_xg AS DECIMAL(18,6))) FILTER (e.team = f.home_team), 0), 3) AS DOUBLE) AS home_xg,
       CAST(round(coalesce(sum(CAST(e.shot_xg AS DECIMAL(18,6))) FILTER (e.team = f.away_team), 0), 3) AS DOUBLE) AS away_xg
       FROM fixtures f LEFT JOIN ev e ON e.match_id = f.match_id AND e.type = 'Shot'
       GROUP BY f.match_id, f.home_fd, f.away_fd, f.match_date""", "fixtures",
))
def match_xg(spark: SparkSession, sf: str) -> DataFrame:
    """Expected goals of both sides of every match."""
    feed = Feed(spark, sf)
    return shots.match_xg(feed.events, feed.fixtures)


@register(sql(
    """SELECT match_id, team, player, CAST(round(sum(CAST(shot_xg AS DECIMAL(18,6))), 2) AS DOUBLE) AS xg,
       count(*) FILTER (shot_outcome = 'Goal') AS goals
       FROM ev WHERE type = 'Shot' AND player IS NOT NULL GROUP BY match_id, team, player""", "ev",
))
def player_xg_goals(spark: SparkSession, sf: str) -> DataFrame:
    """Expected goals and goals per match, team and player."""
    return shots.player_shot_totals(Feed(spark, sf).events)


# --- highlights ------------------------------------------------------------

BLOCKS["clean"] = (["shots"], """
  SELECT * EXCLUDE (rn, xg, x, y, player), CAST(round(CAST(xg AS DECIMAL(28,6)), 3) AS DOUBLE) AS xg,
         coalesce(x, 60.0) AS x, coalesce(y, 40.0) AS y, coalesce(player, 'Unknown') AS player
  FROM (SELECT *, row_number() OVER (PARTITION BY match_id, coalesce(player, 'Unknown'), minute, is_goal ORDER BY index) AS rn
        FROM shots) WHERE rn = 1""")
BLOCKS["selected"] = (["clean"], """
  SELECT * EXCLUDE (goals, place) FROM (
    SELECT *, sum(is_goal) OVER (PARTITION BY match_id) AS goals,
           row_number() OVER (PARTITION BY match_id, is_goal ORDER BY xg DESC, index) AS place FROM clean)
  WHERE CASE WHEN goals = 0 THEN place <= 3 WHEN goals <= 2 THEN is_goal = 1 OR place <= 2 ELSE is_goal = 1 END""")
BLOCKS["scored"] = (["keyev", "shots"], """
  SELECT r.match_id, r.home_fd, r.away_fd, r.match_date, r.index, r.player, r.team_fd, r.minute,
         coalesce((SELECT s.home_score || '-' || s.away_score FROM shots s
                   WHERE s.match_id = r.match_id AND s.minute <= r.minute
                   ORDER BY s.minute DESC, s.index DESC LIMIT 1), '0-0') AS score_at
  FROM keyev r WHERE r.event_type = 'red_card'""")
BLOCKS["seq"] = (["selected", "scored"], """
  SELECT *, CAST(row_number() OVER (PARTITION BY match_id ORDER BY minute, kind, index) - 1 AS INTEGER) AS highlight_idx,
         count(*) OVER (PARTITION BY match_id) AS total
  FROM (SELECT match_id, index, minute, player, team_fd, 0 AS kind, 'shot' AS item_type, is_goal, xg, x, y, outcome,
               home_score, away_score, home_score || '-' || away_score AS score_after, NULL AS score_at,
               home_fd, away_fd FROM selected
        UNION ALL
        SELECT match_id, index, minute, player, team_fd, 1, 'red_card', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
               NULL, score_at, home_fd, away_fd FROM scored)""")


@register(sql(
    "SELECT match_id, index, player, minute, is_goal, xg, x, y, home_score || '-' || away_score AS score_after FROM clean",
    "clean",
))
def distinct_shots(spark: SparkSession, sf: str) -> DataFrame:
    """Shots with defaults, one per player, minute and goal mark."""
    columns = ["match_id", "index", "player", "minute", "is_goal", "xg", "x", "y", "score_after"]
    return shots.clean_shots(Feed(spark, sf).shots_once).select(*columns)


@register(sql(
    """SELECT match_id, index, team_fd, player, minute, is_goal, xg, outcome,
       home_score || '-' || away_score AS score_after FROM selected""", "selected",
))
def highlight_select(spark: SparkSession, sf: str) -> DataFrame:
    """The shots shown for each match."""
    columns = ["match_id", "index", "team_fd", "player", "minute", "is_goal", "xg", "outcome", "score_after"]
    return shots.highlight_shots(Feed(spark, sf).shots).select(*columns)


@register(sql(
    "SELECT match_id, minute, index, player, team_fd, xg, is_goal FROM shots ORDER BY match_id, minute, index", "shots",
))
def shots_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """All shots of all matches in time order."""
    ordered = shots.in_time_order(Feed(spark, sf).shots_once)
    return ordered.select("match_id", "minute", "index", "player", "team_fd", "xg", "is_goal")


@register(sql(
    """SELECT match_id, index, team_fd = home_fd AS is_home, CASE WHEN team_fd = home_fd THEN away_fd ELSE home_fd END AS opponent,
       least(greatest((x - 60.0) / 60.0 * 560.0, 4.0), 556.0) AS map_x, least(greatest(y / 80.0 * 320.0, 4.0), 316.0) AS map_y,
       CAST(least(greatest(CAST(trunc(xg * 65) AS INTEGER), 8), 20) AS INTEGER) AS radius,
       CAST(least(140, CAST(trunc(xg * 140 / CAST(0.5 AS DOUBLE)) AS INTEGER)) AS INTEGER) AS bar_width
       FROM (SELECT * EXCLUDE (x, y, xg), CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(xg AS DOUBLE) AS xg FROM clean)""",
    "clean",
))
def shot_map(spark: SparkSession, sf: str) -> DataFrame:
    """Drawing position, marker size and bar width of every shot."""
    return shots.shot_map(shots.clean_shots(Feed(spark, sf).shots_once))


# --- key events, sequence --------------------------------------------------


@register(sql("SELECT * FROM keyev", "keyev"))
def key_events(spark: SparkSession, sf: str) -> DataFrame:
    """Goals and dismissals of all matches."""
    return Feed(spark, sf).key_events_once


@register(sql(
    """SELECT match_id, index, event_type, player, team_fd, minute,
       CASE WHEN event_type = 'goal' THEN CAST(round(CAST(xg AS DECIMAL(28,6)), 2) AS DOUBLE) END AS xg FROM keyev""", "keyev",
))
def key_events_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Goals and dismissals as listed for a match."""
    return shots.key_event_view(Feed(spark, sf).key_events_once)


@register(sql("SELECT match_id, index, player, team_fd, minute, score_at FROM scored", "scored"))
def score_at_card(spark: SparkSession, sf: str) -> DataFrame:
    """Score at the time of every dismissal."""
    feed = Feed(spark, sf)
    scored = sequence.score_at(feed.reds, feed.shots)
    return scored.select("match_id", "index", "player", "team_fd", "minute", "score_at")


@register(sql(
    """SELECT match_id, highlight_idx, item_type, index, minute, player, team_fd, is_goal, xg, score_after, score_at,
       'Highlight ' || (highlight_idx + 1) || ' / ' || total AS label FROM seq""", "seq",
))
def highlight_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Shots and dismissals of a match in order, numbered."""
    labelled = sequence.sequence_labels(Feed(spark, sf).sequence)
    return labelled.select(
        "match_id", "highlight_idx", "item_type", "index", "minute", "player", "team_fd", "is_goal", "xg",
        "score_after", "score_at", "label",
    )


@register(sql(
    """SELECT match_id, player, CAST(sum(n) AS BIGINT) AS goals,
       string_agg(minute || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, ',' ORDER BY minute) AS minutes
       FROM (SELECT match_id, player, minute, count(*) AS n FROM keyev WHERE event_type = 'goal' GROUP BY ALL)
       GROUP BY match_id, player""", "keyev",
))
def goal_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes in which a player scored."""
    def text(m):
        times = F.when(m["goals"] > 1, F.concat(F.lit("x"), m["goals"].cast("string"))).otherwise("")
        return F.concat(m["minute"].cast("string"), times)

    listed = sequence.goal_minutes(Feed(spark, sf).key_events_once)
    return listed.withColumn("minutes", F.array_join(F.transform("minutes", text), ","))


# --- players ---------------------------------------------------------------

BLOCKS["minutes"] = (["ev"], """
  SELECT p.match_id, p.team, p.player,
         CAST(greatest(coalesce(least(o.off, r.red), e.full_time) - coalesce(s.came_on, 0), 0) AS INTEGER) AS minutes
  FROM (SELECT DISTINCT match_id, team, player FROM ev WHERE player IS NOT NULL) p
  LEFT JOIN (SELECT match_id, team, player, arg_min(minute, index) AS off FROM ev
             WHERE type = 'Substitution' GROUP BY ALL) o USING (match_id, team, player)
  LEFT JOIN (SELECT match_id, team, player, arg_min(minute, index) AS red FROM ev
             WHERE type IN ('Bad Behaviour', 'Foul Committed')
               AND coalesce(bad_behaviour_card, foul_committed_card) IN ('Red Card', 'Second Yellow') GROUP BY ALL) r
    USING (match_id, team, player)
  LEFT JOIN (SELECT match_id, team, substitution_replacement AS player, arg_min(minute, index) AS came_on FROM ev
             WHERE type = 'Substitution' GROUP BY ALL) s USING (match_id, team, player)
  JOIN (SELECT match_id, greatest(coalesce(arg_max(minute, index) FILTER (period <= 2), 90), 90) AS full_time
        FROM ev GROUP BY match_id) e USING (match_id)""")
# First listed position of the line-ups, by the number in the player's name.
BLOCKS["places"] = (["ev"], """
  SELECT DISTINCT match_id, team, player,
         CASE CAST(regexp_extract(player, '([0-9]+)$', 1) AS INTEGER) % 5 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Left Wing'
              WHEN 2 THEN 'Centre Back' WHEN 3 THEN 'Sweeper' END AS position
  FROM ev WHERE player IS NOT NULL AND type = 'Pass'""")
BLOCKS["lines"] = (["minutes", "places", "fixtures"], """
  SELECT f.match_id, f.home_fd, f.away_fd, f.match_date,
         CASE WHEN m.team = f.home_team THEN f.home_fd ELSE f.away_fd END AS team_fd, m.player AS player_name, m.minutes,
         coalesce(x.xg, 0.0) AS xg, coalesce(x.goals, 0) AS goals, coalesce(p.position, '') AS position
  FROM minutes m JOIN fixtures f ON f.match_id = m.match_id
  LEFT JOIN (SELECT match_id, team, player, CAST(round(sum(CAST(shot_xg AS DECIMAL(18,6))), 2) AS DOUBLE) AS xg,
                    CAST(count(*) FILTER (shot_outcome = 'Goal') AS INTEGER) AS goals
             FROM ev WHERE type = 'Shot' GROUP BY ALL) x
    ON x.match_id = m.match_id AND x.team = m.team AND x.player = m.player
  LEFT JOIN places p ON p.match_id = m.match_id AND p.team = m.team AND p.player = m.player
  WHERE m.minutes > 0""")


@register(sql("SELECT DISTINCT match_id, team, player FROM ev WHERE player IS NOT NULL", "ev"))
def players_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Everyone who appears in a match."""
    return lineups.players_seen(Feed(spark, sf).events)


@register(sql("SELECT * FROM minutes", "minutes"))
def minutes_played(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes of every player in every match."""
    return lineups.minutes_played(Feed(spark, sf).events)


@register(sql("SELECT * FROM places", "places"))
def first_positions(spark: SparkSession, sf: str) -> DataFrame:
    """First position of every player in the line-ups."""
    return lineups.positions(raw_lineups(Feed(spark, sf).events))


@register(sql("SELECT * FROM lines", "lines"))
def player_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes, xG, goals and position per match and player."""
    return Feed(spark, sf).lines_once


@register(sql(
    """SELECT * EXCLUDE (rn) FROM (SELECT match_id, team_fd, player_name, minutes, xg, goals,
       row_number() OVER (PARTITION BY match_id, team_fd, player_name ORDER BY minutes DESC, xg DESC, goals DESC) AS rn
       FROM lines WHERE minutes > 0) WHERE rn = 1""", "lines",
))
def match_players(spark: SparkSession, sf: str) -> DataFrame:
    """One row per player with minutes, the one with most of them."""
    columns = ["match_id", "team_fd", "player_name", "minutes", "xg", "goals"]
    return lineups.match_players(Feed(spark, sf).lines_once).select(*columns)


_PLACE = "CASE position WHEN 'Goalkeeper' THEN 0 WHEN 'Centre Back' THEN 1 WHEN 'Left Wing' THEN 6 ELSE 99 END"


@register(sql(
    f"""SELECT match_id, team_fd, player_name, minutes, position, minutes < 45 AS is_sub,
        row_number() OVER (PARTITION BY match_id, team_fd ORDER BY minutes < 45,
                           CASE WHEN minutes < 45 THEN -minutes ELSE {_PLACE} END, player_name) AS slot
        FROM lines""", "lines",
))
def lineup_order(spark: SparkSession, sf: str) -> DataFrame:
    """Starters by position, then substitutes by minutes."""
    ordered = lineups.lineup_order(
        Feed(spark, sf).lines, dimensions.position_order(spark), dimensions.DEFAULT_POSITION_ORDER
    )
    return ordered.select("match_id", "team_fd", "player_name", "minutes", "position", "is_sub", "slot")


@register(sql(
    """SELECT l.match_id, l.team_fd, l.player_name AS player, r.match_id IS NOT NULL AS is_red,
       l.goals > 0 OR r.match_id IS NOT NULL AS is_bold,
       repeat('⚽', l.goals) || CASE WHEN r.match_id IS NOT NULL THEN '🟥' ELSE '' END AS icons,
       CASE WHEN l.xg > 0 THEN printf('%.2f', l.xg) ELSE '—' END AS xg_text, l.minutes || '''' AS minutes_text,
       coalesce(g.n, 0) AS scoring_minutes
       FROM lines l
       LEFT JOIN (SELECT DISTINCT match_id, player FROM keyev WHERE event_type = 'red_card') r
         ON r.match_id = l.match_id AND r.player = l.player_name
       LEFT JOIN (SELECT match_id, player, CAST(count(DISTINCT minute) AS INTEGER) AS n FROM keyev WHERE event_type = 'goal'
                  GROUP BY ALL) g ON g.match_id = l.match_id AND g.player = l.player_name""", "lines", "keyev",
))
def lineup_display(spark: SparkSession, sf: str) -> DataFrame:
    """Marks and texts beside the players."""
    feed = Feed(spark, sf)
    events = feed.key_events
    shown = lineups.lineup_view(feed.lines, sequence.goal_minutes(events), sequence.red_minutes(events))
    return shown.withColumn("scoring_minutes", F.coalesce(F.size("goal_minutes"), F.lit(0))).drop("goal_minutes")


@register(sql(
    """SELECT s.match_id, s.index, s.player, s.minute, s.shot_technique AS technique,
       coalesce(s.shot_type, 'Open Play') AS shot_type, s.play_pattern, coalesce(p.player, '') AS assist_player,
       coalesce(p.pass_cross, false) AS cross_assist,
       concat_ws(', ', lower(s.shot_type), CASE WHEN s.shot_technique <> 'Normal' THEN lower(s.shot_technique) END,
         CASE WHEN s.play_pattern <> 'Regular Play' THEN lower(s.play_pattern) END,
         CASE WHEN p.player IS NOT NULL THEN CASE WHEN p.pass_cross THEN 'cross from ' ELSE 'assist from ' END || p.player END)
         AS context
       FROM ev s LEFT JOIN ev p ON p.match_id = s.match_id AND p.event_id = s.key_pass_id AND p.type = 'Pass'
       WHERE s.type = 'Shot'""", "ev",
))
def shot_context(spark: SparkSession, sf: str) -> DataFrame:
    """Set piece, technique, pattern and assist of every shot."""
    return enrich.shot_context(Feed(spark, sf).events).withColumn("context", enrich.context_text())


# --- reports ---------------------------------------------------------------


@register(sql("SELECT event_type, count(*) AS events FROM keyev GROUP BY event_type", "keyev"))
def key_event_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Goals and dismissals in total."""
    return report.key_event_totals(Feed(spark, sf).key_events_once)


@register(sql(
    """SELECT match_id, home_fd, away_fd, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals,
       max(home_score) AS home_score, max(away_score) AS away_score FROM shots GROUP BY match_id, home_fd, away_fd""", "shots",
))
def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Shots, goals and final shot score of every match."""
    return report.match_summary(Feed(spark, sf).shots_once)


@register(sql(
    """SELECT f.match_id, f.home_score, f.away_score, s.h AS home_shot_goals, s.a AS away_shot_goals
       FROM fixtures f JOIN (SELECT match_id, max(home_score) AS h, max(away_score) AS a FROM shots GROUP BY match_id) s
         ON s.match_id = f.match_id WHERE f.home_score <> s.h OR f.away_score <> s.a""", "fixtures", "shots",
))
def reconcile_goals(spark: SparkSession, sf: str) -> DataFrame:
    """Matches where the goals from shots are not the final score."""
    return report.reconcile_goals(Feed(spark, sf).shots, feed_matches(spark, sf))


@register(sql(
    """SELECT 'events' AS table_name, count(*) AS rows FROM ev UNION ALL SELECT 'shots', count(*) FROM shots
       UNION ALL SELECT 'key_events', count(*) FROM keyev UNION ALL SELECT 'players', count(*) FROM lines""",
    "shots", "keyev", "lines",
))
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table of a build."""
    feed = Feed(spark, sf)
    return report.row_counts({
        "events": feed.events,
        "shots": feed.shots_once,
        "key_events": feed.key_events_once,
        "players": feed.lines_once,
    })


@register(sql(
    """SELECT * FROM fixtures_public WHERE home_fd = 'Team 3' OR away_fd = 'Team 3'""".replace(
        "fixtures_public", "(SELECT match_id, match_date, home_fd, away_fd FROM fixtures)"), "fixtures",
))
def focus_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of one team, one row each."""
    return conform.focus_matches(Feed(spark, sf).fixtures, FOCUS).select("match_id", "match_date", "home_fd", "away_fd")


@register(sql(
    """SELECT match_id, home_fd, away_fd FROM fixtures
       WHERE regexp_matches(home_fd, '(?i)team 1') OR regexp_matches(away_fd, '(?i)team 1')""", "fixtures",
))
def team_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Matches whose team names fit a pattern, case ignored."""
    hit = conform.contains_text(F.col("home_fd"), "team 1") | conform.contains_text(F.col("away_fd"), "team 1")
    return Feed(spark, sf).fixtures.filter(hit).select("match_id", "home_fd", "away_fd")


@register(sql(
    """SELECT match_id, match_round, (home_fd = 'Team 3' OR away_fd = 'Team 3') AND match_round >= 25 AS has_detail
       FROM fixtures""", "fixtures",
))
def detail_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Whether details are shown for a match."""
    wanted = conform.has_detail(F.col("home_fd"), F.col("away_fd"), F.col("match_round"), F.lit(FOCUS))
    return Feed(spark, sf).fixtures.select("match_id", "match_round", wanted.alias("has_detail"))


@register(sql(
    """SELECT event_id AS index, CASE WHEN k % 7 = 0 THEN 0.0 WHEN k % 11 = 0 THEN 0.0 ELSE value END AS number,
       CAST(CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 0 ELSE trunc(value) END AS BIGINT) AS whole FROM ev0""", "ev0",
))
def numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers out of text with gaps and misprints, 0 where there is none."""
    from touchline.functions.numbers import safe_int

    raw = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.when(k % 7 == 0, "nan").when(k % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return raw.select(
        F.col("event_id").alias("index"),
        conform.number_or_zero(text).alias("number"),
        safe_int(text).alias("whole"),
    )


@register(sql(
    """SELECT index, CAST(round(CAST(shot_xg AS DECIMAL(18,6)), 2) AS DOUBLE) AS xg2,
       CAST(round(CAST(shot_xg AS DECIMAL(18,6)), 3) AS DOUBLE) AS xg3,
       CAST(round(CAST(shot_xg AS DECIMAL(18,6)), 4) AS DOUBLE) AS xg4 FROM ev WHERE type = 'Shot'""", "ev",
))
def xg_rounding(spark: SparkSession, sf: str) -> DataFrame:
    """xG to two, three and four places."""
    xg = exact(F.col("shot_xg"))
    found = Feed(spark, sf).events.filter(F.col("type") == conform.SHOT)
    return found.select("index", *[rounded(xg, n).alias(f"xg{n}") for n in (2, 3, 4)])
