"""Story flags of matches and highlights, seen from either side.

Every match gives two briefs, one per team.  ``focus_team`` cuts them to one
club right after the match totals are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numbers import rounded
from touchline.operators import standings
from touchline.operators.joins import HotKeys, attach, top_by
from touchline.operators.running import block, running
from touchline.operators.sequence import RED_ITEM

SIDE = ["match_id", "focus"]

# Thresholds of the flags.
EASY_MARGIN, RIOT_MARGIN = 4, 5
TIGHT_GOALS, PACKED_GOALS, DRAW_GOALS = 3, 5, 4
LATE_AFTER, EARLY_BEFORE, EARLY_RED_BEFORE = 85, 15, 40
FEW_CHANCES_XG, DOMINANT_FACTOR = 0.3, 2
LOW_XG, HIGH_XG, SCREAMER_XG = 0.08, 0.50, 0.05
BRACE, HATTRICK = 2, 3
KEY_PLAYER_GOALS, TOP_SCORER_NOTE = 5, "top scorer"
FINAL_ROUND, TITLE_ROUND = 34, 29
DEFAULT_SHOT_X, DEFAULT_SHOT_Y = 90.0, 40.0


def sides(matches: DataFrame, focus_team: str | None = None) -> DataFrame:
    """One row per match and side with the orientation columns."""
    home, away = F.col("home_fd"), F.col("away_fd")
    both = F.array(
        F.struct(home.alias("focus"), away.alias("opponent"), F.lit(True).alias("focus_home")),
        F.struct(away.alias("focus"), home.alias("opponent"), F.lit(False).alias("focus_home")),
    )
    out = matches.select("match_id", "home_fd", "away_fd", F.inline(both))
    return out.filter(F.col("focus") == focus_team) if focus_team else out


def scorers_of_match(shots: DataFrame) -> DataFrame:
    """Goals per match, team and player, with the time of the first one."""
    goals = shots.filter((F.col("is_goal") == 1) & F.col("player").isNotNull())
    return (
        goals.groupBy("match_id", "team_fd", "player")
        .agg(
            F.count("*").alias("goals"),
            F.min(F.struct("minute", "index")).alias("first_at"),
        )
        .withColumn("is_brace", F.col("goals") >= BRACE)
        .withColumn("is_hattrick", F.col("goals") >= HATTRICK)
    )


def scorer_lists(scorers: DataFrame) -> DataFrame:
    """Scorers per match and side as lists: the players, never the goals.

    All scorers are listed by their first goal, the multiple ones by name.

    The rows are one per scorer already, so a list is as long as the scorers
    of one team in one match.
    """
    names = F.sort_array(F.collect_list(F.struct("first_at", "player", "goals")))
    listed = scorers.groupBy("match_id", F.col("team_fd").alias("focus")).agg(names.alias("_all"))

    def pick(least: int) -> Column:
        return F.transform(
            F.filter("_all", lambda s: s["goals"] >= least), lambda s: s["player"]
        )

    return listed.select(
        *SIDE,
        pick(1).alias("scorers"),
        F.array_sort(pick(BRACE)).alias("brace_scorers"),
        F.array_sort(pick(HATTRICK)).alias("hattricks"),
    )


def hook_players(scorers: DataFrame, first: int) -> DataFrame:
    """The players named in hooks: one hat-trick and one brace player, the first scorers.

    Least values and a top list that is cut before the shuffle; nothing grows
    with the scorers of a match.
    """
    side = ["match_id", "team_fd"]
    multiple = scorers.groupBy(*side).agg(
        F.min(F.when(F.col("is_hattrick"), F.col("player"))).alias("hattrick_player"),
        F.min(F.when(F.col("is_brace"), F.col("player"))).alias("brace_player"),
    )
    leading = top_by(scorers, side, [F.asc("first_at"), F.asc("player")], first)
    named = F.sort_array(F.collect_list(F.struct("first_at", "player")))
    firsts = leading.groupBy(*side).agg(
        F.transform(named, lambda s: s["player"]).alias("first_scorers")
    )
    return multiple.join(firsts, side).withColumnRenamed("team_fd", "focus")


def scorer_context(scorers: DataFrame, stats: DataFrame) -> DataFrame:
    """Season statistics of the scorers of a side as a map by player.

    ``stats`` has one row per player, as ``season_stats_of`` gives it; scorers
    without statistics are left out.
    """
    known = stats.filter(F.col("stats_name").isNotNull()).select(
        "player",
        F.struct(
            F.col("goals").alias("goals"), "assists", "apps", F.col("xg").alias("xg"), "note"
        ).alias("_stats"),
    )
    joined = attach(
        scorers.select("match_id", F.col("team_fd").alias("focus"), "player"),
        known, ["player"], ["match_id", "focus"], "inner",
    )
    return joined.groupBy(*SIDE).agg(
        F.map_from_entries(F.collect_list(F.struct("player", "_stats"))).alias("scorer_context")
    )


def match_totals(shots: DataFrame, matches: DataFrame, focus_team: str | None = None) -> DataFrame:
    """Goals for and against and the goal-time flags per match and side."""
    goal = F.col("is_goal") == 1
    per_match = shots.groupBy("match_id").agg(
        F.count_if(goal & (F.col("team_fd") == F.col("home_fd"))).alias("_home"),
        F.count_if(goal & (F.col("team_fd") != F.col("home_fd"))).alias("_away"),
        F.coalesce(F.bool_or(goal & (F.col("minute") > LATE_AFTER)), F.lit(False)).alias("late_drama"),
        F.coalesce(F.bool_or(goal & (F.col("minute") < EARLY_BEFORE)), F.lit(False)).alias("early_goal"),
    )
    joined = sides(matches, focus_team).join(per_match, "match_id", "left")
    home, away = F.coalesce("_home", F.lit(0)), F.coalesce("_away", F.lit(0))
    return joined.select(
        *SIDE, "opponent", "focus_home", "home_fd", "away_fd",
        F.when(F.col("focus_home"), home).otherwise(away).cast("int").alias("goals_for"),
        F.when(F.col("focus_home"), away).otherwise(home).cast("int").alias("goals_against"),
        F.coalesce("late_drama", F.lit(False)).alias("late_drama"),
        F.coalesce("early_goal", F.lit(False)).alias("early_goal"),
    )


def first_reds(cards: DataFrame) -> DataFrame:
    """First dismissal listed for each match."""
    order = F.col("index")
    return cards.groupBy("match_id").agg(
        F.min_by("team_fd", order).alias("red_card_team"),
        F.min_by("minute", order).alias("red_minute"),
    )


def season_records(totals: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per match: its season's last round; per season and team: unbeaten and champion.

    ``totals`` has every side of every match.  The champion leads by points,
    goal difference, goals and name; a window holds the teams of a season.
    """
    lost, drew = F.col("goals_for") < F.col("goals_against"), F.col("goals_for") == F.col("goals_against")
    points = F.when(lost, 0).when(drew, 1).otherwise(3)
    per_team = totals.join(rounds, "match_id").groupBy("season", "focus").agg(
        F.count_if(lost).alias("_losses"), F.sum(points).alias("_points"),
        F.sum(F.col("goals_for") - F.col("goals_against")).alias("_gd"), F.sum("goals_for").alias("_gf"),
        F.max("match_round").alias("_last"),
    )
    season = Window.partitionBy("season")
    best = season.orderBy(F.desc("_points"), F.desc("_gd"), F.desc("_gf"), F.asc("focus"))
    return per_team.select(
        "season", "focus", (F.col("_losses") == 0).alias("unbeaten"), (F.row_number().over(best) == 1).alias("champion"),
        F.max("_last").over(season).alias("_season_end"),
    )


def season_titles(totals: DataFrame, rounds: DataFrame, games: int | None = None) -> DataFrame:
    """The round that settles a season's title, by the tables its matches give; see ``standings.title_rounds``.

    ``totals`` are the ``match_totals`` of all matches of a season, ``rounds``
    has ``season`` and ``match_round``; matches without a round are left out.
    """
    placed = rounds.filter("match_round > 0").select("match_id", "season", F.col("match_round").alias("round"))
    matches = totals.filter("focus_home").join(placed, "match_id").select(
        "season", "round", F.col("match_id").alias("place"), F.col("home_fd").alias("home_team"),
        F.col("away_fd").alias("away_team"), F.col("goals_for").alias("home_goals"),
        F.col("goals_against").alias("away_goals"),
    )
    return standings.title_rounds(standings.standings(matches, ["season"]), ["season"], games)


def match_briefs(
    shots: DataFrame,
    cards: DataFrame,
    matches: DataFrame,
    xg: DataFrame,
    rounds: DataFrame,
    focus_team: str | None = None,
    final_round: int | None = FINAL_ROUND,
    title_round: int = TITLE_ROUND,
    totals: DataFrame | None = None,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Flags of every match and side.

    ``titles`` has the ``title_round`` per ``season``, which else is the same
    round for all.

    ``xg`` has ``home_xg`` and ``away_xg`` and ``rounds`` has ``match_round``,
    one row per ``match_id``, and ``season`` where there are several.  Without
    ``final_round`` it is the last round of the season.  All joins are between
    one-row-per-match tables; the record of a season takes all its matches, so
    one team is picked after it.  Where ``matches`` are only some of a season,
    ``totals`` are the ``match_totals`` of all of them and ``rounds`` has all.
    """
    season = F.col("season") if "season" in rounds.columns else F.lit(0)
    rounds = rounds.select("match_id", F.coalesce("match_round", F.lit(0)).alias("match_round"), season.alias("season"))
    if totals is None:
        totals = match_totals(shots, matches)
        records = season_records(totals, rounds)
    else:
        records = season_records(totals, rounds)
        totals = totals.join(matches.select("match_id"), "match_id", "left_semi")
    if focus_team:
        totals, records = (x.filter(F.col("focus") == focus_team) for x in (totals, records))
    joined = (
        totals
        .join(first_reds(cards), "match_id", "left")
        .join(xg.select("match_id", "home_xg", "away_xg"), "match_id", "left")
        .join(rounds, "match_id", "left")
        .join(records, ["season", "focus"], "left")
    )
    if titles is None:
        joined = joined.withColumn("title_round", F.lit(title_round))
    else:
        joined = joined.join(titles.select("season", "title_round"), "season", "left")
    diff = F.col("goals_for") - F.col("goals_against")
    total = F.col("goals_for") + F.col("goals_against")
    own_xg = F.when(F.col("focus_home"), F.col("home_xg")).otherwise(F.col("away_xg"))
    other_xg = F.when(F.col("focus_home"), F.col("away_xg")).otherwise(F.col("home_xg"))
    round_ = F.coalesce("match_round", F.lit(0))
    return joined.select(
        *SIDE, "opponent", "focus_home", "home_fd", "away_fd",
        round_.cast("int").alias("match_round"),
        "goals_for", "goals_against",
        rounded(own_xg, 2).alias("xg_for"),
        rounded(other_xg, 2).alias("xg_against"),
        (diff > 0).alias("won"),
        (diff == 0).alias("drew"),
        (diff < 0).alias("lost"),
        (diff >= EASY_MARGIN).alias("easy_win"),
        (diff >= RIOT_MARGIN).alias("ran_riot"),
        ((total <= TIGHT_GOALS) & (F.abs(diff) == 1)).alias("tight_game"),
        ((total >= PACKED_GOALS) & (F.abs(diff) == 1)).alias("action_packed"),
        ((diff == 0) & (total >= DRAW_GOALS)).alias("entertaining_draw"),
        (round_ == (F.col("_season_end") if final_round is None else final_round)).alias("final_round"),
        F.coalesce(round_ == F.col("title_round"), F.lit(False)).alias("title_round"),
        F.coalesce(own_xg < FEW_CHANCES_XG, F.lit(False)).alias("few_chances"),
        F.coalesce(own_xg > other_xg * DOMINANT_FACTOR, F.lit(False)).alias("dominant_xg"),
        F.col("red_minute").isNotNull().alias("has_red_card"),
        "red_card_team", "red_minute", "late_drama", "early_goal",
        F.coalesce("unbeaten", F.lit(False)).alias("unbeaten"), F.coalesce("champion", F.lit(False)).alias("champion"),
    )


# --- highlights ------------------------------------------------------------


def goal_numbers(sequenced: DataFrame) -> DataFrame:
    """How many goals of the player in the match a shown goal makes; 1 for others.

    Numbered per player along the sequence of the match.
    """
    kind = F.when(F.col("item_type") == RED_ITEM, 1).otherwise(0)
    order = [F.col("minute"), kind, F.col("index")]
    named = sequenced.withColumns(
        {"_who": F.coalesce("player", F.lit("")), "_team": F.coalesce("team_fd", F.lit(""))}
    )
    scored = F.coalesce(F.col("is_goal"), F.lit(0))
    numbered = running(
        named,
        keys=["match_id", "_team", "_who"],
        order_by=order,
        chunk_by=[*order[:2], block(order[2])],
        sums={"_n": scored.cast("bigint")},
    )
    return numbered.withColumn(
        "goal_number", F.when(scored == 1, F.col("_n")).otherwise(1).cast("int")
    ).drop("_n", "_who", "_team")


def highlight_briefs(
    sequenced: DataFrame, briefs: DataFrame, scorers: DataFrame, stats: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Flags of every item of the highlight sequence, per side of the match.

    ``sequenced`` carries ``goal_number``; ``scorers`` is the table of scorers
    per match; ``stats`` has season statistics, one row per player; ``hot`` are
    the matches ``hot_keys`` finds in the sequence.
    """
    facts = briefs.select(*SIDE, "opponent", "focus_home", "goals_for", "goals_against")
    rows = attach(sequenced, facts, ["match_id"], ["index"], "inner", hot=hot)
    totals = scorers.select(
        "match_id", "team_fd", "player", F.col("goals").alias("_match_goals")
    )
    rows = attach(rows, totals, ["match_id", "team_fd", "player"], ["index"])
    if stats is None:
        rows = rows.withColumns({"_g": F.lit(None).cast("int"), "_apps": F.lit(None).cast("int"),
                                 "_note": F.lit(None).cast("string")})
    else:
        season = stats.select(
            "player", F.col("goals").alias("_g"), F.col("apps").alias("_apps"),
            F.col("note").alias("_note"),
        )
        rows = attach(rows, season, ["player"], ["match_id", "index"])
    return rows.select(*_highlight_columns())


def _highlight_columns() -> list[Column]:
    red = F.col("item_type") == RED_ITEM
    shot = ~red
    minute, xg = F.col("minute"), F.col("xg")
    goal = shot & F.coalesce(F.col("is_goal") == 1, F.lit(False))
    own = F.when(F.col("focus_home"), F.col("home_score")).otherwise(F.col("away_score"))
    other = F.when(F.col("focus_home"), F.col("away_score")).otherwise(F.col("home_score"))
    mine = F.coalesce(F.col("team_fd") == F.col("focus"), F.lit(False))
    own_goal, other_goal = goal & mine, goal & ~mine
    number = F.col("goal_number")
    # Milestones are counted for the focus team's scorers only.
    in_match = F.when(mine, F.coalesce("_match_goals", F.lit(0))).otherwise(0)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    flags = {
        "is_goal": goal,
        "is_own_goal_for": own_goal,
        "is_goal_against": other_goal,
        "is_opener": own_goal & (own == 1) & (other == 0) & (minute < EARLY_BEFORE),
        "is_equaliser": own_goal & (own == other),
        "is_go_ahead": own_goal & (own == other + 1),
        "is_consolation": other_goal & (other < own),
        "opp_equaliser": other_goal & (other == own),
        "opp_takes_lead": other_goal & (other > own),
        "is_winner": own_goal
        & (own == F.col("goals_for")) & (other == F.col("goals_against")),
        "is_low_xg_goal": goal & (xg < LOW_XG),
        "is_high_xg_goal": goal & (xg > HIGH_XG),
        "is_screamer": goal & (xg < SCREAMER_XG),
        "late_drama": shot & (minute > LATE_AFTER),
        "brace": shot & (in_match >= BRACE) & (in_match < HATTRICK) & (number == BRACE),
        "hattrick_complete": shot & (in_match >= HATTRICK) & (number == HATTRICK),
        "hattrick_extend": shot & (in_match >= HATTRICK) & (number > HATTRICK),
        "is_top_scorer": shot & (F.col("_note") == TOP_SCORER_NOTE),
        "is_key_player": shot & (F.col("_g") >= KEY_PLAYER_GOALS),
        "early_red": red & (minute < EARLY_RED_BEFORE),
        "is_opponent_red": red & ~mine,
    }
    return [
        *[F.col(c) for c in (*SIDE, "highlight_idx", "item_type", "index", "player", "team_fd", "minute")],
        F.col("opponent"), F.col("focus_home"), F.col("goals_for"), F.col("goals_against"),
        own.alias("own_score"), other.alias("other_score"), F.col("score_after"), F.col("score_at"),
        xg.alias("xg"), F.col("outcome"),
        F.when(shot, F.coalesce("x", F.lit(DEFAULT_SHOT_X))).alias("x"),
        F.when(shot, F.coalesce("y", F.lit(DEFAULT_SHOT_Y))).alias("y"),
        *[flag(c).alias(n) for n, c in flags.items()],
        F.when(shot, F.col("_g")).alias("season_goals"),
        F.when(shot, F.col("_apps")).alias("season_apps"),
        F.when(shot, F.col("_note")).alias("player_note"),
    ]
