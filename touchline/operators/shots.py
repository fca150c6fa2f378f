"""Shots, running scores, xG totals, highlights and key events.

``events`` is the typed event table of any number of matches, see
``schemas.EVENTS``.  ``index`` numbers the events of a match densely in time
order; it is the order key of everything here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch
from touchline.functions.numbers import exact, rounded
from touchline.functions.text import score_text
from touchline.operators import conform
from touchline.operators.joins import HotKeys, attach, first_by
from touchline.operators.running import block, running

MATCH_COLUMNS = ["match_id", "home_fd", "away_fd", "match_date"]

# Highlights without goals, and extra ones beside few goals.
BEST_WITHOUT_GOALS, FEW_GOALS, BEST_BESIDE_GOALS = 3, 2, 2


def with_match(events: DataFrame, matches: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Attach date, team names and conformed team names of the match.

    ``hot`` are the matches ``hot_keys`` finds in the events.
    """
    facts = matches.select(*MATCH_COLUMNS, "home_team", "away_team")
    joined = attach(events, facts, ["match_id"], ["index"], "inner", hot=hot)
    at_home = F.col("team") == F.col("home_team")
    return joined.withColumn("is_home", at_home).withColumn(
        "team_fd",
        F.when(at_home, F.col("home_fd"))
        .when(F.col("team") == F.col("away_team"), F.col("away_fd"))
        .otherwise(F.col("team")),
    )


def shot_rows(events: DataFrame, matches: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """One row per shot with the score after it.

    The score counts goals from shots only, the shot itself included; goals
    of any team but the home team count for the away side.
    """
    shots = with_match(events.filter(F.col("type") == conform.SHOT), matches, hot)
    goal = conform.is_goal(F.col("shot_outcome"))
    typed = shots.select(
        *MATCH_COLUMNS,
        "index",
        "team_fd",
        "is_home",
        "player",
        "minute",
        conform.coordinate(F.col("location"), 0).alias("x"),
        conform.coordinate(F.col("location"), 1).alias("y"),
        rounded(exact(F.col("shot_xg")), 4).alias("xg"),
        goal.cast("int").alias("is_goal"),
        F.coalesce("shot_outcome", F.lit("")).alias("outcome"),
        F.coalesce("shot_technique", F.lit("")).alias("technique"),
        F.coalesce("shot_body_part", F.lit("")).alias("body_part"),
    )
    return running_score(typed)


def running_score(shots: DataFrame) -> DataFrame:
    scored = running(
        shots,
        keys=["match_id"],
        order_by=[F.col("index")],
        chunk_by=[block(F.col("index"))],
        sums={
            "home_score": F.when(F.col("is_home"), F.col("is_goal")).otherwise(0),
            "away_score": F.when(F.col("is_home"), 0).otherwise(F.col("is_goal")),
        },
    )
    return (
        scored.withColumn("home_score", F.col("home_score").cast("int"))
        .withColumn("away_score", F.col("away_score").cast("int"))
        .withColumn("score_after", score_text(F.col("home_score"), F.col("away_score")))
        .drop("is_home")
    )


# --- xG totals -------------------------------------------------------------


def match_xg(events: DataFrame, matches: DataFrame, places: int = 3) -> DataFrame:
    """xG of both sides for every match, 0 for a match without shots."""
    per_team = (
        events.filter(F.col("type") == conform.SHOT)
        .groupBy("match_id", "team")
        .agg(F.sum(exact(F.col("shot_xg"))).alias("_xg"))
    )
    sides = matches.select(*MATCH_COLUMNS, "home_team", "away_team").join(per_team, "match_id", "left")

    def total(side: str, name: str) -> Column:
        own = F.sum(F.when(F.col("team") == F.col(side), F.col("_xg")))
        return rounded(F.coalesce(own, F.lit(0)), places).alias(name)

    return sides.groupBy(*MATCH_COLUMNS).agg(
        total("home_team", "home_xg"), total("away_team", "away_xg")
    )


def player_shot_totals(events: DataFrame) -> DataFrame:
    """xG and goals per match, team and player in one pass over the shots."""
    return (
        events.filter((F.col("type") == conform.SHOT) & F.col("player").isNotNull())
        .groupBy("match_id", "team", "player")
        .agg(
            rounded(F.sum(exact(F.col("shot_xg"))), 2).alias("xg"),
            F.count_if(conform.is_goal(F.col("shot_outcome"))).alias("goals"),
        )
    )


# --- highlights ------------------------------------------------------------


def clean_shots(shots: DataFrame) -> DataFrame:
    """Defaults filled in, and one row per player, minute and goal mark."""
    typed = (
        shots.withColumn("xg", rounded(conform.number_or_zero(F.col("xg")), 3))
        .withColumn("is_goal", F.coalesce("is_goal", F.lit(0)))
        .withColumn("minute", F.coalesce(F.col("minute"), F.lit(0)))
        .withColumn("player", F.coalesce("player", F.lit("Unknown")))
        .withColumn("x", F.coalesce("x", F.lit(conform.DEFAULT_X)))
        .withColumn("y", F.coalesce("y", F.lit(conform.DEFAULT_Y)))
    )
    return first_by(typed, ["match_id", "player", "minute", "is_goal"], [F.col("index")])


def highlight_shots(shots: DataFrame) -> DataFrame:
    """The shots shown for each match.

    No goal: the three best shots by xG.  One or two goals: the goals and the
    two best other shots.  More: the goals alone.  The best non-goals are cut
    to three per match before anything is joined, so only they and the goals
    are ever moved.
    """
    cleaned = clean_shots(shots)
    goals = cleaned.filter(F.col("is_goal") == 1)
    by_xg = Window.partitionBy("match_id").orderBy(F.desc("xg"), F.asc("index"))
    best = (
        cleaned.filter(F.col("is_goal") == 0)
        .withColumn("_place", F.row_number().over(by_xg))
        .filter(F.col("_place") <= BEST_WITHOUT_GOALS)
    )
    counts = goals.groupBy("match_id").agg(F.count("*").alias("_goals"))
    wanted = best.join(counts, "match_id", "left").filter(
        F.col("_goals").isNull()
        | ((F.col("_goals") <= FEW_GOALS) & (F.col("_place") <= BEST_BESIDE_GOALS))
    )
    return goals.unionByName(wanted.drop("_goals", "_place"))


def in_time_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("match_id", "minute", "index")


def shot_map(shots: DataFrame) -> DataFrame:
    """Drawing values of a shot and who it was against."""
    home = F.col("team_fd") == F.col("home_fd")
    return shots.select(
        "match_id",
        "index",
        home.alias("is_home"),
        F.when(home, F.col("away_fd")).otherwise(F.col("home_fd")).alias("opponent"),
        pitch.map_x(F.col("x")).alias("map_x"),
        pitch.map_y(F.col("y")).alias("map_y"),
        pitch.marker_radius(F.col("xg")).alias("radius"),
        pitch.bar_width(F.col("xg")).alias("bar_width"),
    )


# --- key events ------------------------------------------------------------


def key_event_columns(events: DataFrame) -> DataFrame:
    """Goals and dismissals of typed events as one filter, usable on a stream too."""
    kind = F.col("type")
    card = (
        F.when(kind == conform.MISCONDUCT, F.col("bad_behaviour_card"))
        .when(kind == conform.FOUL, F.col("foul_committed_card"))
    )
    goal = (kind == conform.SHOT) & conform.is_goal(F.col("shot_outcome"))
    sent_off = conform.is_red(card)
    xg = F.when(goal, rounded(exact(F.col("shot_xg")), 3)).otherwise(0.0)
    return (
        events.filter(kind.isin(conform.SHOT, conform.MISCONDUCT, conform.FOUL))
        .filter(goal | sent_off)
        .withColumn("event_type", F.when(goal, "goal").otherwise("red_card"))
        .withColumn("xg", xg)
    )


def key_events(events: DataFrame, matches: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    found = with_match(key_event_columns(events), matches, hot)
    return found.select(
        *MATCH_COLUMNS, "index", "event_type", "player", "team_fd", "minute", "xg"
    )


def key_event_view(events: DataFrame) -> DataFrame:
    """Key events as listed for a match: xG to two places, none for cards."""
    return events.select(
        "match_id", "index", "event_type", "player", "team_fd", "minute",
        F.when(F.col("event_type") == "goal", rounded(F.col("xg"), 2)).alias("xg"),
    )
