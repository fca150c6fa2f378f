"""Minutes played, player lines and line-up order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numbers import exact, fixed, rounded
from touchline.operators import conform
from touchline.operators.joins import attach, first_by
from touchline.operators.running import placed
from touchline.operators.shots import MATCH_COLUMNS

PLAYER = ["match_id", "team", "player"]

# Full match, last regular period, least minutes of a starter.
FULL_TIME, REGULAR_PERIODS, STARTER_MINUTES = 90, 2, 45


def players_seen(events: DataFrame) -> DataFrame:
    return events.filter(F.col("player").isNotNull()).select(*PLAYER).distinct()


def player_totals(events: DataFrame) -> DataFrame:
    """Everything counted per match, team and player in one aggregation.

    Substitutions are added a second time under the player coming on, which
    the scan finds by event type.  All parts are plain aggregates, so they are combined before the
    shuffle and a crowded match sends one row per player and task.
    """
    kind = F.col("type")
    swap = kind == conform.SUBSTITUTION
    card = conform.card_of(F.col("bad_behaviour_card"), F.col("foul_committed_card"))
    sent_off = kind.isin(conform.MISCONDUCT, conform.FOUL) & conform.is_red(card)
    goal = (kind == conform.SHOT) & conform.is_goal(F.col("shot_outcome"))
    counted = events.select(
        "match_id", "team", "index", "minute", "shot_xg", "player", "substitution_replacement",
        swap.alias("swap"), sent_off.alias("sent_off"), goal.alias("goal"),
        (kind == conform.SHOT).alias("shot"),
    )
    acting = counted.filter(F.col("player").isNotNull()).withColumn("acts", F.lit(True))
    coming = counted.filter(F.col("swap") & F.col("substitution_replacement").isNotNull()).withColumns(
        {"player": F.col("substitution_replacement"), "acts": F.lit(False)}
    )
    parts = acting.unionByName(coming)
    acts = F.col("acts")

    def first_minute(condition: Column) -> Column:
        return F.min_by(F.when(condition, F.col("minute")), F.when(condition, F.col("index")))

    return parts.groupBy(*PLAYER).agg(
        F.bool_or("acts").alias("acts"),
        first_minute(acts & F.col("swap")).alias("off"),
        first_minute(~acts).alias("on"),
        first_minute(acts & F.col("sent_off")).alias("red"),
        rounded(F.sum(F.when(acts & F.col("shot"), exact(F.col("shot_xg")))), 2).alias("xg"),
        F.count_if(acts & F.col("goal")).alias("goals"),
    )


def match_ends(events: DataFrame) -> DataFrame:
    """Minute of the last event in regular time, at least a full match."""
    regular = F.col("period") <= REGULAR_PERIODS
    last = F.max_by(F.when(regular, F.col("minute")), F.when(regular, F.col("index")))
    return events.groupBy("match_id").agg(F.greatest(last, F.lit(FULL_TIME)).alias("_full"))


def _with_minutes(events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    totals = player_totals(events)
    whole = attach(totals.filter("acts"), match_ends(events), ["match_id"], ["player"], hot=hot)
    left_at = F.coalesce(F.least("off", "red"), F.col("_full"))
    played = F.greatest(left_at - F.coalesce("on", F.lit(0)), F.lit(0))
    return whole.withColumn("minutes", played.cast("int"))


def minutes_played(events: DataFrame) -> DataFrame:
    """Minutes between coming on and leaving.

    On at the first substitution for someone, else at the start.  Off at the
    first substitution or dismissal, else at the end of the match.
    """
    return _with_minutes(events).select(*PLAYER, "minutes")


def positions(lineups: DataFrame) -> DataFrame:
    """First listed position of every player in the raw line-ups."""
    players = lineups.select("match_id", "team", F.posexplode("lineup").alias("listed", "p"))
    first = F.get(F.col("p.positions"), F.lit(0))["position"]
    return players.groupBy("match_id", "team", F.col("p.player_name").alias("player")).agg(
        F.min_by(first, F.when(first.isNotNull(), F.col("listed"))).alias("position")
    )


def player_lines(
    events: DataFrame, matches: DataFrame, first_positions: DataFrame, hot: HotKeys | None = None,
) -> DataFrame:
    """Minutes, xG, goals and position of everyone who played at all.

    ``hot`` are the matches with a large share of the players.
    """
    facts = matches.select(*MATCH_COLUMNS, "home_team", "away_team")
    lines = (
        _with_minutes(events, hot).filter(F.col("minutes") > 0).join(first_positions, PLAYER, "left")
    )
    return attach(lines, facts, ["match_id"], ["player"], "inner", hot=hot).select(
        *MATCH_COLUMNS,
        F.when(F.col("team") == F.col("home_team"), F.col("home_fd"))
        .when(F.col("team") == F.col("away_team"), F.col("away_fd"))
        .otherwise(F.col("team")).alias("team_fd"),
        F.col("player").alias("player_name"),
        "minutes",
        F.coalesce("xg", F.lit(0.0)).alias("xg"),
        F.coalesce("goals", F.lit(0)).cast("int").alias("goals"),
        F.coalesce("position", F.lit("")).alias("position"),
    )


def match_players(lines: DataFrame) -> DataFrame:
    """Players with minutes, one row each: the one with most minutes."""
    used = lines.filter(F.col("minutes") > 0)
    return first_by(
        used, ["match_id", "team_fd", "player_name"], [F.desc("minutes"), F.desc("xg"), F.desc("goals")]
    )


def lineup_order(lines: DataFrame, places: DataFrame, default_place: int) -> DataFrame:
    """Starters by position, then substitutes by minutes, numbered per team."""
    known = places.select("position", "place")
    is_sub = F.col("minutes") < STARTER_MINUTES
    rank = F.when(is_sub, -F.col("minutes")).otherwise(F.col("place"))
    at = (
        lines.join(known, "position", "left")
        .withColumn("place", F.coalesce("place", F.lit(default_place)))
        .withColumn("is_sub", is_sub)
        .withColumn("_rank", rank)
    )
    order = [F.col("is_sub"), F.col("_rank"), F.col("player_name")]
    return placed(at, ["match_id", "team_fd"], order, "slot").drop("_rank", "place")


def lineup_view(lines: DataFrame, goals: DataFrame, reds: DataFrame) -> DataFrame:
    """Marks and texts shown beside a player.

    ``goals`` and ``reds`` have one row per match and player, so these joins
    meet at most one partner.
    """
    player = lines.withColumnRenamed("player_name", "player")
    marked = player.join(
        goals.select("match_id", "player", "minutes")
        .withColumnRenamed("minutes", "goal_minutes"),
        ["match_id", "player"], "left",
    ).join(reds.select("match_id", "player", "red_minute"), ["match_id", "player"], "left")
    is_red = F.col("red_minute").isNotNull()
    return marked.select(
        "match_id",
        "team_fd",
        "player",
        is_red.alias("is_red"),
        ((F.col("goals") > 0) | is_red).alias("is_bold"),
        F.concat(F.expr("repeat('⚽', goals)"), F.when(is_red, "🟥").otherwise("")).alias("icons"),
        F.when(F.col("xg") > 0, fixed(F.col("xg"))).otherwise("—").alias("xg_text"),
        F.concat(F.col("minutes").cast("string"), F.lit("'")).alias("minutes_text"),
        "goal_minutes",
    )
