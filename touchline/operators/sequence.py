"""Highlight sequence of a match: shots and dismissals with the score at the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import score_text
from touchline.operators.joins import attach
from touchline.operators.running import block, numbered

NO_SCORE = "0-0"
SHOT_ITEM, RED_ITEM = "shot", "red_card"


def score_at(cards: DataFrame, shots: DataFrame) -> DataFrame:
    """As-of lookup: score after the last shot up to and including the card's minute.

    Shots and cards are first reduced to one row per match and minute, so the
    window over a match sees its distinct minutes and not its events.
    """
    keys = ["match_id", "minute"]
    marks = shots.groupBy(*keys).agg(
        F.max_by("home_score", "index").alias("_home"), F.max_by("away_score", "index").alias("_away")
    )
    none = F.lit(None).cast("int")
    asked = cards.select(*keys).distinct().withColumns({"_home": none, "_away": none})
    minutes = marks.unionByName(asked).groupBy(*keys).agg(
        F.max("_home").alias("_home"), F.max("_away").alias("_away")
    )
    so_far = (
        Window.partitionBy("match_id").orderBy("minute")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def last(side: str) -> Column:
        return F.last(side, ignorenulls=True).over(so_far)

    scores = minutes.select(
        *keys,
        F.coalesce(score_text(last("_home"), last("_away")), F.lit(NO_SCORE)).alias("score_at"),
    )
    return attach(cards, scores, keys, ["index"])


def items(shots: DataFrame, cards: DataFrame) -> DataFrame:
    """Shots and scored cards under one set of columns, told apart by ``item_type``.

    An item without a minute counts as one of minute 0, as the sequence has to
    be a total order.
    """
    both = shots.withColumn("item_type", F.lit(SHOT_ITEM)).unionByName(
        cards.withColumn("item_type", F.lit(RED_ITEM)), allowMissingColumns=True
    )
    return both.withColumn("minute", F.coalesce("minute", F.lit(0)))


def number_items(joined: DataFrame) -> DataFrame:
    """Items of every match numbered from 0 by minute, shots first on equal minutes."""
    kinds = joined.withColumn("_kind", (F.col("item_type") == RED_ITEM).cast("int"))
    order = [F.col("minute"), F.col("_kind"), F.col("index")]
    placed = numbered(kinds, ["match_id"], order, [*order[:2], block(order[2])], "_n")
    return placed.withColumn("highlight_idx", (F.col("_n") - 1).cast("int")).drop("_n", "_kind")


def sequence_labels(sequenced: DataFrame) -> DataFrame:
    """``i / total`` of every item; the totals are formed apart and attached."""
    totals = sequenced.groupBy("match_id").agg(F.count("*").alias("total"))
    return attach(sequenced, totals, ["match_id"], ["index"]).withColumn(
        "label", F.format_string("Highlight %d / %d", F.col("highlight_idx") + 1, F.col("total"))
    )


def goal_minutes(events: DataFrame) -> DataFrame:
    """Minutes in which a player scored, with the goals in each.

    Goals are counted per minute first, so a list holds at most the minutes
    of one match.
    """
    per_minute = (
        events.filter(F.col("event_type") == "goal")
        .groupBy("match_id", "player", "minute")
        .agg(F.count("*").alias("goals"))
    )
    listed = F.sort_array(F.collect_list(F.struct("minute", "goals")))
    return per_minute.groupBy("match_id", "player").agg(
        F.sum("goals").alias("goals"), listed.alias("minutes")
    )


def red_minutes(events: DataFrame) -> DataFrame:
    """Minute in which a player was sent off; the last one listed counts."""
    reds = events.filter(F.col("event_type") == "red_card")
    return reds.groupBy("match_id", "player").agg(
        F.max_by("minute", F.struct("minute", "index")).alias("red_minute")
    )
