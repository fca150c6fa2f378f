"""Context of a shot: set piece, technique, pattern of play and the pass before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import conform

OPEN_PLAY = "Open Play"


def shot_context(events: DataFrame) -> DataFrame:
    """Every shot with its assisting pass; both ids are unique, so one row per shot."""
    shots = events.filter(F.col("type") == conform.SHOT).select(
        "match_id", "index", "player", "minute",
        F.coalesce("shot_technique", F.lit("")).alias("technique"),
        F.coalesce("shot_type", F.lit(OPEN_PLAY)).alias("shot_type"),
        F.coalesce("play_pattern", F.lit("")).alias("play_pattern"),
        F.col("key_pass_id").alias("_pass"),
    )
    passes = events.filter(F.col("type") == "Pass").select(
        "match_id",
        F.col("event_id").alias("_pass"),
        F.col("player").alias("assist_player"),
        F.coalesce("pass_cross", F.lit(False)).alias("cross_assist"),
    )
    return (
        shots.join(passes, ["match_id", "_pass"], "left")
        .withColumn("assist_player", F.coalesce("assist_player", F.lit("")))
        .withColumn("cross_assist", F.coalesce("cross_assist", F.lit(False)))
        .drop("_pass")
    )


def context_text() -> Column:
    """The context as words, parts without content left out."""
    assist = F.when(
        F.col("assist_player") != "",
        F.concat(
            F.when(F.col("cross_assist"), "cross from ").otherwise("assist from "),
            F.col("assist_player"),
        ),
    )
    return F.concat_ws(
        ", ",
        F.when(F.col("shot_type") != OPEN_PLAY, F.lower("shot_type")),
        F.when(~F.col("technique").isin("", "Normal"), F.lower("technique")),
        F.when(~F.col("play_pattern").isin("", "Regular Play"), F.lower("play_pattern")),
        assist,
    )


def with_context(highlights: DataFrame, context: DataFrame) -> DataFrame:
    """Shot context beside every highlight; none for dismissals."""
    texts = context.select("match_id", "index", context_text().alias("shot_context"))
    return highlights.join(texts, ["match_id", "index"], "left").withColumn(
        "shot_context", F.coalesce("shot_context", F.lit(""))
    )
