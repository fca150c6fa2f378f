"""Queue of texts still to be voiced, and which audio exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.names import asset_name
from touchline.functions.text import score_words
from touchline.operators.conform import contains_text, usable_text

QUEUED, UNUSABLE, PRESENT = "queued", "unusable", "present"


def texts_of_team(texts: DataFrame, pattern: str) -> DataFrame:
    """Texts of the matches whose home or away team fits the pattern."""
    return texts.filter(
        contains_text(F.col("home_fd"), pattern) | contains_text(F.col("away_fd"), pattern)
    )


def voice_status(texts: DataFrame, assets: DataFrame) -> DataFrame:
    """Every text with its file name and whether it is to be voiced.

    ``assets`` has the column ``file_name``.  File names are unique per text,
    so neither side of the join has a repeated key.
    """
    name = asset_name(
        F.col("home_fd"), F.col("away_fd"), F.col("content_type"), F.col("highlight_idx")
    )
    have = assets.select("file_name").distinct().withColumn("_have", F.lit(True))
    status = (
        F.when(~usable_text(F.coalesce("commentary", F.lit(""))), UNUSABLE)
        .when(F.col("_have"), PRESENT)
        .otherwise(QUEUED)
    )
    return (
        texts.withColumn("file_name", name)
        .join(have, "file_name", "left")
        .withColumn("status", status)
        .drop("_have")
    )


def voice_queue(texts: DataFrame, assets: DataFrame, strict: bool = False) -> DataFrame:
    """Texts to be voiced, scores spelled out."""
    todo = voice_status(texts, assets).filter(F.col("status") == QUEUED)
    return todo.select("file_name", score_words(F.col("commentary"), strict).alias("spoken"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("texts"))


def characters(texts: DataFrame) -> DataFrame:
    """Characters that the texts would use."""
    return texts.agg(F.coalesce(F.sum(F.length("commentary")), F.lit(0)).alias("characters"))


def available_audio(matches: DataFrame, assets: DataFrame) -> DataFrame:
    """Existing audio per match, read back from the file names.

    The match part of a name is rebuilt from the match rows and joined; it is
    not parsed, as team names may hold any character.
    """
    file = F.regexp_extract("file_name", r"^(.*)_(intro|highlight)_(-?[0-9]+)\.mp3$", 1)
    kind = F.regexp_extract("file_name", r"_(intro|highlight)_(-?[0-9]+)\.mp3$", 1)
    idx = F.regexp_extract("file_name", r"_(intro|highlight)_(-?[0-9]+)\.mp3$", 2)
    parsed = assets.select(
        file.alias("_stem"), kind.alias("content_type"), idx.try_cast("int").alias("highlight_idx")
    ).filter(F.col("content_type") != "").distinct()
    stem = F.regexp_replace(
        asset_name(F.col("home_fd"), F.col("away_fd"), F.lit(""), F.lit("")), r"__\.mp3$", ""
    )
    named = matches.select("match_id", stem.alias("_stem"))
    return named.join(parsed, "_stem").select("match_id", "content_type", "highlight_idx")


def intro_of_match(texts: DataFrame) -> DataFrame:
    """First intro of every match."""
    intros = texts.filter(F.col("content_type") == "intro")
    return intros.groupBy("match_id").agg(F.min_by("commentary", "highlight_idx").alias("intro"))


def text_of_highlights(sequenced: DataFrame, texts: DataFrame) -> DataFrame:
    """Text beside each highlight, found by its number; one text per number."""
    spoken = texts.filter(F.col("content_type") == "highlight").select(
        "match_id", "highlight_idx", "commentary"
    )
    return sequenced.join(spoken, ["match_id", "highlight_idx"], "left")
