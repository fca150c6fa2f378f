"""Results files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the file and the place of a row in it.

    Files that are read together have the same header line; another one is an
    error and not a silent shift.  The row number grows along a file.  It depends on how the files are cut into
    tasks, so it is to be stored before it is used to sort.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    raw = reader.csv(path)
    return raw.withColumn("source_file", F.col("_metadata.file_name")).withColumn(
        "source_row", F.monotonically_increasing_id()
    )


def dated(typed: DataFrame) -> DataFrame:
    """A day to sort by: matches without a readable date come first."""
    return typed.withColumn("_day", F.coalesce("Date", F.lit("0001-01-01").cast("date")))


def as_matches(results: DataFrame, keys: Sequence[str] = ("source_file",)) -> DataFrame:
    """Results under the names the standings work with."""
    return results.select(
        *keys,
        "round",
        F.col("HomeTeam").alias("home_team"),
        F.col("AwayTeam").alias("away_team"),
        F.col("FTHG").cast("int").alias("home_goals"),
        F.col("FTAG").cast("int").alias("away_goals"),
        "place",
    )
