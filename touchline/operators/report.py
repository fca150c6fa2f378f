"""Figures that tell whether a build is complete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def build_report(spark: SparkSession, made: dict[str, dict[str, int]]) -> DataFrame:
    """Rows per written table, goals and dismissals in those that hold them; one row per table."""
    lines = [(name, seen["rows"], seen.get("goals"), seen.get("reds")) for name, seen in made.items()]
    return spark.createDataFrame(lines, "table_name string, rows bigint, goals bigint, reds bigint")


def key_event_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def match_summary(shots: DataFrame) -> DataFrame:
    """Shots, goals and final shot score of every match."""
    return shots.groupBy("match_id", "home_fd", "away_fd").agg(
        F.count("*").alias("shots"),
        F.sum("is_goal").alias("goals"),
        F.max("home_score").alias("home_score"),
        F.max("away_score").alias("away_score"),
    )


def reconcile_goals(shots: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches whose goals from shots differ from the final score, as own goals make them."""
    counted = match_summary(shots).select(
        "match_id",
        F.col("home_score").alias("home_shot_goals"),
        F.col("away_score").alias("away_shot_goals"),
    )
    joined = matches.select("match_id", "home_score", "away_score").join(counted, "match_id")
    return joined.filter(
        (F.col("home_score") != F.col("home_shot_goals"))
        | (F.col("away_score") != F.col("away_shot_goals"))
    )


def team_record(matches: DataFrame) -> DataFrame:
    """Won, drawn, lost and goals of every team over all its matches."""
    both = F.array(
        F.struct(F.col("home_fd").alias("team"), F.col("home_score").alias("own"), F.col("away_score").alias("other")),
        F.struct(F.col("away_fd").alias("team"), F.col("away_score").alias("own"), F.col("home_score").alias("other")),
    )
    return matches.select(F.inline(both)).groupBy("team").agg(
        F.count_if(F.col("own") > F.col("other")).alias("won"),
        F.count_if(F.col("own") == F.col("other")).alias("drawn"),
        F.count_if(F.col("own") < F.col("other")).alias("lost"),
        F.sum("own").alias("goals_for"),
        F.sum("other").alias("goals_against"),
    )
