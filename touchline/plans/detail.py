"""Tables behind the detail view of a match: highlights, line-ups, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import dimensions
from touchline.operators import lineups, sequence, shots
from touchline.sources.tables import write_table


def build(spark: SparkSession, out: str) -> None:
    """Write ``highlights`` and ``lineups`` for all matches out of the event tables under ``out``."""
    all_shots = spark.read.parquet(f"{out}/shots")
    events = spark.read.parquet(f"{out}/key_events")
    reds = events.filter(F.col("event_type") == sequence.RED_ITEM).drop("event_type", "xg")
    scored = sequence.score_at(reds, all_shots)
    write_table(sequence.items(shots.highlight_shots(all_shots), scored), f"{out}/highlight_items")
    write_table(sequence.number_items(spark.read.parquet(f"{out}/highlight_items")), f"{out}/highlights")

    lines = lineups.match_players(spark.read.parquet(f"{out}/players"))
    ordered = lineups.lineup_order(
        lines, dimensions.position_order(spark), dimensions.DEFAULT_POSITION_ORDER
    )
    write_table(ordered, f"{out}/lineups")


def highlights_of(spark: SparkSession, out: str, match_id: int) -> DataFrame:
    found = spark.read.parquet(f"{out}/highlights").filter(F.col("match_id") == match_id)
    return sequence.sequence_labels(found).orderBy("highlight_idx")


def lineups_of(spark: SparkSession, out: str, match_id: int) -> DataFrame:
    lines = spark.read.parquet(f"{out}/lineups").filter(F.col("match_id") == match_id)
    events = spark.read.parquet(f"{out}/key_events").filter(F.col("match_id") == match_id)
    shown = lineups.lineup_view(lines, sequence.goal_minutes(events), sequence.red_minutes(events))
    order = lines.select("match_id", "team_fd", F.col("player_name").alias("player"), "slot")
    return shown.join(order, ["match_id", "team_fd", "player"]).orderBy("team_fd", "slot")
