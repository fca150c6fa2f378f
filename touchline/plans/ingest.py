"""Landed feed files to matches, events, shots, key events, xG and player lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import dimensions
from touchline.operators import conform, lineups, report, shots
from touchline.operators.joins import hot_keys
from touchline.sources import landed
from touchline.sources.stage import Scope, stage
from touchline.sources.tables import read_table, write_counted, write_table


def _by_match(df: DataFrame, *within: str) -> DataFrame:
    """Rows ordered by match across files, so that one match touches few files.

    The range ends with the row order inside a match: a large match is spread
    over several tasks and files.
    """
    order = ["match_id", *within]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _reopen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build(
    spark: SparkSession,
    landing: str,
    out: str,
    names: DataFrame | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Build all event tables under ``out`` and return ``report.build_report`` of them.

    ``landing`` has the folders ``matches``, ``events`` and ``lineups``.
    Files that do not parse go to the table ``rejects``.  The text of the
    events is parsed once and stored; what sorts or divides them reads that.
    The figures of the report are taken while the tables are written.
    """
    names = dimensions.team_names(spark) if names is None else names
    matches = landed.read_matches(spark, f"{landing}/matches", multi_line=multi_line)
    named = conform.conform_names(matches, names, {"home_team": "home_fd", "away_team": "away_fd"})
    made = {"matches": write_counted(named, f"{out}/matches")}
    matches = _reopen(spark, f"{out}/matches")

    with Scope(spark):
        raw = stage(landed.read_event_files(spark, f"{landing}/events", multi_line), "landed")
        made["events"] = write_counted(_by_match(landed.events_from(raw), "index"), f"{out}/events")
        made["rejects"] = write_counted(landed.rejects(raw), f"{out}/rejects")
    events = _reopen(spark, f"{out}/events")
    hot = hot_keys(events, ["match_id"])

    made["xg_by_match"] = write_counted(shots.match_xg(events, matches), f"{out}/xg_by_match")
    made["shots"] = write_counted(
        _by_match(shots.shot_rows(events, matches, hot), "index"), f"{out}/shots", goals=F.count_if(F.col("is_goal") == 1),
    )
    kind = F.col("event_type")
    made["key_events"] = write_counted(
        _by_match(shots.key_events(events, matches, hot), "index"), f"{out}/key_events",
        goals=F.count_if(kind == "goal"), reds=F.count_if(kind == "red_card"),
    )
    places = lineups.positions(landed.read_lineups(spark, f"{landing}/lineups", multi_line))
    lines = lineups.player_lines(events, matches, places, hot)
    made["players"] = write_counted(_by_match(lines, "team_fd", "player_name"), f"{out}/players")
    return report.build_report(spark, made)


def unmapped(spark: SparkSession, out: str, names: DataFrame | None = None) -> DataFrame:
    """Team names of the built matches that the name table lacks."""
    names = dimensions.team_names(spark) if names is None else names
    return conform.unmapped_names(_reopen(spark, f"{out}/matches"), names, ["home_team", "away_team"])


def rebuild_key_events(spark: SparkSession, out: str) -> None:
    """Make the key events anew out of the stored events."""
    events, matches = _reopen(spark, f"{out}/events"), _reopen(spark, f"{out}/matches")
    write_table(_by_match(shots.key_events(events, matches), "index"), f"{out}/key_events")


def rebuild_shots(spark: SparkSession, out: str) -> None:
    """Make the shots anew out of the stored events."""
    events, matches = _reopen(spark, f"{out}/events"), _reopen(spark, f"{out}/matches")
    write_table(_by_match(shots.shot_rows(events, matches), "index"), f"{out}/shots")


def table(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """A built table, empty when it was not built yet."""
    return read_table(spark, f"{out}/{name}", schema)


def match_of(table_: DataFrame, match_id: int) -> DataFrame:
    """The rows of one match; file statistics leave the other files closed."""
    return table_.filter(F.col("match_id") == match_id)
