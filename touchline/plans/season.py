"""Results files to rounds, league tables and top scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import conform, scorers, standings
from touchline.operators.joins import attach
from touchline.operators.results import ODDS_COLUMNS, type_results
from touchline.sources.results_file import as_matches, dated, read_raw
from touchline.sources.stage import Scope, stage
from touchline.sources.tables import read_by_round, write_by_round, write_table

# What a stored table holds beside its own columns, to be continued from any round.
SEEN = ["seen_at"]


def build(
    spark: SparkSession,
    results: str,
    out: str,
    keys: Sequence[str] = ("source_file",),
    odds: tuple[str, str, str] = ODDS_COLUMNS,
    per_round: int = 9,
) -> None:
    """Write ``results``, ``standings`` and ``rounds``, all by round, under ``out``.

    The row numbers of the files are stored before anything depends on them.
    """
    with Scope(spark):
        typed = type_results(read_raw(spark, results), odds, extra=(*keys, "source_row"))
        store(spark, stage(typed, "typed"), out, keys, per_round)


def store(spark: SparkSession, typed: DataFrame, out: str, keys: Sequence[str], per_round: int = 9) -> None:
    """``build`` out of typed rows with ``keys`` and ``source_row``."""
    rounds = conform.assign_round(dated(typed), keys, "_day", "source_row", per_round).drop("_day")
    write_by_round(rounds, f"{out}/results", keys)
    stored = read_by_round(spark, f"{out}/results")
    with Scope(spark):
        tallies = stage(standings.round_tallies(as_matches(stored, keys), keys), "tallies")
        write_by_round(standings.standings_of(tallies, keys, SEEN), f"{out}/standings", keys)
    write_by_round(_days(stored, keys), f"{out}/rounds", keys)


def extend(
    spark: SparkSession,
    results: str,
    out: str,
    keys: Sequence[str] = ("source_file",),
    odds: tuple[str, str, str] = ODDS_COLUMNS,
    per_round: int = 9,
) -> None:
    """Add the matches of further results files to the tables of ``build``; see ``add``."""
    with Scope(spark):
        typed = type_results(read_raw(spark, results), odds, extra=(*keys, "source_row"))
        add(spark, stage(typed, "typed"), out, keys, per_round)


def add(spark: SparkSession, typed: DataFrame, out: str, keys: Sequence[str], per_round: int = 9) -> None:
    """Add matches and continue the tables from the first round they change.

    A season changes from the first round on that ends on or after the day of
    its first new match, at least in its last round, which may not be full.
    Results are read from there on, standings from the round before, whose
    tallies are the state that is continued.  Only the folders of changed
    rounds are written; they hold the rows of other seasons, and of other rounds, as they were.

    A match of the same season, day and teams as a stored one replaces it, so
    a run that was stopped can be repeated.  Other matches of a day follow the
    stored ones.  Stored results hold a match once.
    """
    keys, round_ = list(keys), F.col("round")
    with Scope(spark):
        new = stage(dated(typed), "new_results")
        since = new.groupBy(*keys).agg(F.min("_day").alias("_since"))
        late = F.min(F.when(F.col("last_day") >= F.col("_since"), round_))
        known = since.join(read_by_round(spark, f"{out}/rounds"), keys, "left")
        # One row per season with new matches.
        changed = stage(known.groupBy(*keys).agg(F.coalesce(late, F.max("round"), F.lit(1)).alias("_first")), "changed")
        low = changed.agg(F.min("_first")).first()[0]
        if low is None:
            return

        again = [*keys, "_day", "HomeTeam", "AwayTeam"]
        stored = read_by_round(spark, f"{out}/results", low).join(changed, keys).filter(round_ >= F.col("_first"))
        kept = stage(dated(stored.drop("round", "place", "_first")).join(new.select(*again).distinct(), again, "left_anti"), "kept")
        after = kept.groupBy(*keys).agg((F.max("source_row") + 1).alias("_after"))
        follow = new.join(after, keys, "left").withColumn("source_row", F.col("source_row") + F.coalesce("_after", F.lit(0)))
        placed = conform.assign_round(kept.unionByName(follow.drop("_after")), keys, "_day", "source_row", per_round)
        rows = stage(placed.drop("_day").join(changed, keys).withColumns({
            "place": F.col("place") + (F.col("_first") - 1) * per_round,
            "round": (round_ + F.col("_first") - 1).cast("int"),
        }).drop("_first"), "changed_results")

        before = read_by_round(spark, f"{out}/standings", low - 1).join(changed, keys)
        state = before.filter(round_ == F.col("_first") - 1).select(*keys, "team", "round", "seen_at", *standings.TALLIES)
        tallies = stage(state.unionByName(standings.round_tallies(as_matches(rows, keys), keys)), "tallies")
        table = standings.standings_of(tallies, keys, SEEN).join(changed, keys).filter(round_ >= F.col("_first")).drop("_first")

        high = rows.agg(F.max("round")).first()[0]
        whole = {}
        for name, fresh in {"results": rows, "standings": table, "rounds": _days(rows, keys)}.items():
            held = read_by_round(spark, f"{out}/{name}", low, high, whole=True).join(changed, keys, "left")
            others = held.filter(F.col("_first").isNull() | (round_ < F.col("_first"))).drop("_first")
            whole[name] = stage(others.unionByName(fresh), name)
        # All is computed before a folder is touched; ``rounds``, which says what is stored, comes last.
        for name, df in whole.items():
            write_by_round(df, f"{out}/{name}", keys, replace=True)


def _days(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last day of every round."""
    return dated(results).groupBy(*keys, "round").agg(F.max("_day").alias("last_day"))


def build_scorers(
    spark: SparkSession,
    out: str,
    season_scorers: DataFrame,
    focus_team: str,
    shots: DataFrame | None = None,
    rounds: DataFrame | None = None,
    keys: Sequence[str] = ("source_file",),
) -> None:
    """Write the top scorers by round.

    ``season_scorers`` carries ``keys``.  With ``shots``, and ``rounds`` that
    has ``keys`` and ``round`` per ``match_id``, the focus team's estimates
    give way to counted goals.
    """
    last = read_by_round(spark, f"{out}/rounds").groupBy(*keys).agg(F.max("round").alias("last_round"))
    listed = scorers.contenders(season_scorers, keys, focus_team)
    estimates = scorers.estimated(listed, last, keys)
    if shots is None or rounds is None:
        chosen = estimates.withColumn("goals", F.col("estimate"))
    else:
        goals = shots.filter((F.col("is_goal") == 1) & (F.col("team_fd") == focus_team))
        placed = attach(
            goals.select("match_id", "index", "player"),
            rounds.select(*keys, "match_id", "round"), ["match_id"], ["index"], "inner",
        )
        # The order of goals in the source: by match, then within it.
        seen = placed.withColumn("seen_at", F.struct("match_id", "index"))
        write_table(scorers.actual(seen, keys, last), f"{out}/scorer_goals")
        counts = spark.read.parquet(f"{out}/scorer_goals")
        chosen = scorers.override(estimates, counts, keys, focus_team)
    write_by_round(scorers.top_scorers(chosen, keys), f"{out}/top_scorers", keys)
