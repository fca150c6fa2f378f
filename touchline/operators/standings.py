"""League tables after every round.

Input rows are matches with ``home_team``, ``away_team``, ``home_goals``,
``away_goals``, ``round`` and ``place`` (any number that grows in the order
the matches are listed), for any number of seasons named by ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numbers import signed
from touchline.operators.running import block, every_step, running

WIN_POINTS = 3
TALLIES = ["played", "won", "drawn", "lost", "gf", "ga"]


def _side(team: str, scored: str, conceded: str, is_away: int) -> Column:
    own, other = F.coalesce(scored, F.lit(0)), F.coalesce(conceded, F.lit(0))
    return F.struct(
        F.col(team).alias("team"),
        (F.col("place") * 2 + is_away).alias("seen_at"),
        F.lit(1).alias("played"),
        (own > other).cast("int").alias("won"),
        (own == other).cast("int").alias("drawn"),
        (own < other).cast("int").alias("lost"),
        own.cast("int").alias("gf"),
        other.cast("int").alias("ga"),
    )


def team_rows(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two rows per match, one seen from each side."""
    return matches.select(
        *keys,
        "round",
        F.inline(
            F.array(
                _side("home_team", "home_goals", "away_goals", 0),
                _side("away_team", "away_goals", "home_goals", 1),
            )
        ),
    )


def round_tallies(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tallies per team and round; the sums are formed before the shuffle."""
    return (
        team_rows(matches, keys)
        .groupBy(*keys, "team", "round")
        .agg(
            F.min("seen_at").alias("seen_at"),
            *[F.sum(c).cast("bigint").alias(c) for c in TALLIES],
        )
    )


def intervals(tallies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running tallies per team with the rounds they hold for: from ``round`` on, below ``until``.

    A team's tallies change only in rounds it plays, so there is a row for each
    of these; the last one holds to the end of the season.
    """
    last = tallies.groupBy(*keys).agg((F.max("round") + 1).alias("_end"))
    counts = running(
        tallies.withColumnsRenamed({c: f"_{c}" for c in TALLIES}),
        keys=[*keys, "team"],
        order_by=[F.col("round")],
        chunk_by=[block(F.col("round"))],
        sums={c: F.col(f"_{c}") for c in TALLIES},
        mins={"_seen": F.col("seen_at")},
        nexts={"until": F.col("round")},
    )
    return counts.join(last, list(keys)).withColumn("until", F.coalesce("until", "_end")).withColumn("seen_at", F.col("_seen")).drop("_end", "_seen")


def cumulative(tallies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running tallies per team for every round, also those it sat out."""
    dense = every_step(intervals(tallies, keys), "round", "until", "_round")
    played = F.when(F.col("_round") == F.col("_since"), F.col("_played")).otherwise(0)
    return dense.withColumn("_played", played).withColumnRenamed("_round", "round").drop("_since")


def standings(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after every round: one row per season, round and team.

    A team is listed from its first match on, and a round only when it was
    played.  Level teams keep the order in which they first appeared.
    """
    return standings_of(round_tallies(matches, keys), keys)


def standings_of(tallies: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``standings`` out of stored round tallies, which are read more than once."""
    return rank_teams(cumulative(tallies, keys), keys, extra)


def final_standings(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the last round alone: one plain sum per team, no running totals."""
    season = Window.partitionBy(*keys)  # one row per team at this point
    totals = (
        team_rows(matches, keys)
        .groupBy(*keys, "team")
        .agg(
            F.max("round").alias("round"),
            F.min("seen_at").alias("seen_at"),
            *[F.sum(c).cast("bigint").alias(c) for c in TALLIES],
        )
        .withColumn("round", F.max("round").over(season))
        .withColumn("_played", F.col("played"))
    )
    return rank_teams(totals, keys)


def rank_teams(totals: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """League positions; a window group holds the teams of one table.

    ``extra`` names further columns to carry along.
    """
    table = Window.partitionBy(*keys, "round")
    order = [F.desc("pts"), F.desc("gd"), F.desc("gf"), F.asc("seen_at"), F.asc("team")]
    return (
        totals.withColumn("gd", F.col("gf") - F.col("ga"))
        .withColumn("pts", F.col("won") * WIN_POINTS + F.col("drawn"))
        .withColumn("_played_now", F.sum("_played").over(table))
        .withColumn("position", F.row_number().over(table.orderBy(*order)))
        .filter(F.col("_played_now") > 0)
        .select(*keys, "round", "position", "team", *TALLIES, "gd", "pts", *extra)
    )


def table_of_round(table: DataFrame, round_: int) -> DataFrame:
    """One round; read from a table stored by round, only that folder is opened."""
    return table.filter(F.col("round") == round_)


def leaders(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leader and number of listed teams for every round."""
    return table.groupBy(*keys, "round").agg(
        F.count("*").alias("teams"),
        F.max(F.when(F.col("position") == 1, F.col("team"))).alias("leader"),
        F.max(F.when(F.col("position") == 1, F.col("pts"))).alias("leader_pts"),
    )


def title_races(table: DataFrame, keys: Sequence[str], games: int | None = None) -> DataFrame:
    """Per round: points of the leader, the most another team can still get, and whether that settles the title.

    ``games`` is what every team plays in a season; without it, the most a team
    has played in the table, which is right for seasons that are over.  While a
    team has yet to play its first match nothing is settled.
    """
    most = F.max("played") if games is None else F.max(F.lit(games))
    seasons = table.groupBy(*keys).agg(most.alias("_games"), F.countDistinct("team").alias("_teams"))
    can_get = F.col("pts") + WIN_POINTS * F.greatest(F.col("_games") - F.col("played"), F.lit(0))
    rounds = table.join(seasons, list(keys)).groupBy(*keys, "round").agg(
        F.max(F.when(F.col("position") == 1, F.col("pts"))).alias("lead"),
        F.max(F.when(F.col("position") > 1, can_get)).alias("reach"),
        (F.count("*") == F.max("_teams")).alias("_all"),
    )
    settled = F.coalesce(F.col("_all") & (F.col("lead") > F.col("reach")), F.lit(False))
    return rounds.select(*keys, "round", "lead", "reach", settled.alias("settled"))


def title_rounds(table: DataFrame, keys: Sequence[str], games: int | None = None) -> DataFrame:
    """The first round of a season after which its leader can no longer be reached on points.

    Seasons that stay open to the end, and those of one team, have no row.
    """
    return title_races(table, keys, games).filter("settled").groupBy(*keys).agg(F.min("round").alias("title_round"))


def table_view(table: DataFrame, focus_team: str = "") -> DataFrame:
    """Display columns: signed goal difference and the focus team's mark."""
    mine = F.col("team") == focus_team
    return table.withColumn("gd_text", signed(F.col("gd"))).withColumn("is_focus", mine)
