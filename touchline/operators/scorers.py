"""Top scorers after every round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.names import surname
from touchline.functions.numbers import half_even
from touchline.operators.joins import top_by
from touchline.operators.lookup import held_pieces
from touchline.operators.running import block, every_step, running

TOP = 20

# Fixed value: before this round a scorer without estimated goals is not listed.
ZERO_LISTED_FROM = 5


def estimated(scorers: DataFrame, rounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Season goals spread evenly over the rounds.

    Before round ``ZERO_LISTED_FROM`` scorers without goals are left out, so
    that counted goals cannot replace their estimate either.
    ``scorers`` has ``ord, name, team, goals``; ``rounds`` one row per season
    with ``last_round``.  A season's scorer list is repeated per round by
    ``sequence``, which is the size of the result.
    """
    share = F.col("goals") * (F.col("round") / F.col("last_round"))
    return (
        scorers.join(rounds, list(keys))
        .withColumn("round", F.explode(F.sequence(F.lit(1), F.col("last_round"))))
        .withColumn("estimate", F.greatest(half_even(share), F.lit(0)))
        .filter((F.col("estimate") > 0) | (F.col("round") >= ZERO_LISTED_FROM))
        .select(*keys, "round", "ord", "name", "team", "estimate")
    )


def contenders(scorers: DataFrame, keys: Sequence[str], focus_team: str, top: int = TOP) -> DataFrame:
    """The scorers that can reach a list of ``top``, before rounds are formed.

    Equal season goals give equal estimates in every round, so of those the
    first ``top`` by ``ord`` are enough; the focus team's goals are counted and
    all of its scorers stay.
    """
    mine = F.coalesce(F.col("team") == focus_team, F.lit(False))
    others = top_by(scorers.filter(~mine), [*keys, "goals"], [F.asc("ord")], top)
    return others.unionByName(scorers.filter(mine))


def actual(goals: DataFrame, keys: Sequence[str], last_rounds: DataFrame) -> DataFrame:
    """Goals so far per surname of a player, for every round from the first goal on.

    ``goals`` has one row per goal with ``player``, ``round`` and ``seen_at``
    (the order of the goals in the source).  Where several players share a
    surname the one seen first stands for it.
    """
    per_round = (
        goals.filter(F.col("player").isNotNull())
        .groupBy(*keys, "player", "round")
        .agg(F.count("*").alias("_goals"), F.min("seen_at").alias("_seen"))
    )
    # Counts change only in rounds with a goal; in between they hold.
    counts = running(
        per_round,
        keys=[*keys, "player"],
        order_by=[F.col("round")],
        chunk_by=[block(F.col("round"))],
        sums={"goals": F.col("_goals")},
        mins={"seen_at": F.col("_seen")},
        nexts={"until": F.col("round")},
    ).join(last_rounds, list(keys))
    ends = counts.withColumn("until", F.coalesce("until", F.col("last_round") + 1))
    return every_step(ends, "round", "until", "_round").withColumnRenamed("_round", "round").select(
        *keys, "player", "round", "goals", "seen_at",
    )


def override(
    estimates: DataFrame, counts: DataFrame, keys: Sequence[str], focus_team: str
) -> DataFrame:
    """Replace estimates of the focus team by counted goals.

    A count belongs to a scorer when the player's surname occurs in the
    scorer's name; the player seen first wins.  Surnames and names of one key
    meet only, so a surname of one letter meets the scorers of one team.
    """
    by_surname = (
        counts.withColumn("_part_name", surname(F.col("player")))
        .groupBy(*keys, "round", "_part_name")
        .agg(F.min_by(F.struct("goals", "seen_at"), "seen_at").alias("_hit"))
    )
    names = held_pieces(
        estimates.filter(F.col("team") == focus_team).select(*keys, "name").distinct()
        .withColumn("_text", F.lower("name")),
        "_text",
        by_surname.select(*keys, F.col("_part_name").alias("piece")).distinct(),
        keys,
    ).withColumnRenamed("piece", "_part_name").distinct()
    hits = (
        by_surname.join(names, [*keys, "_part_name"])
        .groupBy(*keys, "round", "name")
        .agg(F.min_by("_hit.goals", "_hit.seen_at").alias("_counted"))
        .withColumn("team", F.lit(focus_team))
    )
    return (
        estimates.join(hits, [*keys, "round", "name", "team"], "left")
        .withColumn("goals", F.coalesce("_counted", "estimate"))
        .withColumn("is_counted", F.col("_counted").isNotNull())
        .drop("_counted")
    )


def top_scorers(scorers: DataFrame, keys: Sequence[str], top: int = TOP) -> DataFrame:
    """Best ``top`` scorers with goals per round; ``top`` is the size of the report."""
    order = [F.desc("goals"), F.asc("ord")]
    rank = F.row_number().over(Window.partitionBy(*keys, "round").orderBy(*order))
    return (
        scorers.filter(F.col("goals") > 0)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .select(*keys, "round", "rank", "name", "team", "goals")
    )
