"""Joins of long row sets with one short row set per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts into which the rows of one key are spread when facts are attached.
SALTS = 32

# Values of the keys, and the number of parts they are spread over.
HotKeys = list[tuple[tuple, int]]


def hot_keys(rows: DataFrame, keys: Sequence[str], salts: int = SALTS) -> HotKeys:
    """Keys with more than one ``salts``-th of the rows, and the parts their share asks for.

    Counted exactly, in one pass that reads the keys alone; there are fewer
    than ``salts`` such keys, so that many rows come to the driver at most.
    Null keys count as a key.  For rows that are stored and are joined by these
    keys more than once.
    """
    counts = rows.groupingSets([list(keys), []], *keys).agg(F.grouping_id().alias("_total"), F.count("*").alias("_n"))
    # Beside the row of the total.
    most = counts.orderBy(F.desc("_n"), F.desc("_total")).limit(salts + 1).collect()
    total = max((row["_n"] for row in most), default=0)
    return [
        (tuple(row[k] for k in keys), -(-row["_n"] * salts // total))
        for row in most if row["_total"] == 0 and row["_n"] * salts > total
    ]


def _parts(keys: Sequence[str], hot: HotKeys) -> Column:
    """Number of parts a key is spread over; 1 for those that are not hot."""
    parts = F.lit(1)
    for values, n in hot:
        is_key = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, values)])
        parts = F.when(is_key, F.lit(n)).otherwise(parts)
    return parts


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Join per-key ``facts`` to ``rows`` with every key spread over ``salts`` parts.

    ``facts`` holds few short rows per key (totals of a match, season data of
    a player) and is repeated once per part, so a key that owns a third of
    ``rows`` is worked on by ``salts`` tasks.  The part is a hash of
    ``spread_by`` and therefore the same when a lost task is run again.  Spark
    knows the size of the facts, not that of their copies, so these are never
    broadcast: ``salts`` times the threshold would go through the driver.

    With ``hot``, the result of ``hot_keys``, only these keys are spread, over
    as many parts as they ask for, and facts of other keys go along once; a
    side Spark finds to be under its broadcast threshold is then broadcast.
    """
    if hot == []:
        return rows.join(facts, list(keys), how)
    n = F.lit(salts) if hot is None else _parts(keys, hot)
    part = F.pmod(F.xxhash64(*spread_by), n).cast("int")
    repeated = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1)))
    if hot is None and salts > 1:
        repeated = repeated.hint("merge")
    return rows.withColumn("_part", part).join(repeated, [*keys, "_part"], how).drop("_part")


def first_by(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """First row per key.

    Spark applies a ``row_number() <= k`` filter on both sides of the
    shuffle, so at most one row per key and task is sent.
    """
    return top_by(df, keys, order_by, 1)


def top_by(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key, cut before the shuffle as in ``first_by``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
