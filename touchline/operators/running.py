"""Running values over long groups.

A plain window puts all rows of one key in one task, which stalls as soon as
one match, team or season holds a large share of the data.  ``running`` cuts
each key into chunks that follow the sort order, runs the window inside the
chunks, and adds what the earlier chunks of the key amount to.  The wide rows
are shuffled once, by (key, chunk); only one small row per chunk is shuffled
by key alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.stage import stage

# Rows per chunk when the sort ends in a dense row number.
CHUNK = 65_536
# Numbers in one list when an interval is spread out.
STEPS = 64


def block(index: Column, width: int = CHUNK) -> Column:
    """First number of the chunk a dense row number falls into."""
    return index - F.pmod(index, F.lit(width))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    chunk_by: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running values in ``order_by`` order, the current row included.

    ``nexts`` give the value of the row after, null for the last one; it must
    not be null and must grow in that order.

    ``order_by`` has to be a total order within ``keys`` and ``chunk_by`` a
    coarser version of it: sorting by chunk must never contradict sorting by
    row.  Keys and chunk columns must not be null.  ``sums`` count a null as
    0; ``mins`` carry the least value so far.
    """
    sums, mins, nexts, keys = dict(sums or {}), dict(mins or {}), dict(nexts or {}), list(keys)
    parts = [f"_chunk{i}" for i in range(len(chunk_by))]
    cut = df.withColumns(dict(zip(parts, chunk_by)))
    ordered = Window.partitionBy(*keys, *parts).orderBy(*order_by)
    inside = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns(
        {f"_in_{n}": F.sum(F.coalesce(c, F.lit(0))).over(inside) for n, c in sums.items()}
        | {f"_in_{n}": F.min(c).over(inside) for n, c in mins.items()}
        | {f"_in_{n}": F.lead(c).over(ordered) for n, c in nexts.items()}
    )
    offsets = (
        cut.groupBy(*keys, *parts)
        .agg(
            *[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()],
            *[F.min(c).alias(f"_all_{n}") for n, c in [*mins.items(), *nexts.items()]],
        )
        .select(
            *keys,
            *parts,
            *[F.sum(f"_all_{n}").over(earlier).alias(f"_pre_{n}") for n in sums],
            *[F.min(f"_all_{n}").over(earlier).alias(f"_pre_{n}") for n in mins],
            *[F.lead(f"_all_{n}").over(Window.partitionBy(*keys).orderBy(*parts)).alias(f"_pre_{n}") for n in nexts],
        )
    )
    # Never broadcast: where keys are many there are nearly as many chunks as rows.
    return local.join(offsets.hint("merge"), [*keys, *parts], "left").select(
        *df.columns,
        *[(F.col(f"_in_{n}") + F.coalesce(f"_pre_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.least(f"_in_{n}", f"_pre_{n}").alias(n) for n in mins],
        *[F.coalesce(f"_in_{n}", f"_pre_{n}").alias(n) for n in nexts],
    )


def every_step(intervals: DataFrame, first: str, until: str, name: str, width: int = STEPS) -> DataFrame:
    """A row for each whole number ``name`` from column ``first`` on, below ``until``.

    Intervals are cut at multiples of ``width`` first, so a list that is spread
    out holds the numbers of one cut, or the cuts of one interval.
    """
    kind = intervals.schema[first].dataType
    at, to = F.col(first), (F.col(until) - 1).cast(kind)
    low = (F.col("_cut") * width).cast(kind)
    kept = [c for c in intervals.columns if c not in (first, until)]
    cuts = F.sequence(F.floor(at / width), F.floor(to / width))
    steps = F.sequence(F.greatest(at, low), F.least(to, (low + width - 1).cast(kind)))
    cut = intervals.filter(at <= to).withColumn("_cut", F.explode(cuts))
    return cut.select(*kept, at.alias("_since"), F.explode(steps).alias(name))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    chunk_by: Sequence[Column],
    name: str,
) -> DataFrame:
    """Row number 1..n within ``keys``, without one task per key."""
    return running(df, keys, order_by, chunk_by, sums={name: F.lit(1).cast("bigint")})


def placed(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], name: str) -> DataFrame:
    """Row number 1..n within ``keys`` (of all rows without keys) for any total order.

    Where no coarser version of the order is at hand, the rows are sorted
    across the cluster by sampled ranges and stored; a range is as large as its
    share of the rows, whatever key or prefix they have.  What the ranges
    before amount to is one number per range, or per range and key for the keys
    that several ranges hold.
    """
    keys, order = list(keys), {f"_by{i}": c for i, c in enumerate(order_by)}
    by = [*keys, *order]
    ranged = df.withColumns(order).repartitionByRange(*by).sortWithinPartitions(*by)
    # A range's rows are numbered in their order; the number of the range stands above bit 33.
    rows = stage(ranged.withColumn("_id", F.monotonically_increasing_id()).drop(*order), "ranges")
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    if not keys:
        counts = dict(rows.groupBy("_range").count().collect())  # one row per range
        starts, total = [], 0
        for part in sorted(counts):
            starts.append((part, total))
            total += counts[part]
        before = df.sparkSession.createDataFrame(starts, "_range bigint, _before bigint")
        place = F.col("_id") - F.shiftleft("_range", 33) + F.col("_before") + 1
        return rows.join(F.broadcast(before), "_range").select(*df.columns, place.alias(name))
    groups = rows.groupBy("_range", *keys).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(
        F.col("_range").alias("_in"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_first",
        F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"),
    )
    same = F.col("_range") == F.col("_in")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    place = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return rows.join(starts, same).select(*df.columns, place.alias(name))
