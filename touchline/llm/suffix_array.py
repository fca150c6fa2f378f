"""Suffix-array dedup over suffixes at minimiser positions.

Only suffixes that begin at a content-selected k-gram (the minimiser of a
window) are kept, some 2 in every length - k + 2.  Equal ones are added up, and
the distinct ones are sorted across the cluster by range, first by the k words
they begin with, then by the words around them; a suffix and its neighbour in
that order are compared, and runs of neighbours that share k words in two
documents are kept.  Matches of a run
are then extended to the left and right, up to the windows they fill.  Sorting
streams through a task, which holds two suffixes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.repeats import Shape, cut_repeats
from touchline.sources.stage import stage

CLASSES = T.StructType([
    T.StructField("seed", T.LongType()), T.StructField("context", T.LongType()), T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()), T.StructField("place", T.IntegerType()),
])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes that two documents have or that have a neighbour with the same k words.

    Rows come sorted by (seed, context), each pair once; the last one and
    whether its run has others are carried from batch to batch.  A run may go
    on in the ranges beside: the first and the last row are always kept.
    """
    carry, run_open = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        seed, _, low, high, _ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        same = seed[1:] == seed[:-1]
        beside = np.zeros(len(seed), bool)
        beside[1:] |= same
        beside[:-1] |= same
        beside[0] |= run_open
        # All but the last are settled; its run may go on in the next batch.
        yield batch.slice(0, len(seed) - 1).filter(pa.array((beside | (low < high))[:-1]))
        carry = batch.slice(len(seed) - 1)
        run_open = bool(same[-1]) if len(same) else run_open
    if carry is not None:
        yield carry


def _suffixes(spread: DataFrame) -> DataFrame:
    """Distinct suffixes, added up before they are shuffled, sorted across the cluster."""
    distinct = spread.groupBy("seed", "context").agg(
        F.min(F.struct("doc", "place")).alias("first"), F.max("doc").alias("high"),
    ).select("seed", "context", F.col("first.doc").alias("low"), "high", F.col("first.place").alias("place"))
    return distinct.repartitionByRange("seed", "context").sortWithinPartitions("seed", "context")


def _sorted(spread: DataFrame) -> DataFrame:
    classes = stage(_suffixes(spread).mapInArrow(_neighbours, CLASSES), "neighbours")
    # A short table says which runs span two documents; it joins the parts of a run.
    runs = classes.groupBy("seed").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("n"))
    return classes.join(runs.filter("a < b").select("seed", (F.col("n") > 1).alias("several")), "seed").drop("seed")


def suffix_dedup(
    docs: DataFrame, length: int = 50, k: int = 12, id_column: str = "doc_id", text_column: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """(doc, key, n_words, n_removed, sha, begin, end, kept) for every row of ``docs``.

    Words are runs between ASCII white space, unchanged.  Matches of at least
    ``length`` words between documents are found; a word in such a match is
    removed unless its document has the least id of those that hold the words.
    ``begin`` and ``end`` are the removed word ranges (half open), ``kept`` the
    other words joined by one blank where words were removed.

    Null and empty texts have no suffixes; texts shorter than ``length`` lose
    nothing.  Rows with a null id lose nothing and are no one's source, rows
    that share an id are no source for one another, and repeats inside one
    document stay.  An empty table gives an empty table; further columns are
    ignored.  Words and word sequences are known by 64-bit hashes.
    """
    return cut_repeats(docs, _sorted, Shape(length, k), id_column, text_column, keep_text)
