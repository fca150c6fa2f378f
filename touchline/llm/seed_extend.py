"""Substring dedup by seed and extend.

Winnowed anchors of all documents are joined; an anchor that two documents have
is a seed.  A seed is extended both ways: first to the whole context that a
window around it can hold, which settles all places with equal contexts at
once, then, where contexts differ, window by window.  Windows that overlap or
touch make the maximal repeats that are cut out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.repeats import Shape, cut_repeats
from touchline.sources.stage import stage


def _joined(spread: DataFrame) -> DataFrame:
    """Classes of equal contexts of seeds that two documents have, by joins."""
    contexts = stage(
        spread.groupBy("seed", "context").agg(
            F.min(F.struct("doc", "place")).alias("first"), F.max("doc").alias("high"),
        ).select("seed", "context", F.col("first.doc").alias("low"), "high", F.col("first.place").alias("place")),
        "contexts",
    )
    shared = stage(
        contexts.groupBy("seed").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("n"))
        .filter("a < b").select("seed", (F.col("n") > 1).alias("several")),
        "shared",
    )
    return contexts.join(shared, "seed").drop("seed")


def seed_and_extend(
    docs: DataFrame, length: int = 50, k: int = 20, id_column: str = "doc_id", text_column: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """(doc, key, n_words, n_removed, sha, begin, end, kept) for every row of ``docs``.

    Words are runs between ASCII white space, unchanged.  A word is removed if
    a window of ``length`` words covers it whose words also stand, in a row, in
    a document with a smaller id.  ``begin`` and ``end`` are the removed word
    ranges (half open), ``sha`` is the sha256 of the kept words joined by one
    blank, ``kept`` that text where words were removed (null on keep_text=False).

    Null and empty texts have no words; texts shorter than a window lose none.
    Rows with a null id lose nothing and are no one's source.  Rows that share
    an id are no source for one another.  Repeats inside one document stay.
    An empty table gives an empty table; further columns are ignored.  Words
    and word sequences are known by 64-bit hashes.
    """
    return cut_repeats(docs, _joined, Shape(length, k), id_column, text_column, keep_text)
