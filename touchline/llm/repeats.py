"""Windows of words that also stand in an earlier document: steps shared by two operators.

Anchors.  Among the ``width`` k-grams of a window of ``length`` words, the one
with the least hash (the first of them) is the window's anchor, so equal
windows have their anchor at the same offset, and every window has one.  The
context of an anchor is all words that a window with this anchor can hold, up
to the ends of the text.

Two places with the same context have the same windows, so a class of equal
contexts is settled once: all its documents but the first repeat it whole.
Only where one anchor has several contexts are the windows of one place per
context formed, and a window belongs to the least document that has it.
Neither step forms pairs, and each is a grouping that is added up before it is
shuffled.  What is repeated is brought back to the texts as (place, mask of
window offsets).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.groups import flat
from touchline.llm.text import SPACED, Words, _GRAM, _power_tables, lists, mix, slices, sliding_min, words_of
from touchline.sources.stage import stage

PLACE_BITS = 24
PIECE_GRAMS = 1 << PLACE_BITS

SEEDS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("sha", T.StringType()), T.StructField("seeds", T.ArrayType(T.LongType(), False)),
    T.StructField("contexts", T.ArrayType(T.LongType(), False)), T.StructField("places", T.ArrayType(T.IntegerType(), False)),
])
WINDOWS = T.StructType([
    T.StructField("window", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("context", T.LongType()),
    T.StructField("offset", T.IntegerType()),
])
CUT = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("sha", T.StringType()),
    T.StructField("begin", T.ArrayType(T.IntegerType(), False)), T.StructField("end", T.ArrayType(T.IntegerType(), False)),
    T.StructField("kept", T.StringType()),
])


class Shape:
    """Window of ``length`` words, anchors of ``k`` words."""

    def __init__(self, length: int, k: int):
        if not 0 < k <= length or length - k > 61:
            raise ValueError("anchors must fit into the window, with at most 62 offsets")
        self.length, self.k, self.width = length, k, length - k + 1

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each k-gram, first words of windows, and their anchors."""
        gram = words.grams(self.k)
        low = np.uint64((1 << PLACE_BITS) - 1)
        place = np.zeros(max(len(gram) - self.width + 1, 0), np.int64)
        # Places are packed into the low bits, counted in pieces that overlap by a window.
        for at in range(0, len(place), PIECE_GRAMS - self.width + 1):
            piece = gram[at: at + PIECE_GRAMS]
            least = sliding_min((piece & ~low) | np.arange(len(piece), dtype=np.uint64), self.width)
            place[at: at + len(least)] = (least & low).astype(np.int64) + at
        starts = np.flatnonzero(words.valid(self.length)[: len(place)])
        return gram, starts, place[starts]

    def contexts(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Hash of the words around each anchor that its windows can hold."""
        n = len(words.hash)
        power, inverse = _power_tables(_GRAM, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * power[:n], out=total[1:])
        doc = np.searchsorted(words.first, at, "right") - 1
        low = np.maximum(at - self.width + 1, words.first[doc])
        high = np.minimum(at + self.length, words.first[doc + 1])
        ends = ((at - low) * 1024 + (high - at)).astype(np.uint64)
        return mix(mix((total[high] - total[low]) * inverse[low]) ^ mix(ends + np.uint64(1)))


def _seeds(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(2), SPACED)
                gram, _, anchors = shape.anchors(words)
                at = np.unique(anchors)
                doc = np.searchsorted(words.first, at, "right") - 1
                counts = np.bincount(doc, minlength=words.n_docs) if len(at) else np.zeros(words.n_docs, np.int64)
                raw, off = words.data.tobytes(), words.offsets.tolist()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(words.counts, pa.int64()), pa.array(sha, pa.string()),
                    lists(gram[at].view(np.int64), counts, pa.int64()),
                    lists(shape.contexts(words, at).view(np.int64), counts, pa.int64()),
                    lists(at - words.first[doc], counts, pa.int32()),
                ], names=SEEDS.names)

    return run


def _listed(shape: Shape, part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the word, context and mask of every listed place that is true of its text.

    Lists are kept by id; of texts that share an id each takes what holds for it.
    """
    words = words_of(part.column(2), SPACED)
    place, first = flat(part.column(3))
    context, _ = flat(part.column(4))
    mask, _ = flat(part.column(5))
    doc = np.repeat(np.arange(words.n_docs), np.diff(first))
    at = words.first[doc] + place
    ok = at + shape.k <= words.first[doc + 1]
    at, context, mask = at[ok], context[ok], mask[ok]
    true = shape.contexts(words, at).view(np.int64) == context
    return words, at[true], context[true], mask[true]


def _windows(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, at, context, _ = _listed(shape, part)
                _, starts, anchors = shape.anchors(words)
                order = np.argsort(at, kind="stable")
                at, context = at[order], context[order]
                spot = np.searchsorted(at, anchors)
                hit = spot < len(at)
                hit[hit] = at[spot[hit]] == anchors[hit]
                starts, anchors, spot = starts[hit], anchors[hit], spot[hit]
                doc = np.searchsorted(words.first, starts, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(words.grams(shape.length)[starts].view(np.int64)), part.column(0).take(pa.array(doc)),
                    pa.array(context[spot]), pa.array((anchors - starts).astype(np.int32)),
                ], names=WINDOWS.names)

    return run


def _cut(shape: Shape, keep_text: bool):
    bits = np.arange(shape.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, at, _, mask = _listed(shape, part)
                # A place has an offset only if the window's anchor is there.
                _, starts, anchors = shape.anchors(words)
                own = np.zeros(len(words.hash), np.int64)
                np.bitwise_or.at(own, at, mask)
                hit = (own[anchors] >> (anchors - starts)) & 1 == 1
                edge = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(edge, starts[hit], 1)
                np.add.at(edge, starts[hit] + shape.length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw, off = words.data.tobytes(), words.offsets.tolist()
                removed, sha, begin, end, kept = [], [], [], [], []
                for d in range(words.n_docs):
                    own_gone = gone[words.first[d]: words.first[d + 1]]
                    turns = np.flatnonzero(np.diff(own_gone.astype(np.int8), prepend=0, append=0))
                    begin.append(turns[0::2].tolist()), end.append(turns[1::2].tolist())
                    every, pieces, last = raw[off[d]: off[d + 1]].split(), [], 0
                    for a, b in zip(begin[-1], end[-1]):
                        pieces += every[last:a]
                        last = b
                    text = b" ".join([*pieces, *every[last:]])
                    removed.append(int(own_gone.sum())), sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if keep_text else None)
                yield pa.RecordBatch.from_arrays([
                    part.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                    pa.array(begin, pa.list_(pa.int32())), pa.array(end, pa.list_(pa.int32())),
                    pa.array(kept, pa.string()),
                ], names=CUT.names)

    return run


def _with_lists(source: DataFrame, places: DataFrame) -> DataFrame:
    """Texts with the lists (place, context, mask) of their ids."""
    listed = places.groupBy("doc").agg(F.collect_list(F.struct("place", "context", "mask")).alias("x"))
    return source.join(listed, "doc").select("doc", "key", "text", "x.place", "x.context", "x.mask")


def cut_repeats(
    docs: DataFrame, classes_of: Callable[[DataFrame], DataFrame], shape: Shape, id_column: str, text_column: str,
    keep_text: bool,
) -> DataFrame:
    """(doc, key, n_words, n_removed, sha, begin, end, kept) for every row of ``docs``.

    ``classes_of`` makes of (seed, context, doc, place) the classes of contexts
    whose seed stands in two documents at least: (context, low, high, place,
    several), with the least and greatest document, a place in the least one,
    and whether the seed has several contexts.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text"),
    ).select("doc", F.xxhash64("doc", "text").alias("key"), "text")
    seeds = stage(source.mapInArrow(_seeds(shape), SEEDS), "seeds")
    spread = seeds.filter("doc is not null").select(
        "doc", F.explode(F.arrays_zip("seeds", "contexts", "places")).alias("x"),
    ).select("doc", F.col("x.seeds").alias("seed"), F.col("x.contexts").alias("context"), F.col("x.places").alias("place"))
    classes = stage(classes_of(spread), "classes")
    # Partial repeats: windows of one place per context.
    partial = classes.filter("several").select(F.col("low").alias("doc"), "place", "context", F.lit(0).cast("long").alias("mask"))
    windows = stage(_with_lists(source, partial).mapInArrow(_windows(shape), WINDOWS), "windows")
    owners = stage(
        windows.groupBy("window").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
        .select("window", "owner"),
        "owners",
    )
    masks = (
        windows.join(owners, "window").filter("doc > owner").groupBy("context")
        .agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
    )
    all_bits = F.lit((1 << shape.width) - 1).cast("long")
    known = stage(
        classes.join(masks, "context", "left").filter("mask is not null or low < high")
        .select("context", "low", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")),
        "known",
    )
    marks = spread.join(known, "context").select(
        "doc", "place", "context", F.when(F.col("doc") > F.col("low"), all_bits).otherwise(F.col("mask")).alias("mask"),
    ).filter("mask <> 0")
    cut = _with_lists(source, marks).mapInArrow(_cut(shape, keep_text), CUT).dropDuplicates(["key"])
    cut = cut.withColumnRenamed("sha", "cut_sha")
    none = F.array().cast("array<int>")
    return seeds.select("doc", "key", "n_words", "sha").join(cut, "key", "left").select(
        "doc", "key", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha", "sha").alias("sha"), F.coalesce("begin", none).alias("begin"),
        F.coalesce("end", none).alias("end"), "kept",
    )


def without_repeats(docs: DataFrame, cut: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``docs`` with the kept words of texts that lost some; other texts as they are."""
    changed = cut.filter("n_removed > 0").select(F.col("key").alias("key_"), F.col("kept").alias("kept_")).dropDuplicates(["key_"])
    rows = docs.select(
        F.xxhash64(F.col(id_column).cast("long"), F.col(text_column).cast("string")).alias("key_"),
        F.struct(*docs.columns).alias("row_"),
    )
    return rows.join(changed, "key_", "left").select(*[
        F.coalesce("kept_", F.col("row_")[c]).alias(c) if c == text_column else F.col("row_")[c].alias(c) for c in docs.columns
    ])
