"""Best-fit-decreasing packing of documents into sequences of fixed length.

Documents are encoded and cut into pieces no longer than a sequence.  Pieces
are dealt to tasks by a hash, each task with enough of them that its one or two
open sequences at the end do not count, and packed there: the longest piece
first, into the open sequence with the least room that still takes it.  A
segment tree over the remaining capacities finds that sequence in as many
steps as the capacity has bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.groups import runs
from touchline.llm.text import slices
from touchline.llm.tokens import tokenizer_path, word_tokenizer
from touchline.sources.stage import stage

#: Sequences a task packs on average.
BIN_SHARE = 2000

PIECES = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
PLACED = T.StructType([
    *[f for f in PIECES.fields if f.name != "ids"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


class OpenBins:
    """Segment tree over remaining capacities 0 to ``size``: how many bins have each."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = self.width + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a bin with the least room of at least ``least``: (room, bin)."""
        node, count = self.width + least, self.count
        if not count[node]:
            # Up until there is something to the right, then down to the left.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.width
        number = self.bins[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, number


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to size), best fit in falling order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = OpenBins(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            room, number = size, made
            made += 1
        else:
            room, number = found
        bins[i], offsets[i] = number, size - room
        if room > length:
            tree.add(room - length, number)
    return bins, offsets


def _pieces(path: str, size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, counts = tokenizer.encode(part.column(1))
                stop = np.cumsum(counts)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for d, (to, n) in enumerate(zip(stop.tolist(), counts.tolist())):
                    own = np.append(ids[to - n: to].astype("<u4"), np.uint32(end_id))
                    for p, at in enumerate(range(0, n + 1, size)):
                        cut = own[at: at + size]
                        doc.append(d), piece.append(p), start.append(at), length.append(len(cut))
                        crc.append(zlib.crc32(cut))
                        kept.append(cut.astype(np.int32) if keep_ids else None)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array(kept, pa.list_(pa.int32())),
                ], names=PIECES.names)

    return run


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "share"):
            bins, offsets = best_fit(part.column("length").to_numpy(), size)
            share = part.column("share").to_numpy().astype(np.int64)
            columns = [part.column(f).combine_chunks() for f in PIECES.names]
            table = pa.Table.from_arrays(
                [*columns, pa.array((share << 32) + bins), pa.array(offsets)], names=PLACED.names,
            )
            yield from table.to_batches()

    return run


def pack(
    docs: DataFrame, size: int = 4096, id_column: str = "doc_id", text_column: str = "text",
    path: str | None = None, end_id: int = 1, keep_ids: bool = True,
) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, ids, sequence_id, offset), one row per piece.

    A document is its ids and ``end_id``; only longer ones than ``size`` are
    cut.  ``ids`` are the piece's ids (null with keep_ids=False) and
    ``ids_crc32`` is the crc32 of them as little-endian 32-bit integers.
    ``offset`` is the place in the sequence, gapless from 0.

    A null or empty text is the end id alone.  Rows with null or repeated ids
    are documents of their own.  Equal lengths are taken in any order; all
    pieces are placed.  An empty table gives an empty table; further columns
    are ignored.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    pieces = stage(source.mapInArrow(_pieces(path or tokenizer_path(), size, end_id, keep_ids), PIECES), "pieces")
    total = pieces.agg(F.sum("length")).head()[0] or 0
    shares = max(1, round(total / size / BIN_SHARE))
    spread = F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(shares)).cast("long").alias("share")
    return (
        pieces.select("*", spread).repartition("share").sortWithinPartitions("share", "doc", "piece", "ids_crc32")
        .mapInArrow(_pack(size), PLACED)
    )
