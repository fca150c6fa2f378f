"""Periodic runs of words, by period octaves and tiles.

Periods are taken by octaves [2**o, 2**(o+1)).  Word i *matches* under period q
if it equals word i + q; a run of period q is a maximal stretch of matches, q
words longer.  A stretch that counts has ``need`` matches at least, so among
places ``step`` apart, with ``step + gram - 1 = need``, one, the *boundary*,
begins a gram that lies in the stretch whole.  At every boundary the Z values
for the periods of the octave (how far the words from the boundary on match
those a period later, and how far back) bound the part of the stretch within
``reach`` words: a fragment.  Two neighbouring fragments of a stretch overlap.

Documents longer than a tile are exploded into overlapping tiles, small ones
for all short periods together and larger ones for each longer octave; a tile
holds the reach around its boundaries and is solved by itself in any task.
Fragments are shuffled by (document, period) and stitched to whole stretches.
The Z values come from prefix sums of word hashes by bisection, for all
boundaries of a batch of tiles at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from touchline.llm.groups import row_key
from touchline.llm.text import SPACED, _GRAM, _power_tables, mix, slices, words_of
from touchline.sources.stage import stage

#: Words of a document that is one tile for all octaves.
TILE = 1 << 14
GRAM = 8
AT_ONCE = 1 << 20
BATCH_BYTES = 1 << 19

FRAGMENT = T.ArrayType(T.LongType(), False)
READ = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("sha", T.StringType()), T.StructField("tiled", T.BooleanType()), T.StructField("text", T.StringType()),
    T.StructField("period", FRAGMENT), T.StructField("lo", FRAGMENT), T.StructField("hi", FRAGMENT),
])
TILES = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()),
    T.StructField("at", T.LongType()), T.StructField("core_lo", T.LongType()), T.StructField("core_hi", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
FRAGMENTS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("period", T.LongType()), T.StructField("lo", T.LongType()),
    T.StructField("hi", T.LongType()),
])
COLLAPSED = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("n_dropped", T.LongType()),
    T.StructField("collapsed", T.StringType()),
])


@dataclass(frozen=True)
class Octave:
    """Periods [2**o, 2**(o+1)) of runs of at least max(least, 2 * period) words."""

    o: int
    least: int

    @property
    def periods(self) -> np.ndarray:
        return np.arange(1 << self.o, 2 << self.o)

    @property
    def need(self) -> int:
        """Matches that every run of the octave has at least."""
        return int(np.maximum(self.periods, self.least - self.periods).min())

    @property
    def gram(self) -> int:
        return min(GRAM, (self.need + 1) // 2)

    @property
    def step(self) -> int:
        return self.need - self.gram + 1

    @property
    def reach(self) -> int:
        return max(2 << self.o, self.least)

    @property
    def margin(self) -> int:
        """Words after a boundary that its fragments can touch."""
        return self.reach + (2 << self.o)


@dataclass
class Tiles:
    """Word hashes of tiles end to end; places count in the document, boundaries lie in [core_lo, core_hi)."""

    hash: np.ndarray
    first: np.ndarray  # first word of each tile, and the end
    at: np.ndarray  # its place in the document
    core_lo: np.ndarray
    core_hi: np.ndarray


def _merged(tile, period, lo, hi):
    """Fragments of one tile and period that overlap or touch, put together."""
    if not len(lo):
        return tile, period, lo, hi
    order = np.lexsort((lo, period, tile))
    tile, period, lo, hi = tile[order], period[order], lo[order], hi[order]
    turn = np.ones(len(lo), bool)
    turn[1:] = (tile[1:] != tile[:-1]) | (period[1:] != period[:-1])
    lift = (np.cumsum(turn) - 1) * (int(hi.max()) + 1)
    top = np.maximum.accumulate(hi + lift) - lift
    turn[1:] |= lo[1:] > top[:-1]
    start = np.flatnonzero(turn)
    end = np.append(start[1:], len(lo)) - 1
    return tile[start], period[start], lo[start], top[end]


class _Sums:
    """Equality of word ranges by prefix sums."""

    def __init__(self, hash_: np.ndarray):
        self.power, self.inverse = _power_tables(_GRAM, len(hash_) + 1)
        self.total = np.zeros(len(hash_) + 1, np.uint64)
        np.cumsum(hash_ * self.power[: len(hash_)], out=self.total[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - 1
        return (self.total[k:] - self.total[: n - k + 1]) * self.inverse[: n - k + 1]

    def equal(self, a: np.ndarray, gap: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a on equal those from a + gap on."""
        t = self.total
        return (t[a + size] - t[a]) * self.power[gap] == t[a + gap + size] - t[a + gap]

    def ahead(self, a, gap, known, most) -> np.ndarray:
        """Z value: greatest size up to ``most`` for which the ranges are equal."""
        lo, hi = known.copy(), most.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) // 2
            same = self.equal(a[open_], gap[open_], mid)
            lo[open_] = np.where(same, mid, lo[open_])
            hi[open_] = np.where(same, hi[open_], mid - 1)

    def back(self, a, gap, most) -> np.ndarray:
        """The same for the words that end before a and a + gap."""
        lo, hi = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) // 2
            same = self.equal(a[open_] - mid, gap[open_], mid)
            lo[open_] = np.where(same, mid, lo[open_])
            hi[open_] = np.where(same, hi[open_], mid - 1)

    def primitive(self, a: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the q words from a on are no power of fewer words."""
        good = np.ones(len(q), bool)
        rest, d = q.copy(), 2
        while len(rest) and d * d <= rest.max():
            divides = np.flatnonzero(rest % d == 0)
            if len(divides):
                part = q[divides] // d
                good[divides] &= ~self.equal(a[divides], part, q[divides] - part)
                while len(divides):
                    rest[divides] //= d
                    divides = divides[rest[divides] % d == 0]
            d += 1
        last = np.flatnonzero(rest > 1)
        part = q[last] // rest[last]
        good[last] &= ~self.equal(a[last], part, q[last] - part)
        return good


def solve(tiles: Tiles, low: int, high: int, least: int) -> tuple[np.ndarray, ...]:
    """(tile, period, lo, hi): stretches of matches, as far as each tile shows them, for octaves low <= o < high.

    Stretches of a period that is a multiple of a smaller one are left out.
    """
    n = len(tiles.hash)
    sums = _Sums(tiles.hash)
    sizes = np.diff(tiles.first)
    out = [(np.zeros(0, np.int64),) * 4]
    for o in range(low, high):
        octave = Octave(o, least)
        k, step = octave.gram, octave.step
        # Boundaries: places of the document that ``step`` divides, in the core, with room for the least period.
        begin = -(-tiles.core_lo // step) * step
        stop = np.minimum(tiles.core_hi, tiles.at + sizes - (1 << o) - k + 1)
        counts = np.maximum(-(-(stop - begin) // step), 0)
        total = int(counts.sum())
        if not total:
            continue
        tile = np.repeat(np.arange(len(sizes)), counts)
        ordinal = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        place = begin[tile] + ordinal * step - tiles.at[tile] + tiles.first[tile]
        end = tiles.first[tile + 1]
        gram = sums.grams(k)
        periods = octave.periods
        rows = max(1, AT_ONCE // len(periods))
        found = [out[0]]
        for r in range(0, total, rows):
            b = place[r: r + rows]
            other = b[:, None] + periods[None]
            match = gram[b][:, None] == gram[np.minimum(other, len(gram) - 1)]
            match &= other + k <= end[r: r + rows][:, None]
            i, j = np.nonzero(match)
            if not len(i):
                continue
            own, q = b[i], periods[j]
            t = tile[r + i]
            ahead = sums.ahead(own, q, np.full(len(q), k), np.minimum(octave.reach, end[r + i] - own - q))
            back = sums.back(own, q, np.minimum(octave.reach, own - tiles.first[t]))
            fits = np.flatnonzero(ahead + back >= np.maximum(q, least - q))
            own, q, t, ahead, back = own[fits], q[fits], t[fits], ahead[fits], back[fits]
            fits = np.flatnonzero(sums.primitive(own - back, q))
            t, q, spot = t[fits], q[fits], own[fits] - tiles.first[t[fits]] + tiles.at[t[fits]]
            found.append(_merged(t, q, spot - back[fits], spot + ahead[fits]))
        out.append(_merged(*(np.concatenate(x) for x in zip(*found))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _octaves(n: int) -> int:
    """Number of octaves with periods up to half of n words."""
    return max(0, int(n // 2).bit_length())


def _read(least: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                words = words_of(part.column(2), SPACED)
                counts = words.counts
                tiled = counts > tile
                # Words of tiled documents have no boundary here.
                whole = Tiles(words.hash, words.first, np.zeros(words.n_docs, np.int64), np.zeros(words.n_docs, np.int64), np.where(tiled, 0, counts))
                doc, period, lo, hi = solve(whole, 0, _octaves(int(counts[~tiled].max(initial=0))), least)
                order = np.argsort(doc, kind="stable")
                each = np.bincount(doc, minlength=words.n_docs)
                offsets = np.append(0, np.cumsum(each)).astype(np.int32)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[order], pa.int64()))
                raw, off = words.data.tobytes(), words.offsets.tolist()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(off, off[1:])]
                kept = tiled | (each > 0)
                text = part.column(2).take(pa.array(np.arange(len(kept)), mask=~kept))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(sha, pa.string()),
                    pa.array(tiled), text, listed(period), listed(lo), listed(hi),
                ], names=READ.names)

    return run


def tiles_of(n: int, tile: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, core_lo, core_hi) of the tiles of a document of n words."""
    octaves = _octaves(n)
    # Octaves whose margins are small against a tile share tiles; each longer one has tiles of its own.
    shared = max(0, min(octaves, (tile // 8).bit_length() - 1))
    if shared:
        yield from ((0, shared, at, min(n, at + tile)) for at in range(0, n, tile))
    for o in range(shared, octaves):
        core = max(tile, 4 << o)
        yield from ((o, o + 1, at, min(n, at + core)) for at in range(0, n, core))


def _explode(least: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                words = words_of(part.column(1), SPACED)
                n = len(words.hash)
                ids = np.unique(words.hash, return_inverse=True)[1].astype(np.int32)
                for low, high, core_lo, core_hi in tiles_of(n, tile, least):
                    last = Octave(high - 1, least)
                    at, to = max(0, core_lo - last.reach), min(n, core_hi + last.margin)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), pa.array([low], pa.int32()), pa.array([high], pa.int32()),
                        pa.array([at], pa.int64()), pa.array([core_lo], pa.int64()), pa.array([core_hi], pa.int64()),
                        pa.array([ids[at:to]], pa.list_(pa.int32())),
                    ], names=TILES.names)

    return run


def _solved(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                low, high, at, core_lo, core_hi = (batch.column(i)[row].as_py() for i in range(1, 6))
                ids = batch.column(6)[row].values.to_numpy()
                one = lambda x: np.array([x], np.int64)
                tiles = Tiles(mix(ids.astype(np.uint64) + np.uint64(1)), np.array([0, len(ids)]), one(at), one(core_lo), one(core_hi))
                _, period, lo, hi = solve(tiles, low, high, least)
                key = pa.array(np.full(len(lo), batch.column(0)[row].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([key, pa.array(period), pa.array(lo), pa.array(hi)], names=FRAGMENTS.names)

    return run


def _collapse(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, dropped, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs.as_py():
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                sha.append(hashlib.sha256(left).hexdigest()), dropped.append(int(gone.sum()))
                kept.append(left.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sha, pa.string()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()),
            ], names=COLLAPSED.names)

    return run


def stitched(fragments: DataFrame) -> DataFrame:
    """(key, period, lo, hi) with fragments that overlap or touch put together."""
    line = Window.partitionBy("key", "period").orderBy("lo", "hi")
    before = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("opens", F.when(before >= F.col("lo"), 0).otherwise(1))
    marked = marked.withColumn("part", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("key", "period", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def periodic_runs(
    docs: DataFrame, least: int = 12, tile: int = TILE, id_column: str = "doc_id", text_column: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """(doc, n_words, runs, n_dropped, sha, collapsed) for every row of ``docs``.

    Words are runs between ASCII white space, unchanged, numbered from 0.  A
    run is a stretch of words with smallest period q (words q apart are equal)
    of at least max(``least``, 2 q) words that no neighbouring word extends
    with that period.  ``runs`` lists (start, length, period), by start, then
    period.  Of each run the words after its first q are dropped; ``sha`` is
    the sha256 of the others joined by one blank, ``collapsed`` that text where
    words were dropped (null with keep_text=False).

    Null, empty and blank texts have no words and no run.  Texts of any length
    are searched whole; one of more than ``tile`` words is spread over tasks by
    tiles.  Rows with null or repeated ids are rows like others; rows equal in
    id and text get equal results.  Runs that share words, and runs that tie in
    length, are all listed.  An empty table gives an empty table; further
    columns are ignored.  Words and ranges are compared by 64-bit hashes.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc"), row_key(id_column, text_column).alias("key"),
        F.col(text_column).cast("string").alias("text"),
    )
    read = stage(source.mapInArrow(_read(least, tile), READ), "read")
    tiles = read.filter("tiled").select("key", "text").mapInArrow(_explode(least, tile), TILES)
    solved = tiles.repartition("key", "low", "at").mapInArrow(_solved(least), FRAGMENTS)
    here = read.filter("size(period) > 0").select("key", F.explode(F.arrays_zip("period", "lo", "hi")).alias("x")).select("key", "x.*")
    runs = stitched(here.unionByName(solved)).select(
        "key", F.struct(F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + F.col("period")).alias("length"), "period").alias("run"),
    )
    listed = stage(runs.groupBy("key").agg(
        F.array_sort(F.collect_list("run"), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(
            F.signum(a["period"] - b["period"])).cast("int")).alias("runs"),
    ), "runs")
    texts = read.filter("text is not null").select("key", "text").join(listed, "key").select("key", "text", "runs")
    # Rows equal in id and text share a key; one of them is enough here.
    collapsed = texts.mapInArrow(_collapse(keep_text), COLLAPSED).withColumnRenamed("sha", "left_sha")
    facts = listed.join(collapsed.dropDuplicates(["key"]), "key")
    none = F.array().cast("array<struct<start: bigint, length: bigint, period: bigint>>")
    return read.select("doc", "key", "n_words", "sha").join(facts, "key", "left").select(
        "doc", "n_words", F.coalesce("runs", none).alias("runs"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.coalesce("left_sha", "sha").alias("sha"), "collapsed",
    )
