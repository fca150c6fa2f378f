"""Groups of spelling variants by an index of variable-length grams.

Words are near if one inserted, deleted or replaced code point makes one of the
other.  Grams have QMIN code points at least and grow while they are frequent:
the dictionary holds the grams that more than a threshold of places in all
words show, and a gram at a place is extended for as long as the dictionary has
it.  A word is decomposed into the grams of its places, less those that lie in
an earlier one.

An edit at place i can only touch grams that lie within ``top - 1`` places of
it, where ``top`` is the greatest length of a gram; the most grams that one edit
can touch is the word's affected-gram bound.  Of bound + 1 grams of a word at
least one is a gram of every near word too, at the same place or one later.  So
a word looks into the lists of bound + 1 of its grams only.  An edit that spares
a gram also spares all text to its left or all text to its right; a list is
merged by both texts, which is why grams in the middle of a word ask first, and
what the merge gives is verified.  ``top`` is small enough, against the length of the
shorter word, for a word to have more grams than its bound: words of length c
meet those of length c and c + 1 in a class of their own, with its own ``top``.

The threshold rises with the places counted, so the dictionary that is sent to
every task has at most DICTIONARY grams of each length.  Lists longer than a
block are cut into blocks, and pairs of blocks are the units of work.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.groups import small
from touchline.llm.text import LOWER, buffers, mix
from touchline.sources.stage import stage

QMIN, QMAX = 2, 6
DICTIONARY = 1 << 16
FREQUENT = 64
BLOCK = 2048
#: Words of up to so many code points are compared as rows of a matrix.
WIDE = 32
LEFT, RIGHT, BOTH = 1, 2, 3
PAIRS_AT_ONCE = 1 << 19
PIECE = 4 << 20
KEPT_WORDS = 1 << 18

#: Runs of a-z and U+00C0 to U+00FF in UTF-8, and a byte that is in none, whatever its case.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
BETWEEN = re.compile(rb"[^A-Za-z\x80-\xff]")
LOWER_BYTES = LOWER.tobytes()

COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
GRAMS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("places", T.LongType())])
LISTED = T.StructType([
    T.StructField("list", T.LongType()), T.StructField("asks", T.BooleanType()), T.StructField("word", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("sides", T.IntegerType()), T.StructField("begin", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
NEAR = T.StructType([
    T.StructField("a", T.StringType()), T.StructField("n_a", T.LongType()), T.StructField("b", T.StringType()),
    T.StructField("n_b", T.LongType()),
])


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that cut no word."""
    at = 0
    while len(raw) - at > PIECE:
        cut = BETWEEN.search(raw, at + PIECE)
        if cut is None:
            break
        yield raw[at: cut.start()]
        at = cut.start()
    yield raw[at:]


def _counted(least: int, spell: Callable[[int, bytes], bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            words = [w.decode() for w in seen]
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())], names=COUNTS.names)
            seen.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc}:".encode()) if doc is not None else None
                for piece in _pieces(text.as_buffer().to_pybytes()):
                    for word, n in Counter(RUN.findall(piece.translate(LOWER_BYTES))).items():
                        if len(word) < least:
                            continue
                        if spell is not None and start is not None:
                            word = spell(zlib.crc32(word, start), word)
                        seen[word] += n
                if len(seen) >= KEPT_WORDS:
                    yield out()
        if seen:
            yield out()

    return run


def count_words(
    docs: DataFrame, least: int = 7, id_column: str = "doc_id", text_column: str = "text",
    spell: Callable[[int, bytes], bytes] | None = None,
) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, and their number in all texts.

    ``spell`` may change a run; it gets the crc32 of ``<id>:<run>`` and the run
    in UTF-8.  Words of fewer than ``least`` code points are left out.  Counts
    are added up in every task before they are shuffled.
    """
    source = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return source.mapInArrow(_counted(least, spell), COUNTS).filter(F.length("word") >= least).groupBy("word").agg(
        F.sum("n").alias("n"),
    )


def top(length: int) -> int:
    """Greatest length of a gram in the class whose shorter words have ``length`` code points."""
    return max(QMIN, min(QMAX, (length - 1) // 2))


def letters(words: list[str], width: int) -> np.ndarray:
    """Code points of words of ``width`` code points, one row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), width)


def packed(rows: np.ndarray, size: int) -> np.ndarray:
    """The gram of ``size`` code points at every place of every row, with its size, as one number."""
    places = rows.shape[1] - size + 1
    out = np.full((len(rows), max(places, 0)), size, np.int64)
    for i in range(size):
        out <<= 8
        out |= rows[:, i: i + places]
    return out


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    return {int(sizes[part[0]]): part for part in np.split(order, cuts) if len(part)}


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        parts = []
        for length, rows in _by_length(words).items():
            matrix = letters([words[i] for i in rows], length)
            parts += [packed(matrix, size).ravel() for size in range(QMIN, min(QMAX, length) + 1)]
        if parts:
            gram, places = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(places.astype(np.int64))], names=GRAMS.names)


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, size: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """Frequent grams, sorted, and how many places show them.

    A gram is frequent if more than ``frequent`` places show it and more than
    one in ``size`` of all places, so no length has more than ``size`` of them.
    """
    places = words.agg(F.sum(F.length("word") - QMIN + 1)).head()[0] or 0
    counts = words.select("word").mapInArrow(_gram_counts, GRAMS).groupBy("gram").agg(F.sum("places").alias("places"))
    table = counts.filter(F.col("places") > max(frequent, places // size)).orderBy("gram").toArrow()
    return table.column("gram").to_numpy(), table.column("places").to_numpy()


def decompose(rows: np.ndarray, most: int, known: np.ndarray, counts: np.ndarray):
    """Size, whether kept, packed gram and its count (0 for rare ones) at every place of words of one length."""
    places = rows.shape[1] - QMIN + 1
    size = np.full((len(rows), places), QMIN)
    gram = packed(rows, QMIN)
    growing = np.ones(size.shape, bool)
    count = np.zeros(size.shape, np.int64)
    for now in range(QMIN, most + 1):
        spot = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
        common = growing & (known[spot] == gram) if len(known) else np.zeros(size.shape, bool)
        count[growing] = 0
        if len(known):
            count[common] = counts[spot[common]]
        if now == most:
            break
        longer = packed(rows, now + 1)
        growing = common
        growing[:, longer.shape[1]:] = False
        part = growing[:, : longer.shape[1]]
        gram[:, : longer.shape[1]][part] = longer[part]
        size[part.nonzero()] = now + 1
    end = np.arange(places) + size
    before = np.zeros_like(end)
    before[:, 1:] = np.maximum.accumulate(end, 1)[:, :-1]
    return size, end > before, gram, count


def affected(size: np.ndarray, kept: np.ndarray, length: int, most: int) -> np.ndarray:
    """Most grams of each word that one edit can touch."""
    place = np.arange(size.shape[1])
    last = place + size - 1
    out = np.zeros(len(size), np.int64)
    for i in range(length):
        out = np.maximum(out, (kept & (place >= i - most + 1) & (last <= i + most - 1)).sum(1))
    return out


def _lists(class_: int, kind: int, gram: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Number of the list of a gram at a place; kind 1 holds words longer by one."""
    where = mix((place * 2 + kind).astype(np.uint64) + np.uint64(class_ << 20))
    return mix(gram.view(np.uint64) + where).view(np.int64)


def _listed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 16384):
                part = batch.slice(at, 16384)
                words = part.column(0).to_pylist()
                made = []

                def put(keys, row, asking, sides, begin, end):
                    made.append((keys, np.full(len(keys), asking), row, np.full(len(keys), sides, np.int32), begin.astype(np.int32), end.astype(np.int32)))

                for length, own in _by_length(words).items():
                    matrix = letters([words[i] for i in own], length)
                    size, kept, gram, count = decompose(matrix, top(length), known, counts)
                    i, p = np.nonzero(kept)
                    put(_lists(length, 0, gram[i, p], p), own[i], False, BOTH, p, p + size[i, p])
                    # One gram more than an edit can touch asks: first those with most text on either side, then rare ones.
                    place = np.arange(size.shape[1])
                    known_text = np.minimum(place + size, length - place)
                    order = np.lexsort((np.broadcast_to(place, size.shape), count, -known_text, ~kept), axis=1)
                    asked = np.arange(size.shape[1])[None] < np.minimum(affected(size, kept, length, top(length)) + 1, kept.sum(1))[:, None]
                    i, j = np.nonzero(asked)
                    p = order[i, j]
                    end = p + size[i, p]
                    put(_lists(length, 0, gram[i, p], p), own[i], True, BOTH, p, end)
                    # A longer word has the gram at its place if the edit is to its right, else one place later.
                    put(_lists(length, 1, gram[i, p], p), own[i], True, LEFT, p, end)
                    put(_lists(length, 1, gram[i, p], p + 1), own[i], True, RIGHT, p, end)
                    if top(length - 1) != top(length):
                        size, kept, gram, count = decompose(matrix, top(length - 1), known, counts)
                    i, p = np.nonzero(kept)
                    put(_lists(length - 1, 1, gram[i, p], p), own[i], False, BOTH, p, p + size[i, p])
                if made:
                    keys, asks, row, sides, begin, end = (np.concatenate(x) for x in zip(*made))
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys), pa.array(asks), part.column(0).take(row), part.column(1).take(row),
                        pa.array(sides), pa.array(begin), pa.array(end),
                    ], names=LISTED.names)

    return run


def near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the rows of a (not the longer) and b, filled up with zeros, differ by exactly one edit."""
    place = np.arange(a.shape[1])
    inside = place[None] < size_a[:, None]
    same = (a == b) | ~inside
    out = (size_a == size_b) & ((~same).sum(1) == 1)
    longer = np.flatnonzero(size_b == size_a + 1)
    if len(longer):
        head = np.where(same[longer].all(1), size_a[longer], (~same[longer]).argmax(1))
        moved = np.zeros_like(b[longer])
        moved[:, :-1] = b[longer][:, 1:]
        # All places from the end of the common head on must agree with the next one of b.
        out[longer] = ((a[longer] == moved) | ~inside[longer] | (place[None] < head[:, None])).all(1)
    return out


def _one_edit(a: str, b: str) -> bool:
    """The same for two long words."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[head + 1:] == b[head + 1:] and a != b if len(a) == len(b) else len(b) == len(a) + 1 and a[head:] == b[head + 1:]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows sorted by their first column that cut no run of equal values."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        work = table.column(0).to_numpy()
        begin = int(np.searchsorted(work, work[-1], "left"))
        if begin:
            yield table.slice(0, begin)
        held = table.slice(begin)
    if held is not None:
        yield held


def spread(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first code points of each word, filled up with zeros, as rows of at most ``width``, and the words' lengths."""
    data, offsets = buffers(column)
    lead = (data == 0xC2) | (data == 0xC3)
    value = data.copy()
    value[1:][lead[:-1] & (data[:-1] == 0xC3)] += 0x40
    ends = np.append(0, np.cumsum(~lead))[offsets]
    size = np.diff(ends)
    value = value[~lead]
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(value)) - ends[row]
    out = np.zeros((len(size), int(min(size.max(initial=0), width))), np.uint8)
    inside = place < out.shape[1]
    out[row[inside], place[inside]] = value[inside]
    return out, size


def _texts(words: pa.Array, matrix: np.ndarray, size: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Hashes of each word, of its text to the left of ``begin`` and of that to the right of ``end``."""
    width = matrix.shape[1]
    row = np.arange(len(words))
    values = np.where(np.arange(width)[None] < size[:, None], matrix.astype(np.uint64) + np.uint64(1), np.uint64(0))
    sums = np.zeros((len(words), width + 1), np.uint64)
    np.cumsum(values * mix(np.arange(width, dtype=np.uint64) + np.uint64(1)), 1, out=sums[:, 1:])
    whole, left = sums[:, -1].copy(), sums[row, np.minimum(begin, width)]
    from_end = np.maximum(size[:, None] - np.arange(width)[None], 0).astype(np.uint64)
    np.cumsum((values * mix(from_end))[:, ::-1], 1, out=sums[:, 1:])
    right = sums[row, np.maximum(width - end, 0)]
    for i in np.flatnonzero(size > width).tolist():
        own = np.frombuffer(words[i].as_py().encode("latin-1"), np.uint8).astype(np.uint64) + np.uint64(1)
        place = np.arange(len(own), dtype=np.uint64)
        whole[i] = (own * mix(place + np.uint64(1))).sum()
        left[i] = (own * mix(place + np.uint64(1)))[: begin[i]].sum()
        right[i] = (own * mix(np.uint64(len(own)) - place))[end[i]:].sum()
    return mix(whole), left, right


def _signs(matrix: np.ndarray) -> np.ndarray:
    """The set of letters of each row, as bits of their low six bits; one edit changes two at most."""
    bits = np.where(matrix > 0, np.uint64(1) << (matrix & 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of every work unit; rows come sorted by work.

    Words that ask meet those in their list that have the same text to the left
    of the gram, or to its right.  Of words of equal length, which both ask, the
    one with the smaller hash does.
    """
    low = np.uint64((1 << 24) - 1)
    for table in _whole(batches):
        work, asks, n, sides, begin, end = (table.column(i).to_numpy() for i in (0, 1, 3, 4, 5, 6))
        names = table.column(2).combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        matrix, size = spread(names, WIDE)
        signs = _signs(matrix)
        member = np.flatnonzero(~asks)
        whole, *texts = _texts(names, matrix, size, begin, end)
        rank = whole >> np.uint64(40)
        for side, text in zip((LEFT, RIGHT), texts):
            key = mix(text + mix(work.view(np.uint64) + np.uint64(side))) & ~low
            order = member[np.argsort(key[member] | rank[member])]
            sorted_ = key[order] | rank[order]
            asker = np.flatnonzero(asks & ((sides & side) > 0))
            first = np.searchsorted(sorted_, key[asker] | np.where(sides[asker] == BOTH, rank[asker], np.uint64(0)), "left")
            counts = np.searchsorted(sorted_, key[asker] | low, "right") - first
            total = np.append(0, np.cumsum(counts))
            at = 0
            while at < len(asker):
                to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, "right")) - 1)
                a = np.repeat(asker[at:to], counts[at:to])
                b = order[np.arange(len(a)) + np.repeat(first[at:to] - total[at:to] + total[at], counts[at:to])]
                at = to
                wide = (size[a] <= WIDE) & (size[b] <= WIDE)
                alike = wide & (np.bitwise_count(signs[a] ^ signs[b]) <= 2)
                x, y = a[alike], b[alike]
                good = near(matrix[x], matrix[y], size[x], size[y])
                i, j = x[good], y[good]
                rest = [(k, m) for k, m in zip(a[~wide].tolist(), b[~wide].tolist()) if _one_edit(names[k].as_py(), names[m].as_py())]
                if rest:
                    i, j = (np.append(u, v) for u, v in zip((i, j), np.array(rest).T))
                if len(i):
                    yield pa.RecordBatch.from_arrays([
                        names.take(pa.array(i)), pa.array(n[i]), names.take(pa.array(j)), pa.array(n[j]),
                    ], names=NEAR.names)


def near_words(words: DataFrame, block: int = BLOCK, frequent: int = FREQUENT, size: int = DICTIONARY) -> DataFrame:
    """(a, n_a, b, n_b): near words among the distinct ones of (word, n), each pair once or more often."""
    sent = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, frequent, size))
    listed = stage(words.select("word", "n").mapInArrow(_listed(sent), LISTED), "lists")
    sizes = listed.groupBy("list").agg(
        F.count_if(~F.col("asks")).alias("members"), F.count_if("asks").alias("askers"),
    ).filter((F.col("members") > block) | (F.col("askers") > block))
    long_ = small(stage(sizes.select(
        "list", F.ceil(F.col("members") / block).cast("int").alias("i_n"), F.ceil(F.col("askers") / block).cast("int").alias("j_n"),
    ).filter("i_n > 0 and j_n > 0"), "long"))
    # A row of a long list stands in all units of its own block, row or column of the grid.
    cut = listed.join(long_, "list", "left").withColumn("own", F.xxhash64("word"))
    unit = F.when(F.col("i_n").isNull(), F.array("list")).otherwise(F.expr("""
        if(asks, transform(sequence(0, i_n - 1), i -> xxhash64(list, i, cast(pmod(own, j_n) as int))),
          transform(sequence(0, j_n - 1), j -> xxhash64(list, cast(pmod(own, i_n) as int), j)))
    """))
    work = cut.select(F.explode(unit).alias("work"), "asks", "word", "n", "sides", "begin", "end")
    return work.repartition("work").sortWithinPartitions("work").mapInArrow(_verified, NEAR)


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that (word, form) lead to from each word that has a form.

    A form is more frequent than its word, so the lines have an end.  Each
    round doubles the steps taken.
    """
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = roots.join(ahead, "root", "left")
        roots = stage(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "roots")
        if roots.filter("went").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 10, **parameters: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of (word, n).

    Two words are near if they differ by exactly one inserted, deleted or
    replaced code point.  ``form`` is the near word of largest n (of ties the
    smallest in code-point order) if that n is at least ``ratio`` (over 1)
    times the word's; else it is null.  ``root`` is the last word that forms
    lead to, the word itself if it has none.

    Words are of code points U+0001 to U+00FF, of any length from 5 on, given
    once each; shorter ones have no gram that an edit must spare.  Rows with
    null words or counts are left out.  Words without a near one come back with
    n_near 0.  No word gives an empty table; further columns are ignored.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words")
    known = stage(words.filter("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(known, **parameters)
    both = stage(pairs, "near")
    both = both.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionAll(
        both.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")),
    )
    # Lists may show a pair several times; words once together are not moved again.
    single = both.repartition("word").groupBy("word", "other").agg(F.first("n_other").alias("n_other"))
    facts = single.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("form"))).alias("best"),
    )
    rows = stage(known.join(facts, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.n") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.n")).alias("n"))).alias("to"),
    ).select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.n").alias("form_n")), "forms")
    roots = followed(rows.filter("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
