"""Benchmark decontamination with an Aho-Corasick automaton.

Words of test items and texts are brought to one form: A-Z lower-cased, all
ASCII that is neither letter nor digit a separator.  Every window of ``window``
item words (a shorter item is one window) is a phrase of the automaton, with a
blank on both sides, and every text is scanned once.  Places of hits are mapped
back to words, and from there to bytes of the original text.

The benchmark's bytes are summed first.  Up to GROUP_BYTES of items make one
automaton that is sent to the tasks; a larger benchmark is dealt into groups of
that size, and the texts are scanned once per group, each scan a stored step.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.text import ALNUM, NORMAL, buffers, words_of
from touchline.sources.stage import stage

# Ten overlapping windows a word and some 30 bytes a node: about 300 MB a MB.
GROUP_BYTES = 1 << 20

HITS = [
    T.StructField("n_words", T.LongType()), T.StructField("begin", T.ArrayType(T.IntegerType(), False)),
    T.StructField("end", T.ArrayType(T.IntegerType(), False)), T.StructField("items", T.ArrayType(T.LongType(), False)),
]


def phrases(items: list[tuple[int, str | None]], window: int) -> dict[bytes, list[int]]:
    """Item ids by the phrase of each window."""
    found: dict[bytes, set[int]] = {}
    for item, text in items:
        words = (text or "").encode().translate(NORMAL).split()
        for at in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[at: at + window]) + b" ", set()).add(item)
    return {phrase: sorted(ids) for phrase, ids in found.items()}


def automaton(items: list[tuple[int, str | None]], window: int):
    """Automaton of the items' phrases, each with its words and items; None without any."""
    made = phrases(items, window)
    if not made:
        return None
    machine = ahocorasick.Automaton()
    for phrase, ids in made.items():
        machine.add_word(phrase.decode("latin-1"), (phrase.count(b" ") - 1, ids))
    machine.make_automaton()
    return machine


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, half open ranges without overlap; touching ones become one."""
    merged: list[list[int]] = []
    for at, to in sorted(ranges):
        if merged and at <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], to)
        else:
            merged.append([at, to])
    return [(a, b) for a, b in merged]


def scan(text: bytes, machine) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit word ranges and items of one text."""
    words = text.translate(NORMAL).split()
    if not words or machine is None:
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    ranges, items = [], set()
    blanks = None
    for last, (n, ids) in machine.iter(line.decode("latin-1")):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        stop = int(np.searchsorted(blanks, last))  # words before this blank
        items.update(ids)
        ranges.append((stop - n, stop))
    return len(words), merge(ranges), items


def _scanner(sent, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sent.value, window)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            data, offsets = buffers(text)
            raw = data.tobytes()
            known = "items" in batch.schema.names
            earlier = batch.select(["begin", "end", "items"]).to_pydict() if known else None
            n, all_ranges, all_items = [], [], []
            for row, (at, to) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                words, ranges, ids = scan(raw[at:to], machine)
                if earlier:
                    ranges = merge([*ranges, *zip(earlier["begin"][row], earlier["end"][row])])
                    ids = ids.union(earlier["items"][row])
                n.append(words), all_ranges.append(ranges), all_items.append(sorted(ids))
            kept = [name for name in batch.schema.names if name in ("doc", "text", "row")]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(batch.schema.get_field_index(name)) for name in kept), pa.array(n, pa.int64()),
                pa.array([[a for a, _ in r] for r in all_ranges], pa.list_(pa.int32())),
                pa.array([[b for _, b in r] for r in all_ranges], pa.list_(pa.int32())),
                pa.array(all_items, pa.list_(pa.int64())),
            ], names=[*kept, *(f.name for f in HITS)])

    return run


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = 10, keep_row: bool = False,
) -> DataFrame:
    """(doc, n_words, begin, end, items) for every row of ``docs``.

    ``begin`` and ``end`` are the merged word ranges (from 0, half open) inside
    any occurrence of an item window, ``items`` the sorted ids of the items
    with an occurring window.  With ``keep_row`` there is a column ``row``, a
    struct of the input row.

    Null and empty texts have no words and no hits; items that are null, have a
    null id or no words are no phrase.  Items with the same words all count.
    Rows with null or repeated ids are scanned like all others.  Empty tables
    give empty tables or no hits.  Further columns of either table are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("long").alias("id"), F.col(item_text_column).alias("text")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull(),
    )
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    row = [F.struct(*docs.columns).alias("row")] if keep_row else []
    found = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"), *row)
    schema = T.StructType([*found.schema.fields, *HITS])
    for group in range(groups):
        part = items if groups == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == group)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        found = found.mapInArrow(_scanner(sent, window), schema)
        if group < groups - 1:
            found = stage(found, "hits")
    return found.drop("text")


def excise(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each range."""
    raw = text.encode()
    words = words_of(pa.array([text]), ALNUM, lower=True)
    out, at = [], 0
    for begin, end in ranges:
        out.append(raw[at: words.start[begin]])
        at = int(words.end[end - 1])
    return b"".join([*out, raw[at:]]).decode()


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges in the original text of word ranges."""
    words = words_of(pa.array([text]), ALNUM, lower=True)
    return [(int(words.start[a]), int(words.end[b - 1])) for a, b in ranges]

