"""Licence scan: ordered signature rules behind a keyword prefilter.

A text becomes one line of lower-case words.  One Aho-Corasick pass finds which
keywords of the rules occur in it; only the rules of those keywords run their
regex.  Detections that overlap are settled in order: a detection whose words
lie inside those of a kept one of the same or a better rank is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.license_rules import BASE, Rule, rules
from touchline.llm.text import NORMAL, buffers

FOUND = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType(), False)),
    T.StructField("score", T.DoubleType()),
    T.StructField("detections", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
    ]), False)),
])


class Cover:
    """Intervals, asked whether one of them holds another; those inside others are left out."""

    def __init__(self):
        self.starts: list[int] = []  # both ascend, as no interval lies in another
        self.ends: list[int] = []

    def holds(self, at: int, to: int) -> bool:
        i = bisect_right(self.starts, at) - 1
        return i >= 0 and self.ends[i] >= to

    def add(self, at: int, to: int) -> None:
        """An interval that none holds."""
        first, stop = bisect_left(self.starts, at), bisect_right(self.ends, to)
        self.starts[first:stop], self.ends[first:stop] = [at], [to]


class Scanner:
    def __init__(self, made: list[Rule] | None = None):
        made = rules() if made is None else made
        self.rules = [(r, re.compile(rf"(?<= ){r.pattern}(?= )")) for r in sorted(made, key=lambda r: r.priority)]
        self.base = [(f" {phrase} ".encode(), len(phrase.split()), label) for phrase, label in BASE.items()]
        # A keyword begins with a word, so there is a blank before it.
        gates: dict[str, list[int]] = {}
        for i, (rule, _) in enumerate(self.rules):
            for keyword in rule.keyword.split("|"):
                gates.setdefault(f" {keyword}", []).append(i)
        self.machine = ahocorasick.Automaton()
        for word, own in gates.items():
            self.machine.add_word(word, own)
        self.machine.make_automaton()

    def base_places(self, line: bytes) -> list[tuple[int, str]]:
        """(byte of the blank before, label) of every place of a base phrase."""
        places = []
        for phrase, _, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append((at, label))
                at = line.find(phrase, at + 1)
        return places

    def detect(self, line: str) -> list[tuple[int, int, Rule]]:
        """Kept detections (first byte, last byte, rule) in a normalised line."""
        wanted: set[int] = set()
        for _, own in self.machine.iter(line):
            wanted.update(own)
        kept: list[tuple[int, int, Rule]] = []
        cover = Cover()
        for i in sorted(wanted):
            rule, pattern = self.rules[i]
            for m in pattern.finditer(line):
                at, to = m.span()
                if not cover.holds(at, to):
                    cover.add(at, to)
                    kept.append((at, to, rule))
        return sorted(kept, key=lambda x: (x[0], x[1]))

    def scan(self, text: bytes) -> tuple:
        words = text.translate(NORMAL).split()
        line = b" " + b" ".join(words) + b" "
        places = self.base_places(line)
        found = self.detect(line.decode("latin-1"))
        # Bytes to words: blanks before a byte, less the leading one.
        at = sorted({p for p, _ in places} | {x for a, b, _ in found for x in (a - 1, b)})
        word_at: dict[int, int] = {}
        n = last = 0
        for x in at:
            n += line.count(b" ", last, x)
            last, word_at[x] = x, n
        starts = [word_at[p] for p, _ in places]
        detections = [
            {"label": r.label, "begin": word_at[a - 1], "end": word_at[b], "confidence": r.confidence} for a, b, r in found
        ]
        miss = 1.0
        for d in detections:
            miss *= 1.0 - min(d["confidence"], 0.99)
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None),
            sorted({label for _, label in places}), 1.0 - miss, detections,
        )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        raw = data.tobytes()
        found = [scanner.scan(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        columns = list(zip(*found)) if found else [[]] * 7
        yield pa.RecordBatch.from_arrays([
            batch.column(0), *(pa.array(columns[i], pa.int64()) for i in range(4)),
            pa.array(columns[4], pa.list_(pa.string())), pa.array(np.array(columns[5], np.float64)),
            pa.array(columns[6], pa.list_(pa.struct([
                ("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64()),
            ]))),
        ], names=FOUND.names)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, n_words, n_base, first_word, last_word, base_labels, score, detections) for every row.

    ``n_base`` counts all places of base phrases, overlapping ones too;
    ``first_word`` and ``last_word`` are the least and greatest word they start
    at, null without one.  ``detections`` are the kept rule matches with word
    ranges (half open) and ``score`` is 1 minus the product of their doubts, 0
    without one.  Null and empty texts have no words and no detections.  Rows
    with null or repeated ids are scanned like all others; an empty table gives
    an empty table; further columns are ignored.  A text of any length is read
    whole; detections are looked up among the kept ones by halving, so a text
    that is one long list of licences takes little more than its length.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    return source.mapInArrow(_scan, FOUND)
