"""Spelling variants against all edits of every word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import spelling
from touchline.llm.op13 import misspelt, op13
from touchline.llm.spelling import count_words, decompose, letters, near_words, spelling_variants, spread, top

LETTERS = "abcdefghijklmnopqrstuvwxyzäéß"


def plain_counts(rows, least=7):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if doc is not None and h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= least}


def plain_near(words):
    """Words that share a form with one place left out or replaced."""
    forms = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            forms[w[:i] + "\0" + w[i + 1:]].add(w)
            forms[w[:i] + w[i + 1:]].add(w)
        forms[w].add(w)
    out = defaultdict(set)
    for form, group in forms.items():
        for a in group:
            for b in group:
                if a != b and ("\0" in form or form in (a, b)):
                    out[a].add(b)
    return out


def plain(counts, ratio=10):
    near, forms, out = plain_near(counts), {}, []
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, n, len(near[w]), forms[w], forms[w] and counts[forms[w]], root))
    return sorted(out)


@pytest.fixture(scope="module")
def counts():
    draw = random.Random(4)
    words = {"".join(draw.choice("abcé") for _ in range(draw.randint(7, 9))) for _ in range(300)}
    words |= {"".join(draw.choice(LETTERS) for _ in range(draw.randint(7, 22))) for _ in range(150)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "ab" * 4, "ab" * 4 + "a", "z" * 40, "z" * 41, "z" * 39 + "y", "q" * 32, "q" * 33, "x" * 300, "x" * 299 + "y"}
    words = sorted(words)
    for word in draw.sample(words, 200):
        for _ in range(3):
            at, letter = draw.randrange(len(word)), draw.choice(LETTERS)
            words.append(draw.choice([word[:at] + word[at + 1:], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:]]))
    return {w: draw.choice([2, 3, 25, 40, 300, 5000]) for w in sorted(set(words)) if len(w) >= 7}


@pytest.mark.parametrize("parameters", [{}, {"block": 16, "frequent": 3}, {"frequent": 1, "size": 1 << 16}, {"frequent": 10**6}])
def test_variants_agree_with_all_edits(spark, counts, parameters):
    table = spark.createDataFrame([*counts.items(), (None, 3), ("nocounts", None)], "word string, n long")
    found = spelling_variants(table.withColumn("form", table.word), **parameters)
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()]
    assert sorted(got) == plain(counts)
    assert spelling_variants(table.limit(0)).collect() == []


def test_bound_holds_for_every_edit(counts):
    """Of bound + 1 grams of a word, any near word has one at the same place or one later."""
    words = [w for w in counts if len(w) < 23][:400]
    known = np.unique(np.concatenate([spelling.packed(letters([w], len(w)), k).ravel() for w in words[::2] for k in range(2, 7)]))

    def grams(word, class_):
        size, kept, gram, _ = decompose(letters([word], len(word)), top(class_), known, np.ones(len(known), np.int64))
        return size, kept, {(int(gram[0, p]), int(p)) for p in np.flatnonzero(kept[0])}

    near = plain_near(words)
    checked = 0
    for a in words:
        size, kept, own = grams(a, len(a))
        bound = int(spelling.affected(size, kept, len(a), top(len(a)))[0])
        assert len(own) > bound
        for b in near[a]:
            if len(b) < len(a):
                continue
            other = grams(b, len(a))[2]
            shared = sum((g, p) in other or (len(b) > len(a) and (g, p + 1) in other) for g, p in own)
            assert len(own) - shared <= bound
            checked += 1
    assert checked > 300


def test_words_and_counts(spark, docs, monkeypatch):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice(LETTERS + "ABCÄ") for _ in range(draw.randint(1, 12))) for _ in range(400)]
    rows = [(i, " ".join(draw.choice(vocabulary) + draw.choice(["", ",", "1", "中", "-x"]) for _ in range(200))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "123 !"), (None, rows[0][1]), (5, rows[5][1]), (73, "x" * 5000 + " " + "abcdefgh " * 3000)]
    want = plain_counts(rows)
    found = count_words(docs(rows, "word"), spell=misspelt).collect()
    assert {r.word: r.n for r in found} == want and len(found) == len(want)
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "KEPT_WORDS", 20)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc", "text"])
    parts = Counter()
    for part in spelling._counted(7, misspelt)(iter([batch])):
        parts.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
    assert {w: n for w, n in parts.items() if len(w) >= 7} == want
    assert count_words(docs([])).collect() == []


def test_pairs_come_from_lists_of_bounded_size(spark, counts):
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = {tuple(sorted((r.a, r.b))) for r in near_words(table, block=8).collect()}
    assert pairs == {tuple(sorted((a, b))) for a, other in plain_near(counts).items() for b in other}


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain({w: n for w, n in plain_counts(rows).items() if n >= 2})
    found = op13(spark, sf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()) == want


def test_words_as_rows(counts):
    words = ["", "é", *counts, "a\u0080Âÿ"]
    matrix, size = spread(pa.array(words)[1:], 12)
    assert size.tolist() == [len(w) for w in words[1:]]
    assert [bytes(r).rstrip(b"\0").decode("latin-1") for r in matrix] == [w[:12] for w in words[1:]]
