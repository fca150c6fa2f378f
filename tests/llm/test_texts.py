"""Operators on single texts and on passages."""

import random
import time
import tracemalloc
import re._parser as parser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from touchline.llm import decontaminate, jaccard_trie, license_rules, licenses, seed_extend, suffix_array, text
from touchline.llm.op04 import digests
from touchline.llm.quality import fit, held_out, matrix, score_quality
from touchline.llm.repeats import Shape, _seeds, without_repeats
from touchline.llm.seed_extend import seed_and_extend
from touchline.llm.suffix_array import suffix_dedup


def test_words_and_hashes():
    texts = ["a  b\tc", None, "", " Über x\r\ny ", "a b c", "é" * 3, "ab\x0bcd\x1ce"]
    words = text.words_of(pa.array(texts), text.SPACED)
    parts = [brute.spaced(t) for t in texts]
    assert words.counts.tolist() == [len(p) for p in parts]
    raw = words.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(words.start, words.end)] == [w for p in parts for w in p]
    by_word = {}
    for w, h in zip((w for p in parts for w in p), words.hash.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    same = text.words_of(pa.array(["A x", "a X"]), text.SPACED, lower=True).grams(2)
    assert same[0] == same[2]


def test_words_do_not_depend_on_pieces(monkeypatch):
    texts = pa.array([" ".join(f"word{i % 17}" for i in range(200)), "x" * 500, "y"])
    whole = text.words_of(texts).hash
    monkeypatch.setattr(text, "PIECE", 7)
    assert np.array_equal(text.words_of(texts).hash, whole)


def test_sliding_min():
    values = np.array([5, 1, 4, 4, 0, 9, 2])
    for width in range(1, 9):
        want = [min(values[i: i + width]) for i in range(len(values) - width + 1)]
        assert text.sliding_min(values, width).tolist() == want


@pytest.mark.parametrize("operator", [seed_and_extend, suffix_dedup])
def test_repeats_agree_with_all_windows(spark, docs, corpus, operator):
    for length in (50, 20):
        found = digests(operator(docs(corpus), length, k=8)).collect()
        want = brute.removed(corpus, length)
        got = {}
        for r in found:
            got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert operator(docs([]), 50).collect() == []


def test_texts_without_repeats_keep_other_columns(spark, docs, corpus):
    table = docs(corpus, "kept")
    left = without_repeats(table, seed_and_extend(table, 50), "doc_id", "text")
    assert left.columns == table.columns and left.count() == len(corpus)
    want = brute.removed(corpus, 50)
    for r in left.collect():
        options = want[r.doc_id]
        assert any(x[1] == 0 or brute.sha(r.text) == x[2] for x in options)
        assert r.kept == "x"


def test_hits_agree_with_plain_windows(spark, docs, corpus):
    items = [(i, " ".join(t.split()[5:5 + n])) for i, (_, t) in enumerate(corpus[:30]) for n in [3 + i % 20]]
    items += [(50, None), (51, ""), (52, "--"), (None, "w1"), (53, items[2][1]), (54, "one TWO")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.benchmark_hits(docs(corpus, "row"), bench).collect()
    windows = {}
    for item, t in items:
        w = brute.alnum(t)
        for i in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[i: i + 10]), set()).add(item)
    want = []
    for doc, t in corpus:
        w, hit, ids = brute.alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i: i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i: i + n])]
        want.append((doc, len(w), sorted(hit), sorted(ids)))
    got = [(r.doc, r.n_words, [x for a, b in zip(r.begin, r.end) for x in range(a, b)], list(r["items"])) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.benchmark_hits(docs([]), bench).collect() == []
    assert all(not r["items"] for r in decontaminate.benchmark_hits(docs(corpus), bench.limit(0)).collect())


def test_a_benchmark_in_groups_gives_the_same(spark, docs, corpus, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in corpus if i is not None and i < 20], "item_id long, text string")
    whole = decontaminate.benchmark_hits(docs(corpus), bench, keep_row=True)
    want = sorted(map(str, whole.collect()))
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 4000)
    assert sorted(map(str, decontaminate.benchmark_hits(docs(corpus), bench, keep_row=True).collect())) == want


def test_hits_map_to_the_original():
    line = "Ünd, THE  Cat (sat) on—x the mat."
    ranges = [(1, 4)]
    assert [line.encode()[a:b].decode() for a, b in decontaminate.spans(line, ranges)] == ["THE  Cat (sat"]
    assert decontaminate.excise(line, ranges) == "Ünd, ) on—x the mat."


def test_license_base_places(spark, docs):
    texts = [
        (1, "Released under the MIT License. mit license"), (2, "GNU General, Public-License; Apache License 2.0"),
        (3, "CC BY-NC 4.0 cc by"), (4, None), (5, ""), (6, "smit license gnu general public licenses"), (None, "mit license"),
        (7, "Licensed under the Apache License, Version 2.0."), (7, "no words"), (8, "mit license " * 3000),
    ]
    found = licenses.license_scan(docs(texts, "label")).collect()
    want = []
    for doc, t in texts:
        w = brute.alnum(t)
        places = [
            (i, label) for phrase, label in license_rules.BASE.items() for n in [len(phrase.split())]
            for i in range(len(w) - n + 1) if " ".join(w[i: i + n]) == phrase
        ]
        at = [i for i, _ in places]
        want.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places})))
    got = [(r.doc, r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels)) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 for r in found)
    assert licenses.license_scan(docs([])).collect() == []


def samples(tokens):
    """Texts of a parsed pattern in which each of its alternatives is taken once at least."""
    parts = []
    for kind, x in tokens:
        kind = str(kind)
        if kind == "LITERAL":
            parts.append([chr(x)])
        elif kind == "IN":
            parts.append([chr(v if str(k) == "LITERAL" else v[0]) for k, v in x])
        elif kind == "BRANCH":
            parts.append([t for branch in x[1] for t in samples(branch)])
        elif kind == "SUBPATTERN":
            parts.append(samples(x[3]))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            parts.append([t * max(x[0], 1) for t in samples(x[2])] + [""] * (x[0] == 0))
        else:
            assert kind in ("ANY", "ASSERT_NOT")
            parts.append(["z"] if kind == "ANY" else [""])
    first = [p[0] for p in parts]
    return ["".join(first)] + ["".join([*first[:i], t, *first[i + 1:]]) for i, p in enumerate(parts) for t in p[1:]]


def test_license_keywords_drop_no_match():
    made = license_rules.rules()
    gated, free = licenses.Scanner(), licenses.Scanner([r._replace(keyword="") for r in made])
    lines = {f" {t} " for r in made if license_rules.GRANTS not in r.pattern for t in samples(parser.parse(r.pattern))}
    lines |= {f" {t} {n} " for t in samples(parser.parse(license_rules.GRANTS)) for n in ("freebsd", "0bsd license", "isc licence")}
    assert len(lines) > 500 and " 0bsd licence " in lines
    found = lambda scanner, line: [(at, to, r.label, r.pattern) for at, to, r in scanner.detect(line)]
    assert [x for x in lines if found(gated, x) != found(free, x)] == []


def test_license_rules_are_settled_in_order():
    made = license_rules.rules()
    assert len(made) > 200 and len({(r.label, r.pattern) for r in made}) == len(made)
    scan = licenses.Scanner().scan
    labels = lambda t: [d["label"] for d in scan(t.encode())[6]]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("SPDX-License-Identifier: MIT") == ["mit"]
    assert labels("nothing of the kind") == []
    assert scan("the mit license and the mit license".encode())[6][1]["begin"] == 5


def test_license_cover_against_brute_force():
    draw = random.Random(5)
    for _ in range(200):
        cover, kept = licenses.Cover(), []
        for _ in range(40):
            at = draw.randrange(30)
            to = at + draw.randrange(1, 12)
            held = any(a <= at and to <= b for a, b in kept)
            assert cover.holds(at, to) == held
            if not held:
                cover.add(at, to)
                kept.append((at, to))


def test_license_lists_of_any_length():
    """Work grows with the text, not with its square: every place is found in a list of 40,000 licences."""
    text = b"cc by 4.0 and under the mit license " * 20_000
    start = time.perf_counter()
    n_words, n_base, _, _, _, _, found = licenses.Scanner().scan(text)
    assert time.perf_counter() - start < 30
    assert n_words == 180_000 and n_base == 40_000 and len(found) == 40_000


def test_quality_scores_held_out_rows(spark, docs):
    draw = random.Random(2)
    words = ["the", "of", "reason", "and", "because", "house", "time"]
    rows, labels = [], []
    for i in range(300):
        clean = [draw.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in clean) if bad else " ".join(clean)))
        labels.append((i, float(not bad)))
    rows += [(1000, None), (1001, ""), (None, "the of"), (3, "the time"), (1002, "the " * 20000)]
    labelled = spark.createDataFrame([*labels, (1, None), (None, 1.0), (5000, 1.0)], "doc long, label double")
    teach = labelled.filter(~held_out(F.col("doc")))
    found = score_quality(docs(rows, "score"), teach).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = dict(labels)
    out = [r for r in found if r.doc in truth and r.doc != 3 and r.doc not in {x.doc for x in teach.collect()}]
    assert len(out) > 60 and all((r.score >= 0.5) == (truth[r.doc] == 1) for r in out)
    empty = [r.score for r in found if r.doc in (1000, 1001)]
    assert empty[0] == empty[1]
    assert {r.score for r in score_quality(docs(rows), teach.limit(0)).collect()} == {0.5}
    assert score_quality(docs([]), teach).collect() == []


def test_quality_votes_are_exact_cosines():
    draw = random.Random(4)
    texts = pa.array([" ".join(draw.choice(["ab", "Cd", "e!", "12"]) for _ in range(30)) for _ in range(80)])
    shares = matrix(texts)
    model = fit(shares, np.array([i % 2 for i in range(80)], float))
    near = model.latent(shares[:5]) @ model.vectors.T
    for i in range(5):
        top = np.argsort(-near[i])[:15]
        weight = np.maximum(near[i][top], 0) ** 8
        assert abs(model.score(shares[:5])[i] - (weight * model.labels[top]).sum() / weight.sum()) < 1e-9


def test_anchors_of_a_text_longer_than_places_have_bits(monkeypatch):
    monkeypatch.setattr(text, "_powers", {})
    n, shape = (1 << 24) + 500, Shape(50, 20)
    hashes = np.random.default_rng(4).integers(0, 1 << 63, n).astype(np.uint64)
    hashes[-400:-300] = hashes[100:200]

    def words(part):
        none = np.zeros(0, np.int64)
        return text.Words(part, np.array([0, len(part)]), none, none, np.zeros(0, np.uint8), none)

    _, starts, anchors = shape.anchors(words(hashes))
    assert len(starts) == n - 49 and starts[-1] == n - 50
    for at in (0, (1 << 24) - 700, n - 1000):
        _, own, found = shape.anchors(words(hashes[at: at + 1000]))
        assert (anchors[own + at] == found + at).all()
    assert (anchors[n - 400: n - 350] - (n - 400) == anchors[100:150] - 100).all()


def test_suffixes_of_one_seed_are_added_up_and_spread(spark, rows):
    hot = [(d, 7, c, d % 50) for d in range(300) for c in range(d % 10, 400, 10)]
    other = [(1, 8, 1, 0), (2, 8, 1, 3), (1, 9, 1, 0), (1, 9, 2, 4), (3, 10, 5, 6), (1, 6, 2, 2), (4, 6, 3, 2)]
    spread = spark.createDataFrame(hot + other, "doc long, seed long, context long, place int")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        suffixes = suffix_array._suffixes(spread)
        assert suffixes.count() == len({r[1:3] for r in hot + other})
        assert suffixes.filter("seed = 7").select(F.spark_partition_id()).distinct().count() > 1
        columns = ["context", "low", "high", "place", "several"]
        assert rows(suffix_array._sorted(spread), *columns) == rows(seed_extend._joined(spread), *columns)
    finally:
        spark.conf.set(name, before)


def test_long_texts_are_scored_in_pieces(spark, docs):
    texts = pa.array(["Some words, and some more of them. " * 3000, None, "short one", "x" * 50_000, "a b " * 20_000])
    whole, parts = matrix(texts), matrix(texts, piece=1000)
    assert np.array_equal(whole[[1, 2]], parts[[1, 2]]) and np.allclose(whole, parts, atol=0.05)
    assert not np.isnan(parts).any() and np.allclose((parts ** 2).sum(1), [1, 0, 1, 1, 1])


def test_all_neighbours_that_tie_vote():
    shares = np.eye(4)[[0] * 20 + [1] * 20]
    model = fit(np.pad(shares, ((0, 0), (0, matrix(pa.array(["x"])).shape[1] - 4))), np.array([1.0] * 12 + [0.0] * 8 + [0.0] * 20))
    assert np.allclose(model.score(np.eye(matrix(pa.array(["x"])).shape[1])[:1]), 0.6)


def test_a_task_holds_the_words_of_a_slice_only():
    texts = [" ".join(f"w{(i * 7919 + x * 104729) % 50021}" for x in range(300)) for i in range(4000)]
    ids, column = pa.array(range(len(texts))), pa.array(texts)
    jobs = [
        (jaccard_trie._sets(5, 80, 100, False), [ids, column], ["doc", "text"]),
        (_seeds(Shape(50, 20)), [ids, ids, column], ["doc", "key", "text"]),
    ]
    for step, columns, names in jobs:
        text._powers.clear()
        tracemalloc.start()
        made = sum(part.num_rows for part in step(iter([pa.RecordBatch.from_arrays(columns, names=names)])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made == len(texts) and peak < 60e6
