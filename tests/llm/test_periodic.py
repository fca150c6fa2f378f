"""Periodic runs against a plain search over all periods."""

import random
import zlib

import pytest

from tests.llm import brute
from touchline.llm.op11 import digest, planted
from touchline.llm.periodic_runs import Octave, periodic_runs


def plain_runs(words, least=12):
    """(start, length, period) of every run, one period after the other."""
    n, seen = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            at = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - at + q
            if length >= max(least, 2 * q):
                seen.setdefault((at, length), q)
    return sorted((s, n_, q) for (s, n_), q in seen.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def ended(doc, text):
    words = brute.spaced(text)
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(rows):
    out = []
    for doc, text in rows:
        words = ended(doc, text)
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((
            doc, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], brute.sha(lines),
            brute.sha(" ".join(collapsed(words, runs))),
        ))
    return sorted(out, key=str)


def periodic_texts():
    draw = random.Random(3)
    rows = []
    for i in range(120):
        letters = [f"w{j}" for j in range(draw.choice([1, 2, 3, 40]))]
        words = []
        for _ in range(draw.randint(0, 6)):
            block = [draw.choice(letters) for _ in range(draw.randint(1, 30))]
            words += (block * draw.randint(1, 9))[: draw.randint(1, 150)]
            words += [draw.choice(letters) for _ in range(draw.randint(0, 5))]
        rows.append((i, draw.choice([" ", "\t", " \n"]).join(words)))
    word = "a"
    for _ in range(7):
        word = word.replace("a", "x").replace("b", "y").replace("x", "ab").replace("y", "a")
    rows.append((900, " ".join(word)))
    rows += [(901, "same " * 500), (902, "same " * 11), (903, "same " * 12), (904, "a b " * 6), (905, "a b c d e f g " * 2)]
    rows += [(906, None), (907, ""), (908, " \n"), (None, "x y " * 30), (None, None), (5, rows[5][1]), (6, "p q r " * 40)]
    return rows


@pytest.mark.parametrize("tile", [16384, 64, 16])
def test_runs_agree_with_a_plain_search(spark, docs, tile):
    rows = periodic_texts()
    table = docs(rows, "runs")
    found = digest(periodic_runs(planted(table), tile=tile, keep_text=False)).drop("n_words", "n_dropped")
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)


def test_other_least_lengths_and_texts(spark, docs):
    rows = periodic_texts()[:60]
    for least in (2, 7, 30):
        found = {}
        for r in periodic_runs(docs(rows), least=least, tile=32).collect():
            found[r.doc] = ([(x.start, x.length, x.period) for x in r.runs], r.collapsed)
        for doc, text in rows:
            words = brute.spaced(text)
            runs = plain_runs(words, least)
            left = collapsed(words, runs)
            assert found[doc][0] == runs
            assert found[doc][1] == (" ".join(left) if runs else None)
    assert periodic_runs(docs([])).collect() == []


def test_every_run_holds_a_boundary():
    for least in (1, 2, 5, 12, 40):
        for o in range(8):
            octave = Octave(o, least)
            assert octave.gram >= 1 and octave.step >= 1
            assert octave.step + octave.gram - 1 == octave.need
            assert all(octave.reach >= max(q, least - q) for q in octave.periods.tolist())


def test_long_text(spark, docs):
    draw = random.Random(8)
    block = [f"w{draw.randrange(5000)}" for _ in range(21_000)]
    words = block + block + block[:777] + ["end"] + ["x", "y", "z"] * 9000
    runs = periodic_runs(docs([(1, " ".join(words))]), keep_text=False).first().runs
    assert [(r.start, r.length, r.period) for r in runs] == [(0, 42_777, 21_000), (42_778, 27_000, 3)]
