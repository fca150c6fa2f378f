import random

import pytest


@pytest.fixture
def docs(spark):
    """A documents table with an extra column whose name clashes with internal ones."""
    def make(rows, extra="key"):
        full = [(i, t, "en", "src0", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra} string")
    return make


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, ties, long and empty ones."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "the", "É", "naïve", "x,", "(y)"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage = text(70)
    rows = [(i, text(draw.randint(30, 200))) for i in range(40)]
    for i in range(40, 70):
        base = rows[draw.randrange(40)][1].split()
        for _ in range(draw.randint(0, 6)):
            base[draw.randrange(len(base))] = draw.choice(vocabulary)
        rows.append((i, " ".join(base)))
    rows += [(70 + i, text(draw.randint(0, 30)) + " " + passage + "\n" + text(draw.randint(0, 30))) for i in range(12)]
    rows += [(90 + i, rows[3][1]) for i in range(6)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "ONE two"), (105, "one two three")]
    rows += [(106, text(6000)), (107, "same " * 400), (108, "same " * 380), (None, rows[4][1]), (None, None)]
    rows += [(7, rows[7][1]), (8, text(90))]
    return rows
