"""Joins on pairs: components, n-gram Jaccard, embeddings."""

import math
import random

import numpy as np
import pytest

from tests.llm import brute
from touchline.llm import embedding_dedup, jaccard_trie
from touchline.llm.components import components, local_components
from touchline.llm.embedding_dedup import near_vectors
from touchline.llm.jaccard_trie import jaccard_join


def test_components_of_chains_stars_and_cliques(spark, rows):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000 + i, 999) for i in range(50)]
    clique = [(i, j) for i in range(5, 12) for j in range(5, i)]
    edges = chain + star + clique + [(7, 7), (2, 2), (None, 3)]
    draw.shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    good = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {n for e in good for n in e}
    assert rows(found) == sorted(brute.groups(nodes, good).items(), key=str)
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_local_components():
    u, v = np.array([0, 5, 3]), np.array([4, 3, 1])
    assert local_components(6, u, v).tolist() == [0, 1, 2, 1, 0, 1]
    assert local_components(2, u[:0], v[:0]).tolist() == [0, 1]


@pytest.mark.parametrize("block", [1000, 3])
def test_jaccard_join_agrees_with_all_pairs(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard_trie, "BLOCK", block)
    for k, num in ((4, 85),) if block == 3 else ((4, 85), (5, 80)):
        found = jaccard_join(docs(corpus), n_words=k, num=num).collect()
        known = [(d, brute.grams(t, k)) for d, t in corpus]
        nodes = list(range(len(known)))
        links = [
            (i, j) for i in nodes for j in range(i)
            if known[i][1] and known[j][1] and known[i][0] is not None and known[j][0] is not None
            and 100 * len(known[i][1] & known[j][1]) >= num * len(known[i][1] | known[j][1])
        ]
        root = brute.groups(nodes, links)
        least = {}
        for i in nodes:
            if known[i][0] is not None:
                least[root[i]] = min(least.get(root[i], math.inf), known[i][0])
        want = sorted((
            (known[i][0], len(known[i][1]), sum(i in e for e in links), least[root[i]] if known[i][0] is not None else None)
            for i in nodes
        ), key=str)
        assert sorted(((r.doc, r.n_shingles, r.n_links, r.component_id) for r in found), key=str) == want


def test_jaccard_join_of_nothing(spark, docs):
    assert jaccard_join(docs([])).collect() == []
    assert [tuple(r) for r in jaccard_join(docs([(3, None)])).collect()] == [(3, 0, 3, 0, 3)]


def test_trie_finds_what_all_pairs_find():
    draw = random.Random(9)
    pool = list(range(60))
    sets = []
    for _ in range(60):
        base = set(draw.sample(pool, 25)) if not sets or draw.random() < 0.4 else set(draw.choice(sets))
        for _ in range(draw.randrange(4)):
            base.symmetric_difference_update([draw.choice(pool)])
        sets.append(base)
    sizes = np.array([len(s) for s in sets])
    values = np.array([x for s in sets for x in s])
    at = np.concatenate([[0], np.cumsum(sizes)])
    u, v = jaccard_trie.block_links(sizes, values, at, np.full(60, 2), 85, 100)
    want = {(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert set(zip(u.tolist(), v.tolist())) == want and len(u) == len(want)


@pytest.mark.parametrize("block,parameters", [(1024, {}), (16, {}), (1024, {"recall": None, "list_rows": 12}), (8, {"recall": None, "list_rows": 40})])
def test_near_vectors_agree_with_all_pairs(spark, monkeypatch, block, parameters):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 12))
    table = [(i, (centres[i % 6] + draw.normal(size=12) * draw.choice([0.1, 0.4])).tolist()) for i in range(150)]
    table += [(200 + i, table[5][1]) for i in range(4)] + [(210, [2 * x for x in table[5][1]])]
    table += [(300, None), (301, []), (302, [0.0] * 12), (303, [math.nan] * 12), (304, [math.inf] + [0.0] * 11)]
    table += [(305, [None] + [1.0] * 11), (306, [1e300] * 12), (307, [1e-300] * 12), (308, table[0][1][:11]), (None, table[0][1])]
    found = near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>"), **parameters).collect()

    def fine(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a) / np.max(np.abs(a)), np.array(b) / np.max(np.abs(b))
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    good = [(i, v) for i, v in table if fine(i, v)]
    links = [(a, b) for a, x in good for b, y in good if b < a and len(x) == len(y) and cosine(x, y) >= 0.9]
    root = brute.groups([i for i, _ in table if i is not None], links)
    want = {i: (sum(i in e for e in links), root[i]) for i, _ in table if i is not None}
    assert {r.id: (r.n_links, r.component_id) for r in found if r.id is not None} == want
    assert [tuple(r) for r in found if r.id is None] == [(None, None, 0, None)]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_probed_lists_reach_the_recall(spark):
    """Pairs at a cosine of hardly more than 0.9, among random vectors, in lists of few vectors."""
    draw = np.random.default_rng(6)
    base = draw.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = draw.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = draw.uniform(0.901, 0.93, (1500, 1))
    near = cosine * base + np.sqrt(1 - cosine ** 2) * aside
    points = np.concatenate([base, near])
    rows = [(i, v) for i, v in enumerate(points.tolist())]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_rows=50).collect()
    got = {r.id: (r.n_links, r.component_id) for r in found}
    linked = sum(got[i + 1500][1] == i for i in range(1500))
    assert linked >= 0.98 * 1500
    cosines = points @ points.T
    np.fill_diagonal(cosines, 0)
    assert all(n <= (cosines[i] >= 0.9).sum() for i, (n, _) in got.items())
    index = embedding_dedup.train(points, 3000, 0.9, list_rows=50)
    assert 0 < index.count < 0.5 * len(index.coarse)
