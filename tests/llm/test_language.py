"""The byte network: gradients, training, edge rows, held-out documents."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from touchline.llm import language, op12
from touchline.llm.text import buffers


def loss(model, steps, label):
    near = model.positions(steps)
    return -np.mean([np.log(near[k, :, r]).mean() for r, k in enumerate(label)])


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(1)
    model = language.fresh(["a", "b", "c"], hidden=5)
    for direction in (model.ahead, model.behind):
        for name in ("byte", "gates", "candidate"):
            setattr(direction, name, getattr(direction, name).astype(np.float64))
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    steps = draw.integers(0, 256, (9, 4)).astype(np.uint8)
    label = np.array([0, 2, 1, 2])
    grads = model.gradients(steps, label)
    for weight, grad in zip(model.weights, grads):
        places = np.unravel_index(np.argsort(-np.abs(grad), axis=None)[:6], grad.shape)
        for place in zip(*places):
            kept = weight[place]
            weight[place] = kept + 1e-3
            above = loss(model, steps, label)
            weight[place] = kept - 1e-3
            below = loss(model, steps, label)
            weight[place] = kept
            assert abs((above - below) / 2e-3 - grad[place]) < 1e-3 * max(1, abs(grad[place]) * 50)


def test_windows_do_not_depend_on_batches():
    model = language.fresh(["a", "b"])
    texts = ["x" * 200, "", "ab 12", "Über alles " * 40, "12 34", "z" * 64, "y" * 65]
    whole = language.document_means(model, *buffers(pa.array(texts)))
    for i, text in enumerate(texts):
        assert np.allclose(whole[i], language.document_means(model, *buffers(pa.array([text])))[0], atol=1e-5)
    assert whole[1].sum() == 0 and whole[4].sum() == 0
    assert np.allclose(whole[[0, 2, 3, 5, 6]].sum(1), 1, atol=1e-4)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string, lang string")


def test_languages_are_learned_and_odd_rows_defined(spark, docs):
    teach = [(i, "the quick brown fox jumps over the lazy dog and runs away " * 3, "en") for i in range(30)]
    teach += [(i, "der schnelle braune fuchs springt über den faulen hund weg " * 3, "de") for i in range(30)]
    teach += [(99, None, "en"), (98, "some text that has no language at all, of the length of a window", None), (97, "", "xx"), (None, "y" * 80, "de")]
    rows = [(1, "the lazy dog and the quick fox"), (2, "über den faulen braunen hund"), (3, None), (4, ""), (5, "12 !? 34"), (1, "x"),
            (None, "the dog jumps over the fox"), (6, "the dog runs over the fox and away " * 5000), (7, "中文"), (8, "¿123¡")]
    model_rows = labelled(spark, teach)
    found = language.identify(docs(rows, "lang2"), model_rows, steps=60)
    assert found.columns == ["doc", "lang", "score"]
    got = [(r.doc, r.lang, r.score) for r in found.collect()]
    assert len(got) == len(rows)
    by = {d: (lang, score) for d, lang, score in got if d != 1}
    assert by[2][0] == "de" and by[None][0] == "en" and by[6][0] == "en"
    assert by[3] == by[4] == by[5] == by[8] == ("und", 0.0)
    assert by[7][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, _, s in got)
    assert sorted(map(str, got)) == sorted(map(str, [(r.doc, r.lang, r.score) for r in language.identify(docs(rows), model_rows, steps=60).collect()]))
    none = language.identify(docs(rows), model_rows.limit(0)).collect()
    assert {r.lang for r in none} == {"und"} and {r.score for r in none} == {0.0}
    one = {r.doc: r.lang for r in language.identify(docs(rows), model_rows.filter("lang = 'en'"), steps=60).collect() if r.doc != 1}
    assert one[2] == one[6] == "en" and one[5] == "und"
    assert language.identify(docs([]), model_rows).collect() == []


def test_sample_is_bounded(spark):
    rows = labelled(spark, [(i, f"text {i} " * 200, "ab"[i % 2]) for i in range(40)])
    taken = language.sampled(rows, docs=5, windows=3).collect()
    assert len(taken) == 30 and {len(r.window) for r in taken} == {language.WINDOW}
    assert len({(r.lang, r.h) for r in taken}) == 10


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = op12.op12(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert found.filter(F.col("score").between(0, 1)).count() == len(rows)
