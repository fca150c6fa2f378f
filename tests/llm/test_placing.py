"""Packing, sharding, token counts and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from touchline.llm import packing, sharding, token_counts
from touchline.llm.op10 import SEPARATOR, names
from touchline.llm.tokens import WordTokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_those_of_the_whole_text(spark, encoder):
    import pyarrow as pa

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["á é", "x y z", "<|endoftext|> <|startoftext|>x", "İI Σας ß's I'm", None, "", "\x1ca\x85b", "日本 語"]
    tokenizer = WordTokenizer(tokenizer_path())
    ids, counts = tokenizer.encode(pa.array(texts))
    want = [encoder.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_best_fit_takes_the_tightest_open_bin():
    draw = random.Random(1)
    lengths = np.array([draw.randint(1, 40) for _ in range(400)])
    bins, offsets = packing.best_fit(lengths, 40)
    room, used = [], np.zeros(bins.max() + 1, int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            assert 40 - offsets[i] == min(fits)
            room.remove(min(fits))
            left = min(fits) - lengths[i]
        else:
            assert offsets[i] == 0
            left = 40 - lengths[i]
        room.append(left)
        used[bins[i]] += lengths[i]
    assert used.max() <= 40 and used.sum() == lengths.sum()


def test_pack_places_every_token(spark, docs, corpus, encoder):
    placed = packing.pack(docs(corpus, "length"), 64).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in placed:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc].append((r.start, list(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 64
    want = defaultdict(list)
    for doc, t in corpus:
        want[doc].append([*encoder.encode(t or "", add_special_tokens=False).ids, 1])
    for doc, texts in want.items():
        if len(texts) == 1:
            assert [i for _, ids in sorted(pieces[doc]) for i in ids] == texts[0]
        else:
            assert sum(len(ids) for _, ids in pieces[doc]) == sum(map(len, texts))
    assert len(bins) <= sum(r.length for r in placed) / 64 * 1.05 + 2
    assert packing.pack(docs([]), 64).collect() == []


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_agrees_with_the_definition():
    draw = random.Random(6)
    keys = [draw.getrandbits(64) - 2 ** 63 for _ in range(300)]
    for shards in (1, 2, 16, 17, 1000):
        got = sharding.jump(np.array(keys, np.int64), shards).tolist()
        assert got == [plain_jump(k % 2 ** 64, shards) for k in keys]


def test_shard_moves_rows_into_the_new_one_only(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 7)
    found = sharding.shard(docs(corpus, "slot"), 5).collect()
    assert len(found) == len(corpus)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r.slot)
        assert r.grown_shard in (r["shard"], 5)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus)
    assert sorted((r.doc if r.doc is not None else -1, r.size, r.text_crc32) for r in found) == want
    again = {r.doc: r["shard"] for r in sharding.shard(docs(corpus[::-1]), 5).collect()}
    assert all(again[r.doc] == r["shard"] for r in found)
    assert sharding.shard(docs([]), 5).collect() == []


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_token_counts_agree_with_encoding(spark, docs, corpus, encoder, monkeypatch, block):
    monkeypatch.setattr(token_counts, "RUN", 3)
    source = docs([*corpus[:12], *corpus[-14:-8], (500, "x <|endoftext|> y")], "file").repartition(3)
    blocks = token_counts.write_flat(source, separator=SEPARATOR, block_tokens=block)
    found = names(blocks).join(token_counts.token_counts(blocks, SEPARATOR), ["file", "ordinal"]).collect()
    encoder.encode_special_tokens = True
    want = sorted((str(r.doc_id), len(encoder.encode(r.text or "", add_special_tokens=False).ids)) for r in source.collect())
    encoder.encode_special_tokens = False
    assert sorted((str(r.doc), r.n_tokens) for r in found) == want
    for file in {r.file for r in found}:
        own = sorted((r.ordinal, r.start, r.n_tokens) for r in found if r.file == file)
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(own, own[1:])) and own[0][1] == 0


def test_token_counts_of_raw_files(spark, tmp_path):
    draw = random.Random(8)
    want = []
    for f in range(3):
        ids = [draw.choice([9, 9, 1, 2, 3]) for _ in range(200)] + [1] * f
        (tmp_path / f"{f}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        parts = "".join("," if i == 9 else "x" for i in ids).split(",")
        want += sorted(map(len, parts if parts[-1] else parts[:-1]))
    blocks = token_counts.read_flat(spark, str(tmp_path / "*.bin"), block_tokens=11)
    found = token_counts.token_counts(blocks, 9).collect()
    assert sorted(r.n_tokens for r in found) == sorted(want)
    empty = spark.createDataFrame([], "file long, block long, data binary")
    assert token_counts.token_counts(empty, 9).collect() == []


def test_ids_that_do_not_fit_are_an_error(spark, docs, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({**{f"w{i}": i for i in range(70_000)}, "?": 70_000}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "large.json"))
    texts = docs([(1, "w3 w65541 w5"), (2, "w69999")])  # 65541 would wrap to 5
    for kwargs in ({"path": str(tmp_path / "large.json"), "separator": 5}, {"separator": 1 << 16}, {"width": 1, "separator": 5}):
        with pytest.raises(ValueError, match="do not fit"):
            token_counts.write_flat(texts, **kwargs)
    blocks = token_counts.write_flat(texts, path=str(tmp_path / "large.json"), separator=70_001, width=4)
    found = token_counts.token_counts(blocks, 70_001, width=4).collect()
    assert sorted(r.n_tokens for r in found) == [1, 3]


def test_a_large_raw_file_is_many_tasks(spark, tmp_path):
    """Over 2 GB, mostly a hole, and a small one whose name needs care."""
    n, ends = (1 << 30) + 4321, [5, 70_000, 1 << 29, (1 << 30) + 17]
    with open(tmp_path / "large.bin", "wb") as file:
        for at in ends:
            file.seek(2 * at)
            file.write(np.array([9], "<u2").tobytes())
        file.truncate(2 * n)
    (tmp_path / "a #1 %20é.bin").write_bytes(np.array([1, 2, 9, 3], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_counts.read_flat(spark, f"{tmp_path}/*.bin", block_tokens=1 << 20)
    found = sorted((r.start, r.n_tokens) for r in token_counts.token_counts(blocks, 9).collect())
    starts = [0, *[e + 1 for e in ends]]
    assert found == sorted([(0, 2), (3, 1), *zip(starts, np.diff([-1, *ends, n]) - 1)])
    small = token_counts.read_flat(spark, f"{tmp_path}/a*.bin", block_tokens=1)
    spread = small.select("block", F.spark_partition_id().alias("task")).distinct()
    assert spread.count() == 4 and spread.select("task").distinct().count() > 1
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple of 2"):
        token_counts.read_flat(spark, f"{tmp_path}/odd.bin").collect()


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "ngram_jaccard":
            sets = {r.doc_id: brute.grams(r.text, 5) for r in before.collect()}
            links = [
                (a, b) for a in sets for b in sets
                if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            ]
            root = brute.groups(sets, links)
            assert {r.doc_id for r in docs.collect()} == set(root.values())
        if name == "substring_dedup":
            want = brute.removed([(r.doc_id, r.text) for r in before.collect()], 50)
            for r in docs.collect():
                n, gone, sha = want[r.doc_id][0]
                assert brute.sha(r.text) == sha if gone else True
        assert docs.count() <= count
        count = docs.count()
    assert count > 100
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert placed.select("doc_id").distinct().count() == count
    bins = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert bins.filter("n <> m or n > 4096").count() == 0


def test_near_copies_are_told_apart_by_row(spark, docs, rows):
    draw = random.Random(9)
    a, b, c, d = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(100)) for _ in range(4))
    near = lambda t: t + " more"
    given = [
        (1, a), (7, near(a)), (7, b),  # the second 7 is no copy
        (8, c), (8, c), (8, c), (9, near(c)),  # equal rows
        (10, d), (10, near(d)), (None, a), (None, a), (11, ""), (11, ""), (12, None),
    ]
    found = corpus_pipeline.ngram_jaccard(spark, docs(given, "kept"), SF)
    texts = [(r.doc_id, r.text) for r in found.collect()]
    assert sum(x[0] == 10 for x in texts) == 1
    want = [(1, a), (7, b), (8, c), (None, a), (None, a), (11, ""), (11, ""), (12, None)]
    assert sorted((x for x in texts if x[0] != 10), key=str) == sorted(want, key=str)


def test_stages_take_nulls_and_empty_tables(spark, docs, corpus):
    for table in (docs(corpus, "kept"), docs([], "kept")):
        for _, step in corpus_pipeline.STAGES[:-1]:
            table_out = step(spark, table, SF)
            assert table_out.columns == table.columns
            table_out.count()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).count()
