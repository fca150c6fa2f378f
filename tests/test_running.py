"""Chunked running values against plain Python, with one key holding most rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.operators import conform, joins, running
from touchline.sources.stage import Scope, stage


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    keys = ["hot"] * 400 + [rng.choice("abc") for _ in range(200)]
    rng.shuffle(keys)
    return [(k, rng.randrange(40), i, rng.choice([None, 0, 1, 2])) for i, k in enumerate(keys)]


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_values(spark, skewed, width):
    df = spark.createDataFrame(skewed, "k string, minute int, i bigint, v int")
    order = [F.col("minute"), F.col("i")]
    out = running.running(
        df, ["k"], order, [F.col("minute"), running.block(F.col("i"), width)],
        sums={"total": F.col("v")}, mins={"least": F.col("i")},
    )
    got = {r["i"]: (r["total"], r["least"]) for r in out.collect()}
    want = {}
    for key in {r[0] for r in skewed}:
        total, least = 0, None
        for _, _, i, v in sorted((r for r in skewed if r[0] == key), key=lambda r: (r[1], r[2])):
            total += v or 0
            least = i if least is None else min(least, i)
            want[i] = (total, least)
    assert got == want


def test_numbered(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, minute int, i bigint, v int")
    out = running.numbered(df, ["k"], [F.col("i")], [running.block(F.col("i"), 16)], "n")
    for key in ("hot", "a"):
        mine = sorted((r["i"], r["n"]) for r in out.filter(F.col("k") == key).collect())
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_next_values(spark, skewed, width):
    df = spark.createDataFrame(skewed, "k string, minute int, i bigint, v int")
    out = running.running(df, ["k"], [F.col("i")], [running.block(F.col("i"), width)], nexts={"after": F.col("i")})
    got = {r["i"]: r["after"] for r in out.collect()}
    for key in {r[0] for r in skewed}:
        mine = sorted(r[2] for r in skewed if r[0] == key)
        assert [got[i] for i in mine] == [*mine[1:], None]


@pytest.mark.parametrize("width", [1, 3, 64])
def test_every_step(spark, width):
    rows = [("a", 1, 4), ("b", 5, 6), ("c", 7, 7), ("d", -3, 2), ("e", 60, 200)]
    df = spark.createDataFrame(rows, "k string, since int, until int")
    out = running.every_step(df, "since", "until", "n", width)
    assert out.schema["n"].dataType == df.schema["since"].dataType
    assert sorted((r["k"], r["_since"], r["n"]) for r in out.collect()) == sorted((k, a, n) for k, a, b in rows for n in range(a, b))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_placed(spark, skewed, keys):
    """One key, and one leading value, hold most rows; null keys are a key of their own."""
    rows = [(None if k == "b" else k, 0 if i % 3 else minute, i, v) for k, minute, i, v in skewed]
    df = spark.createDataFrame(rows, "k string, minute int, i bigint, v int").repartition(7)
    out = running.placed(df, keys, [F.col("minute"), -F.col("i")], "n")
    assert out.columns == ["k", "minute", "i", "v", "n"]
    got = {r["i"]: r["n"] for r in out.collect()}
    for group in ([{r[0]} for r in rows] if keys else [{r[0] for r in rows}]):
        mine = sorted((r for r in rows if r[0] in group), key=lambda r: (r[1], -r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    assert running.placed(df.limit(0), keys, [F.col("i")], "n").collect() == []


def test_placed_needs_no_single_task(spark):
    df = spark.range(1000).withColumn("k", F.lit(1))
    for keys in ([], ["k"]):
        plan = running.placed(df, keys, [F.col("id")], "n")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def test_hot_key_is_cut(spark, skewed):
    """No window group of the wide rows is larger than the chunk."""
    df = spark.createDataFrame(skewed, "k string, minute int, i bigint, v int")
    parts = df.groupBy("k", running.block(F.col("i"), 16)).count()
    assert parts.agg(F.max("count")).first()[0] <= 16
    plan = running.numbered(df, ["k"], [F.col("i")], [running.block(F.col("i"), 16)], "n")
    assert "hashpartitioning(k" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach(spark, skewed, how):
    df = spark.createDataFrame(skewed, "k string, minute int, i bigint, v int")
    facts = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, f int")
    out = joins.attach(df, facts, ["k"], ["i"], how, salts=5)
    plain = df.join(facts, "k", how)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_by_measured_hot_keys(spark, skewed, how):
    rows = [(None if k == "b" else k, *rest) for k, *rest in skewed] + [(f"cold{i}", 0, 1000 + i, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, minute int, i bigint, v int")
    hot = joins.hot_keys(df, ["k"], salts=10)
    shares = Counter(r[0] for r in rows)
    assert dict(hot) == {(k,): -(-n * 10 // len(rows)) for k, n in shares.items() if n * 10 > len(rows)}
    assert ("hot",) in dict(hot) and len(hot) < 10
    facts = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3), ("cold7", 4), (None, 5)], "k string, f int")
    out = joins.attach(df, facts, ["k"], ["i"], how, hot=hot)
    want = sorted(map(tuple, df.join(facts, "k", how).collect()), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want
    # The hot key is on as many parts as its share asks for, a cold one on one; cold facts are not repeated.
    n = joins._parts(["k"], hot)
    parts = df.groupBy("k").agg(F.countDistinct(F.pmod(F.xxhash64("i"), n)).alias("n"))
    found = {r["k"]: r["n"] for r in parts.collect()}
    assert found["hot"] == dict(hot)[("hot",)] and found["cold7"] == 1
    assert facts.select(F.sum(n)).first()[0] == sum(dict(hot).get((k,), 1) for k in ("hot", "a", "z", "cold7", None))
    assert joins.hot_keys(df.limit(0), ["k"]) == []
    plain = joins.attach(df, facts, ["k"], ["i"], how, hot=joins.hot_keys(df.filter("i >= 1000"), ["k"]))
    assert sorted(map(tuple, plain.collect()), key=str) == want


def test_copies_and_offsets_are_not_broadcast(spark, skewed):
    """Small facts are not broadcast once they are repeated, offsets are not where every row is a chunk."""
    df = spark.createDataFrame(skewed, "k string, minute int, i bigint, v int")
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    attached = joins.attach(df, facts, ["k"], ["i"])
    chunked = running.running(df, ["k", "i"], [F.col("minute")], [F.col("minute")], sums={"total": F.col("v")})
    for found in (attached, chunked):
        assert found.count() == len(skewed)
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_of_two_columns(spark):
    rows = [(1, "x")] * 6 + [(1, "y")] + [(2, "x")] * 3
    df = spark.createDataFrame(rows, "a int, b string")
    assert joins.hot_keys(df, ["a", "b"], salts=4) == [((1, "x"), 3), ((2, "x"), 2)]


def test_top_by(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, minute int, i bigint, v int")
    out = joins.top_by(df, ["k"], [F.desc("i")], 3)
    for key in ("hot", "b"):
        want = sorted((r[2] for r in skewed if r[0] == key), reverse=True)[:3]
        assert sorted((r["i"] for r in out.filter(F.col("k") == key).collect()), reverse=True) == want
    # The cut is made before the shuffle too.
    assert str(out._jdf.queryExecution().executedPlan()).count("WindowGroupLimit") == 2


def test_stage_tables_of_a_scope_go_with_it(spark, tmp_path):
    with Scope(spark) as outer:
        with Scope(spark) as inner:
            first = stage(spark.range(3), "first")
            kept = inner.keep(first.filter("id > 0"), "kept")
        assert kept.count() == 2 and len(outer.made) == 1
        with pytest.raises(Exception):
            spark.read.parquet(inner.made[0])
    with pytest.raises(Exception):
        spark.read.parquet(outer.made[0])
    assert stage(spark.range(2), "plain").count() == 2


def test_rounds_are_numbered_in_levels(spark):
    """No window goes over the blocks of all days of a season, however rows and days are mixed."""
    rng = random.Random(11)
    given = [(rng.choice("ab"), rng.randrange(60), i) for i in rng.sample(range(running.CHUNK * 12), 3000)]
    df = spark.createDataFrame(given, "season string, day int, row bigint")
    out = conform.assign_round(df, ["season"], "day", "row", 9)
    want = {}
    for season in "ab":
        for n, r in enumerate(sorted(r for r in given if r[0] == season)):
            want[r] = (n + 1, n // 9 + 1)
    assert {(r["season"], r["day"], r["row"]): (r["place"], r["round"]) for r in out.collect()} == want
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", out._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all(w.count(" ASC") == 1 for w in windows)
