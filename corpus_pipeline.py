"""Corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept.  All but the last give back the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.decontaminate import benchmark_hits
from touchline.llm.groups import row_key, small
from touchline.llm.jaccard_trie import jaccard_join
from touchline.llm.op03 import teaching
from touchline.llm.packing import pack
from touchline.llm.quality import score_quality
from touchline.llm.queries import QUERIES
from touchline.llm.seed_extend import seed_and_extend
from touchline.llm.repeats import without_repeats
from touchline.sources.stage import Scope, stage

SEQUENCE = 4096


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    kept = score_quality(docs, teaching(spark, sf_dir), keep_row=True).filter("score >= 0.5")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): the one with the least id.

    Of rows with that id, the one with the least hash of id and text stays; of
    rows equal in both, the one whose other columns are least.  Rows with a
    null id, and rows without words, stay.
    """
    with Scope(spark) as scope:
        joined = jaccard_join(docs, n_words=5, num=80, den=100, keep_key=True).filter("component is not null")
        least = stage(joined.filter("doc = component_id").select("component", "key"), "least")
        # Groups in which several rows share the least id.
        shared = least.groupBy("component").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
        tied = stage(least.join(shared.select("component", "first"), "component"), "tied")
        gone = joined.filter("doc <> component_id").select("key").unionAll(tied.filter("key <> first").select("key"))
        gone = small(scope.keep(gone.distinct().withColumnRenamed("key", "key_"), "gone"))
        equal = tied.filter("key = first").groupBy("key").count().filter("count > 1")
        equal = scope.keep(equal.select(F.col("key").alias("key_")), "equal")
    rows = docs.select(row_key("doc_id", "text").alias("key_"), F.struct(*docs.columns).alias("row_"))
    left = rows.join(gone, "key_", "left_anti")
    if not equal.isEmpty():
        equal = small(equal)
        one = left.join(equal, "key_", "left_semi").groupBy("key_").agg(F.min("row_").alias("row_"))
        left = left.join(equal, "key_", "left_anti").unionByName(one)
    return left.select(*[F.col("row_")[c].alias(c) for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document with a smaller id has."""
    with Scope(spark) as scope:
        cut = scope.keep(seed_and_extend(docs, 50).filter("n_removed > 0").select("key", "n_removed", "kept"), "cut")
    left = without_repeats(docs, cut, "doc_id", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = benchmark_hits(docs, benchmark, keep_row=True).filter(F.size("items") == 0)
    return hits.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens."""
    placed = pack(docs, SEQUENCE, keep_ids=False)
    return placed.select(
        F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Votes of neighbours and byte-pair ids are beyond SQL; the stages are tested
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
