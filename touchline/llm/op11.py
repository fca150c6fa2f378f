"""Query of the periodic run detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.llm.periodic_runs import periodic_runs
from touchline.llm.queries import query, table

WORDS = r"[^\x20\x09-\x0D]+"


def planted(docs):
    """Documents of which those whose id has a crc32 that 10 divides get a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.withColumn("h_", h).withColumn(
        "w_", F.when(F.col("h_") % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))),
    )
    ended = words.withColumn("n_", F.size("w_")).withColumn("g_", F.expr("h_ div 10")).withColumn("a_", F.expr("try_mod(g_, n_)"))
    ended = ended.withColumn("p_", F.expr("1 + (n_ - a_) div (3 + g_ % 8)"))
    text = F.expr(
        "array_join(transform(sequence(0, n_ - 1), i -> get(w_, cast(if(i >= a_, a_ + (i - a_) % p_, i) as int))), ' ')",
    )
    return ended.withColumn("text", F.when(F.col("n_") > 0, text).otherwise(F.col("text"))).select(*docs.columns)


def digest(found):
    """One row per document: the longest run, and digests of all runs and of what is left."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"),
    )))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        F.col("doc").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"), "n_words", "n_dropped",
    )


@query("op11_periodic_runs")
def op11(spark, sf):
    return digest(periodic_runs(planted(table(spark, sf, "documents")), keep_text=False))
