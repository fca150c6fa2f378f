"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.llm.language import identify
from touchline.llm.quality import held_out
from touchline.llm.queries import query, table


@query("op12_language_id")
def op12(spark, sf):
    docs = table(spark, sf, "documents")
    teaching = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("doc"), "text", "lang")
    found = identify(docs, teaching)
    return found.select(
        F.col("doc").alias("doc_id"), F.coalesce(held_out(F.col("doc")), F.lit(False)).alias("held_out"),
        F.col("lang").alias("lang_pred"), "score",
    )
