"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.llm.quality import held_out, score_quality
from touchline.llm.queries import query, table


def teaching(spark, sf):
    """(doc, label) of the labelled rows that are not held out."""
    return table(spark, sf, "labels").filter(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc"), F.col("quality").cast("double").alias("label"),
    )


@query("op3_quality_classifier")
def op3(spark, sf):
    scored = score_quality(table(spark, sf, "documents"), teaching(spark, sf))
    return scored.select(
        F.col("doc").alias("doc_id"), F.coalesce(held_out(F.col("doc")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
