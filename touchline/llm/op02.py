"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.llm.licenses import license_scan
from touchline.llm.queries import query, table


@query("op2_license_scan")
def op2(spark, sf):
    found = license_scan(table(spark, sf, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("detections")["label"])))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score",
    )
