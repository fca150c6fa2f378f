"""Query of the embedding near-dedup, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.llm.embedding_dedup import near_vectors
from touchline.llm.queries import query, table

SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), fine AS (
  SELECT vec_id, e FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v LEFT JOIN counts c ON v.vec_id = c.a JOIN least m ON v.vec_id = m.a
"""


@query("op1_embedding_near_dedup", SQL)
def op1(spark, sf):
    found = near_vectors(table(spark, sf, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"),
    )
