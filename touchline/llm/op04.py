"""Queries of the two substring dedups, and the SQL of the first."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.llm.queries import query, table
from touchline.llm.seed_extend import seed_and_extend
from touchline.llm.suffix_array import suffix_dedup

SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, hash(w[i:i + 49]) AS h, md5(array_to_string(w[i:i + 49], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)
), owners AS (SELECT h, m, min(doc_id) AS owner FROM windows GROUP BY h, m HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS at
  FROM windows JOIN owners USING (h, m) WHERE doc_id > owner
), places AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words
), kept AS (
  SELECT p.doc_id, count(g.at) AS n_removed, string_agg(p.word, ' ' ORDER BY p.at) FILTER (WHERE g.at IS NULL) AS t
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""


def digests(cut):
    return cut.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


@query("op4_substring_dedup", SQL)
def op4(spark, sf):
    return digests(seed_and_extend(table(spark, sf, "documents"), 50, keep_text=False))


@query("op7_suffix_array_dedup", SQL)
def op7(spark, sf):
    return digests(suffix_dedup(table(spark, sf, "documents"), 50, keep_text=False))
