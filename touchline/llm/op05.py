"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from touchline.llm.jaccard_trie import jaccard_join
from touchline.llm.queries import query, table


@query("op5_ngram_jaccard_join")
def op5(spark, sf):
    joined = jaccard_join(table(spark, sf, "documents"), n_words=4, num=85, den=100)
    return joined.select(joined["doc"].alias("doc_id"), "n_shingles", "component_id", "class_id", "n_links")
