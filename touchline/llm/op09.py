"""Query of the sharding."""

from __future__ import annotations

from touchline.llm.queries import query, table
from touchline.llm.sharding import shard

SHARDS = 16


@query("op9_sharding")
def op9(spark, sf):
    rows = shard(table(spark, sf, "documents"), SHARDS)
    return rows.select(rows["doc"].alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
