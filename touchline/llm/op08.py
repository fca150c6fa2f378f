"""Query of the best-fit packing."""

from __future__ import annotations

from touchline.llm.packing import pack
from touchline.llm.queries import query, table


@query("op8_best_fit_packing")
def op8(spark, sf):
    placed = pack(table(spark, sf, "documents"), 4096, keep_ids=False)
    return placed.select(
        placed["doc"].alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    )
