"""Query of the token counts: documents as flat token files, counted by a scan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.queries import query, table
from touchline.llm.token_counts import token_counts, write_flat

SEPARATOR = 49407


def names(blocks):
    """(file, ordinal, doc): which document stands at which place of a file.

    A block names at most the documents that were put in while it filled up;
    places go on from block to block.
    """
    counted = blocks.select("file", "block", F.size("docs").alias("n"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("file", "block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("first"))
    return blocks.select("file", "block", "docs").join(starts, ["file", "block"]).select(
        "file", "first", F.posexplode("docs").alias("i", "doc"),
    ).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc")


@query("op10_token_counts")
def op10(spark, sf):
    blocks = write_flat(table(spark, sf, "documents"), separator=SEPARATOR)
    counts = token_counts(blocks, SEPARATOR)
    return names(blocks).join(counts, ["file", "ordinal"]).select(
        F.col("doc").alias("doc_id"), "n_tokens", "file", "ordinal", "start",
    )
