"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone; there
is no ring or table to keep.  With one more shard, the rows that move go into
the new shard and no other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.sources.stage import stage

CHUNK_ROWS = 100_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard (0 to shards - 1) of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    at = np.zeros(len(state), np.int64)
    while len(moving):
        shard[moving] = at[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        at[moving] = ((at[moving] + 1) * (2147483648.0 / draw)).astype(np.int64)
        moving = moving[at[moving] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a row by its long key; null keys have null shards."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(key)


def numbered(rows: DataFrame, group: str, order: list[Column], chunk_by: Column, name: str = "slot") -> DataFrame:
    """Gapless numbers from 0 inside each group, with no task for a whole group.

    Groups are cut into chunks by a hash; rows are numbered inside a chunk and
    moved up by the rows of the chunks before, which a small table holds.
    """
    stored = stage(rows, "numbered")
    chunks = max(1, -(-stored.count() // CHUNK_ROWS))
    chunked = stored.withColumn("chunk_", F.pmod(F.xxhash64(chunk_by), F.lit(chunks)))
    sizes = chunked.groupBy(group, "chunk_").agg(F.count("*").alias("rows_"))
    before = Window.partitionBy(group).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "chunk_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("start_"))
    place = F.row_number().over(Window.partitionBy(group, "chunk_").orderBy(*order)) - 1
    return (
        chunked.withColumn("place_", place).join(starts, [group, "chunk_"])
        .withColumn(name, (F.col("start_") + F.col("place_")).cast("long")).drop("chunk_", "place_", "start_")
    )


def shard(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(doc, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The law is ``key``: the id and the number of shards decide.  The id is
    spread by a 64-bit hash first, since neighbouring ids are alike.
    ``grown_shard`` is the shard with one shard more; it is ``shard`` or the
    new one.  ``size`` is the UTF-8 bytes of the text plus 1, 1 for a null
    text, whose crc32 is that of no bytes.  ``slot`` is gapless from 0 in each
    shard.  Rows with a null id have the hash of null as key, so they are one
    shard's.  Rows with equal ids go to one shard and get slots of their own.
    An empty table gives an empty table; further columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_column))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"),
    )
    chunk = F.struct("doc", "size", "text_crc32")
    return numbered(rows, "shard", [F.col("doc"), F.col("size"), F.col("text_crc32")], chunk)
