"""Work on each row once, as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.incremental import unseen
from touchline.sources.tables import read_table

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def checkpoint_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """Folder for the progress of a stream, under ``folder`` or the shared folder of the session."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append_unseen(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    name: str,
    work: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    folder: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Append what ``work`` makes of rows whose key is not in the table yet.

    ``keys`` name one row, such as match and event: rows of a match that come
    in later batches are added then, and a row that comes twice, in one batch
    or in several, is stored once, however late.

    Keys of the stream are known by its keyed state, in RocksDB under the
    checkpoint, so a batch reads itself and the state of its own keys, not the
    table.  The table is read at two places only: the keys it held before the
    stream stored anything are written beside the progress once and looked up
    there, and the first batch of a run, which may have been stopped halfway in
    the run before, is compared with the stored rows.
    """
    spark = stream.sparkSession
    progress = checkpoint_folder(spark, name, folder)
    before = f"{progress}-before"
    key_schema = stream.select(*keys).schema
    if not _exists(spark, f"{progress}/commits"):
        read_table(spark, path, key_schema).distinct().write.mode("overwrite").parquet(before)
    earlier = read_table(spark, before, key_schema)
    has_earlier = not earlier.isEmpty()
    resumed = True

    def step(batch: DataFrame, _: int) -> None:
        nonlocal resumed
        own = batch.sparkSession
        rows = batch
        if has_earlier:
            rows = unseen(rows, read_table(own, before, key_schema), keys)
        if resumed:
            touched = rows.select(keys[0]).distinct()
            stored = read_table(own, path, key_schema).join(touched, keys[0], "left_semi")
            rows = unseen(rows, stored, keys)
        work(rows).write.mode("append").parquet(path)
        resumed = False

    once = stream.dropDuplicates(list(keys))
    provider = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return (
            once.writeStream.foreachBatch(step)
            .option("checkpointLocation", progress)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        if provider is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, provider)
