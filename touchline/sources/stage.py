"""Stage tables: the results of one step written for the next ones.

A step that several later steps read is written once as Parquet.  That cuts
the plan, lets the readers prune columns and push filters, and survives the
loss of executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None
# The scopes open here; each thread, such as that of a stream's batches, has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def stage_folder(spark: SparkSession) -> str:
    """Folder for stage tables: the shared one the session names.

    Only a local session without that setting gets a temporary folder.
    """
    global _local_folder
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/touchline"
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="touchline-")
    return _local_folder.name


def stage_run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a step."""
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder and return the table read back."""
    spark = df.sparkSession
    path = stage_run_folder(spark, name)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """Stage tables that go when a ``with`` block ends, save those that are kept.

    For a job whose result is stored elsewhere, or in a kept table, at the end
    of the block.  A kept table belongs to the block around, if there is one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scope:
        self.made: list[str] = []
        self.entered = _scopes.set((*_scopes.get(), self.made))
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        inside = _scopes.set(_scopes.get()[:-1])
        try:
            return stage(df, name)
        finally:
            _scopes.reset(inside)

    def __exit__(self, *_) -> None:
        _scopes.reset(self.entered)
        for path in self.made:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
