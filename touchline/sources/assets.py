"""Listing of stored audio files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.tables import _or_empty

ASSETS = "file_name string, bytes bigint"


def list_assets(spark: SparkSession, path: str, pattern: str = "*.mp3", folders: Sequence[str] = ()) -> DataFrame:
    """Names and sizes of the files; their content is pruned and never read.

    ``folders`` names the levels ``name=value/`` the files are stored in; each
    becomes a text column.
    """
    levels = [F.regexp_extract("path", rf"/{level}=([^/]*)/", 1).alias(level) for level in folders]
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return _or_empty(
        spark,
        lambda: reader.load(path).select(
            F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
            F.col("length").alias("bytes"),
            *levels,
        ),
        ", ".join([ASSETS, *(f"{level} string" for level in folders)]),
    )
