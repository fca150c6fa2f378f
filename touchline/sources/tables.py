"""Stage tables: Parquet with declared schemas, CSV and JSON at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rounds that have a folder each, a power of two; and the column for the others.
SINGLE_ROUNDS, LATER = 64, "later"
_SINGLE_BITS = SINGLE_ROUNDS.bit_length() - 1


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A Parquet table; no rows when nothing was written there yet."""
    return _or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV export; unreadable values become null."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return _or_empty(spark, lambda: reader.csv(path), schema)


def _or_empty(spark: SparkSession, read, schema: str | StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, schema)
        raise


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Write Parquet.  With partition columns only the partitions present in ``df`` are replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_counted(df: DataFrame, path: str, **figures: Column) -> dict[str, int]:
    """Write a table and return its ``rows``, and further aggregates, taken while it is written.

    The observed rows are those of the last stage, so that a task that is run
    again is counted once.
    """
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()]), path)
    return seen.get


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def first_of_folder(round_: int) -> int:
    """First of the rounds that share a folder with ``round_``.

    Rounds up to ``SINGLE_ROUNDS`` have a folder each.  Beyond, each doubling
    of the rounds is cut into half as many folders, so their number grows with
    the logarithm of the rounds, and none holds more than one part in
    ``SINGLE_ROUNDS / 2`` of them.
    """
    if round_ <= SINGLE_ROUNDS:
        return round_
    return round_ - (round_ - 1) % (1 << ((round_ - 1).bit_length() - _SINGLE_BITS))


def _first_of_folder(round_: Column) -> Column:
    width = F.pow(F.lit(2), F.length(F.bin(round_ - 1)) - _SINGLE_BITS).cast("int")
    return F.when(round_ <= SINGLE_ROUNDS, round_).otherwise(round_ - F.pmod(round_ - 1, width))


def write_by_round(df: DataFrame, path: str, keys: Sequence[str] = (), replace: bool = False) -> None:
    """Store a table by round, so that a reader of one round opens one folder; see ``read_by_round``.

    With ``replace`` the folders of rounds that ``df`` does not hold stay.

    A folder is named by its first round, see ``first_of_folder``, and column
    ``LATER`` has how much later a row's round is.  The folders are the rounds
    of all seasons together.  Rows are brought into ranges of round and season
    first, so that a task writes into few folders and a round with many seasons
    is spread over several tasks.  A table stored before there was ``LATER``
    has a folder for each round, and goes on to.
    """
    by = ["round", *keys]
    if not replace or LATER in df.sparkSession.read.parquet(path).columns:
        first, round_ = _first_of_folder(F.col("round")), F.col("round")
        df = df.withColumns({"round": first, LATER: (round_ - first).cast("int")})
        by = ["round", LATER, *keys]
    kept = "dynamic" if replace else "static"
    df.repartitionByRange(*by).write.mode("overwrite").option("partitionOverwriteMode", kept).partitionBy("round").parquet(path)


def read_by_round(
    spark: SparkSession, path: str, low: int | None = None, high: int | None = None, whole: bool = False
) -> DataFrame:
    """A table of ``write_by_round``, or its rounds from ``low`` to ``high``, of which only the folders are read.

    ``whole`` gives all rows of these folders.
    """
    stored, round_ = spark.read.parquet(path), F.col("round")
    if low is not None:
        stored = stored.filter(round_ >= first_of_folder(low))
    if high is not None:
        stored = stored.filter(round_ <= high)
    if LATER in stored.columns:
        stored = stored.withColumn("round", round_ + F.coalesce(LATER, F.lit(0))).drop(LATER)
    if low is not None and not whole:
        stored = stored.filter(round_ >= low)
    if high is not None and not whole:
        stored = stored.filter(round_ <= high)
    return stored


def read_round(spark: SparkSession, path: str, round_: int) -> DataFrame:
    return read_by_round(spark, path, round_, round_)


def nested_by_round(table: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One JSON text per round for a page that wants a whole table at once.

    A list holds one league table or one top list.
    """
    fields = [c for c in table.columns if c not in (*keys, "round")]
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order])))
    return table.groupBy(*keys, "round").agg(F.to_json(rows).alias("rows"))
