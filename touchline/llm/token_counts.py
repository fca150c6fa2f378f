"""Token counts from flat token files by a scan for the separator.

A flat file holds the ids of many documents one after the other, each followed
by the separator; there is no index.  It is read in blocks that begin anywhere,
also inside a document.  In a block the separators are found at once, with one
comparison over the array.  What a block leaves open, the ids after its last
separator, is stitched to the next block by a prefix scan over block summaries
(tokens, separators, tail), first inside runs of RUN blocks, then over runs, so
that no task holds the summaries of a whole large file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from touchline.llm.text import lists, slices
from touchline.llm.tokens import tokenizer_path, word_tokenizer
from touchline.sources.stage import stage

BLOCK_TOKENS = 1 << 18
RUN = 4096
# Blocks of raw files in one task, 128 MB with two bytes an id.
TASK_BLOCKS = 256

BLOCKS = T.StructType([
    T.StructField("file", T.LongType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()),
    T.StructField("docs", T.ArrayType(T.LongType())),
])
SCANNED = T.StructType([
    T.StructField("file", T.LongType()), T.StructField("block", T.LongType()), T.StructField("tokens", T.LongType()),
    T.StructField("seps", T.LongType()), T.StructField("tail", T.LongType()),
    T.StructField("ends", T.ArrayType(T.LongType(), False)),
])


def _flat_files(path: str, separator: int, block_tokens: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path, specials_are_text=True)
        file = TaskContext.get().partitionId()
        kind, block, docs = f"<u{width}", 0, []
        held: list[np.ndarray] = []
        size = 0

        def out(data: np.ndarray) -> pa.RecordBatch:
            nonlocal block, docs
            made = pa.RecordBatch.from_arrays([
                pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data.tobytes()], pa.binary()),
                pa.array([docs], pa.list_(pa.int64())),
            ], names=BLOCKS.names)
            block, docs = block + 1, []
            return made

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, counts = tokenizer.encode(part.column(1))
                stream = np.insert(ids.astype(kind), np.cumsum(counts), np.array(separator, kind))
                names = part.column(0).to_pylist()
                held.append(stream)
                size += len(stream)
                docs += names
                while size >= block_tokens:
                    joined = np.concatenate(held)
                    yield out(joined[:block_tokens])
                    held, size = [joined[block_tokens:]], size - block_tokens
        if size or docs:
            yield out(np.concatenate(held))

    return run


def write_flat(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None,
    separator: int = 49407, block_tokens: int = BLOCK_TOKENS, width: int = 2,
) -> DataFrame:
    """Flat token files of a table as stored blocks (file, block, data, docs).

    Every task writes one file; ``docs`` names the documents in the order in
    which they were put in, with no word on where they begin.  Strings of
    special tokens in a text are plain text, so the separator stands only
    between documents.  A null text has no tokens and its separator.  Ids and
    the separator have to fit into ``width`` bytes.
    """
    path = path or tokenizer_path()
    most = max(word_tokenizer(path, specials_are_text=True).encoder.get_vocab().values(), default=0)
    if not 0 <= separator < 1 << 8 * width or most >= 1 << 8 * width:
        raise ValueError(f"ids up to {most} and the separator {separator} do not fit into {width} bytes")
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    made = source.mapInArrow(_flat_files(path, separator, block_tokens, width), BLOCKS)
    return stage(made, "flat_tokens")


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path inside it of a file as Spark lists it."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    scheme, _, rest = path.partition("://")
    return pa.fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{quote(rest)}")


def _can_seek(path: str) -> bool:
    """Whether byte ranges of the file can be read here, past Spark's reader."""
    try:
        system, inside = _file_system(path)
        return system.get_file_info(inside).type == pa.fs.FileType.File
    except (OSError, ValueError, ImportError, NotImplementedError):
        return False


def _whole_ids(size: int, width: int) -> None:
    if size % width:
        raise ValueError(f"a file has {size} bytes, no multiple of {width}")


def _block(file: int, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()),
        pa.array([None], pa.list_(pa.int64())),
    ], names=BLOCKS.names)


def _ranges(width: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _whole_ids(row["length"], width)
                at = row["block"] * step
                size = min(step, row["length"] - at)
                system, inside = _file_system(row["path"])
                with system.open_input_file(inside) as source:
                    data = source.read_at(size, at)
                if len(data) != size:
                    raise OSError(f"{row['path']} has changed: {len(data)} of {size} bytes at {at}")
                yield _block(row["file"], row["block"], data)

    return run


def _contents(width: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _whole_ids(len(data), width)
                for block, at in enumerate(range(0, len(data), step)):
                    yield _block(file, block, data[at: at + step])

    return run


def read_flat(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw token files at a path, cut from the bytes as they stand.

    ``file`` numbers are hashes of the file names.  Files are listed with
    their lengths; every block is a byte range that a task reads by itself, so
    a file of any size is spread over many tasks.  All workers have to see the
    path: on a shared disk, or on a file system that pyarrow opens.  From any
    other one Spark hands a file over as one value, of 2 GB at most.  Trailing
    bytes that make no whole id are an error.
    """
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(path)
    listed = files.filter("length > 0").select(F.xxhash64("path").alias("file"), "path", "length")
    size = listed.agg(F.sum(F.ceil(F.col("length") / step)).alias("blocks"), F.min("path").alias("any")).first()
    if size["any"] is not None and not _can_seek(size["any"]):
        return files.select(F.xxhash64("path").alias("file"), "content").mapInArrow(_contents(width, step), BLOCKS)
    # The number is given, so that the few bytes of the ranges are not put into one task again.
    blocks = size["blocks"] or 1
    tasks = max(math.ceil(blocks / TASK_BLOCKS), min(blocks, spark.sparkContext.defaultParallelism))
    ranges = listed.withColumn("block", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")))
    return ranges.repartition(tasks).mapInArrow(_ranges(width, step), BLOCKS)


def scan_block(data: bytes, separator: int, width: int) -> tuple[int, np.ndarray, int]:
    """Ids in the block, places of the separators, and ids after the last one."""
    ids = np.frombuffer(data, f"<u{width}")
    at = np.flatnonzero(ids == separator)
    return len(ids), at, len(ids) - (int(at[-1]) + 1 if len(at) else 0)


def _scanner(separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_block(x or b"", separator, width) for x in batch.column(2).to_pylist()]
            counts = np.array([len(x[1]) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array(counts),
                pa.array([x[2] for x in found], pa.int64()),
                lists(np.concatenate([np.zeros(0, np.int64), *[x[1] for x in found]]), counts, pa.int64()),
            ], names=SCANNED.names)

    return run


def token_counts(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document of the flat files.

    ``blocks`` has (file, block, data); blocks of a file are numbered in order.
    ``ordinal`` is the place of the document in its file and ``start`` that of
    its first token, both from 0.  Separators are not counted.  A document
    without tokens counts 0; ids after the last separator of a file are a
    document of their own, none if there are none.  Blocks without data or
    with null data are empty; an empty table gives an empty table.
    """
    scanned = stage(
        blocks.select("file", "block", "data").mapInArrow(_scanner(separator, width), SCANNED), "scanned",
    )
    summaries = scanned.select("file", "block", "tokens", "seps", "tail").withColumn("run", F.expr(f"block div {RUN}"))

    def before(rows: DataFrame, group: list[str], order: str) -> DataFrame:
        """Tokens, separators and open tokens before each row of a group."""
        past = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        total = F.coalesce(F.sum("tokens").over(past), F.lit(0))
        # Tokens up to the last separator before: the end of a row less its tail.
        ended = F.when(F.col("seps") > 0, F.col("stop") - F.col("tail"))
        rows = rows.withColumn("tokens_before", total).withColumn("stop", F.col("tokens_before") + F.col("tokens"))
        closed = F.max(ended).over(past)
        return rows.withColumn("seps_before", F.coalesce(F.sum("seps").over(past), F.lit(0))).withColumn(
            "closed_before", closed,
        )

    inner = before(summaries, ["file", "run"], "block")
    runs = summaries.groupBy("file", "run").agg(
        F.sum("tokens").alias("tokens"), F.sum("seps").alias("seps"), F.max_by("tail", "block").alias("last_tail"),
    )
    ends = inner.groupBy("file", "run").agg(F.max(F.when(F.col("seps") > 0, F.col("stop") - F.col("tail"))).alias("closed"))
    runs = runs.join(ends, ["file", "run"]).withColumn("tail", F.col("tokens") - F.coalesce("closed", F.lit(0)))
    outer = before(runs.select("file", "run", "tokens", "seps", "tail"), ["file"], "run").select(
        "file", "run", F.col("tokens_before").alias("run_tokens"), F.col("seps_before").alias("run_seps"),
        F.col("closed_before").alias("run_closed"),
    )
    starts = inner.join(outer, ["file", "run"]).select(
        "file", "block", (F.col("run_tokens") + F.col("tokens_before")).alias("at"),
        (F.col("run_seps") + F.col("seps_before")).alias("ordinal_at"),
        F.coalesce(F.col("run_tokens") + F.col("closed_before"), "run_closed", F.lit(0)).alias("closed_at"),
    )
    # A document ends at a separator and begins after the one before it, or
    # where the last block that had one left off.
    docs = scanned.join(starts, ["file", "block"]).select(
        "file", "ordinal_at", "at", F.posexplode(F.expr(
            "zip_with(ends, concat(array(closed_at - at - 1), slice(ends, 1, greatest(size(ends) - 1, 0))),"
            " (stop, before) -> named_struct('stop', stop, 'before', before))",
        )).alias("i", "d"),
    ).filter("d.stop is not null").select(
        "file", (F.col("ordinal_at") + F.col("i")).alias("ordinal"),
        (F.col("at") + F.col("d.before") + 1).alias("start"),
        (F.col("d.stop") - F.col("d.before") - 1).alias("n_tokens"),
    )
    # What follows the last separator of a file.
    last = outer.join(
        runs.select("file", "run", "tokens", "seps", "tail"), ["file", "run"],
    ).groupBy("file").agg(F.max(F.struct(
        "run", (F.col("run_seps") + F.col("seps")).alias("ordinal"), (F.col("run_tokens") + F.col("tokens")).alias("stop"),
        F.when(F.col("seps") > 0, F.col("run_tokens") + F.col("tokens") - F.col("tail"))
        .otherwise(F.coalesce("run_closed", F.lit(0))).alias("closed"),
    )).alias("x"))
    open_end = last.filter("x.stop > x.closed").select(
        "file", F.col("x.ordinal").alias("ordinal"), F.col("x.closed").alias("start"),
        (F.col("x.stop") - F.col("x.closed")).alias("n_tokens"),
    )
    return docs.unionByName(open_end)
