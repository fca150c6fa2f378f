"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are hashed shapes of its words (case, accents, digits, closing
signs, length), pairs of shapes, repetitions at short distance and, with less
weight, the words.  Their square-root shares, weighted by inverse document
frequency, are projected onto the leading singular vectors of a bounded sample
of labelled texts.  The labelled vectors are sent to the tasks; each block of
texts is multiplied with all of them, and the nearest vote with a power of
their cosine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.groups import flat
from touchline.llm.text import SPACED, Words, buffers, lists, mix, slices, words_of

FEATURES = 2048
#: Labelled rows that a model is made of at most.
SAMPLE_ROWS = 4000
RANK = 48
NEAREST = 15
#: Bytes of texts whose terms are held at once, and of a piece of a longer text.
SLICE = PIECE = 1 << 19
SPACE = re.compile(rb"[\x20\x09-\x0D]")
POWER = 8.0

TERMS = T.StructType([
    T.StructField("label", T.DoubleType()), T.StructField("term", T.ArrayType(T.IntegerType(), False)),
    T.StructField("share", T.ArrayType(T.DoubleType(), False)),
])
SCORES = T.StructType([T.StructField("doc", T.LongType()), T.StructField("score", T.DoubleType())])

# Kinds of bytes: lower, upper, digit, beyond ASCII, and each sign as itself.
_KIND = np.arange(256, dtype=np.int64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 4


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) of every occurrence of a term, in no order."""
    h, first = words.hash, words.first
    n = len(h)
    doc = words.doc
    begin = _KIND[words.data[words.start]] if n else np.zeros(0, np.int64)
    second = _KIND[words.data[np.minimum(words.start + 1, words.end - 1)]] if n else begin
    last = _KIND[words.data[words.end - 1]] if n else begin
    size = np.minimum(words.end - words.start, 24) // 4
    shape = ((begin * 256 + second) * 256 + last).astype(np.uint64)
    made = [(doc, shape, 1.0), (doc, shape * np.uint64(8) + size.astype(np.uint64) + np.uint64(1 << 40), 0.5)]
    place = np.arange(n) - np.repeat(first[:-1], words.counts)
    pair = np.flatnonzero(place >= 1)
    reduced = (begin * 256 + last).astype(np.uint64)
    made.append((doc[pair], reduced[pair - 1] * np.uint64(65536) + reduced[pair] + np.uint64(2 << 40), 0.7))
    for gap in (1, 2, 3, 4):
        at = np.flatnonzero(place >= gap)
        same = (h[at] == h[at - gap]).astype(np.uint64)
        made.append((doc[at], same + np.uint64((3 << 40) + 2 * gap), 1.0))
    made.append((doc, h & ~np.uint64(7), 0.2))
    return (
        np.concatenate([m[0] for m in made]),
        (np.concatenate([mix(m[1] + np.uint64(1)) for m in made]) % np.uint64(FEATURES)).astype(np.int64),
        np.concatenate([np.full(len(m[0]), m[2]) for m in made]),
    )


def _sums(column: pa.Array) -> np.ndarray:
    words = words_of(column, SPACED)
    doc, term, weight = _terms(words)
    return np.bincount(doc * FEATURES + term, weight, minlength=words.n_docs * FEATURES).reshape(words.n_docs, FEATURES)


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at: cut.start()]
        at = cut.start()
    yield text[at:]


def matrix(column: pa.Array, piece: int = PIECE) -> np.ndarray:
    """Square-root term shares, one row per text; rows of empty texts are 0.

    A text longer than ``piece`` bytes is added up piece by piece; pairs and
    repetitions of words across a cut are not counted.
    """
    sizes = np.diff(buffers(column)[1])
    if (sizes <= piece).all():
        sums = _sums(column)
    else:
        sums = np.zeros((len(column), FEATURES))
        for row in range(len(column)):
            if sizes[row] <= piece:
                sums[row] = _sums(column.slice(row, 1))[0]
                continue
            for part in _pieces(column[row].as_buffer().to_pybytes(), piece):
                sums[row] += _sums(pa.array([part], pa.large_binary()))[0]
    total = sums.sum(1, keepdims=True)
    return np.sqrt(np.divide(sums, total, out=np.zeros_like(sums), where=total > 0))


@dataclass
class Model:
    projection: np.ndarray  # FEATURES x RANK
    vectors: np.ndarray  # labelled rows, unit length
    labels: np.ndarray
    prior: float

    def latent(self, shares: np.ndarray) -> np.ndarray:
        out = shares @ self.projection
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def score(self, shares: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the prior without any.

        All that are as near as the last of the nearest vote too."""
        if not len(self.labels):
            return np.full(len(shares), self.prior)
        near = self.latent(shares) @ self.vectors.T
        k = min(NEAREST, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        row, top = np.nonzero(near >= least[:, None])
        weight = np.maximum(near[row, top], 0.0) ** POWER
        total = np.bincount(row, weight, minlength=len(shares))
        voted = np.bincount(row, weight * self.labels[top], minlength=len(shares))
        return np.clip(np.divide(voted, total, out=np.full(len(shares), self.prior), where=total > 0), 0.0, 1.0)


def fit(shares: np.ndarray, labels: np.ndarray) -> Model:
    """Model of a labelled sample; without one every score is 0.5."""
    if not len(labels):
        return Model(np.zeros((FEATURES, 1)), np.zeros((0, 1)), labels, 0.5)
    df = (shares > 0).sum(0)
    idf = np.log((1.0 + len(labels)) / (1.0 + df)) + 1.0
    # Right singular vectors are the eigenvectors of the products of columns,
    # which are added up in blocks of rows to spare the driver's memory.
    products = np.zeros((FEATURES, FEATURES))
    for at in range(0, len(shares), 512):
        block = shares[at: at + 512] * idf
        products += block.T @ block
    _, vectors = np.linalg.eigh(products)
    right = vectors[:, ::-1][:, : min(RANK, len(labels))]
    model = Model(right * idf[:, None], np.zeros((0, 1)), labels.astype(np.float64), float(labels.mean()))
    model.vectors = model.latent(shares)
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            shares = matrix(part.column(1))
            rows, terms = np.nonzero(shares)
            counts = np.bincount(rows, minlength=len(shares)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column(0), lists(terms, counts, pa.int32()), lists(shares[rows, terms], counts, pa.float64()),
            ], names=TERMS.names)


def _scorer(sent, text: int | None):
    """Scores of the text column, or of field ``text`` of rows that are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(1) if text is None else batch.column(1).flatten()[text]
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), texts.cast(pa.string())], names=["row", "text"])
            for part in slices(own, "text", SLICE):
                for at in range(0, part.num_rows, 256):
                    block = part.slice(at, 256)
                    rows = batch.slice(block.column(0)[0].as_py(), block.num_rows)
                    score = pa.array(model.score(matrix(block.column(1))))
                    kept = [rows.column(1)] if text is not None else []
                    yield pa.RecordBatch.from_arrays([rows.column(0), score, *kept], names=[*SCORES.names, "row"][: 2 + len(kept)])

    return run


def train(docs: DataFrame, labelled: DataFrame, id_column: str, text_column: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model of at most ``sample_rows`` rows of ``labelled`` (doc, label), those of the least hash."""
    chosen = labelled.filter("doc is not null and label is not null").orderBy(
        F.xxhash64("doc"), "doc", "label",
    ).limit(sample_rows)
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text")).join(chosen, "doc")
    # Repeated ids give more rows than were chosen; the bound holds all the same, by a fixed order.
    rows = rows.orderBy("doc", "label", F.xxhash64("text"), "text").limit(sample_rows)
    table = rows.select("label", "text").mapInArrow(_sampled, TERMS).toArrow()
    shares = np.zeros((table.num_rows, FEATURES), np.float32)
    if table.num_rows:
        terms, first = flat(table.column("term"))
        values, _ = flat(table.column("share"))
        shares[np.repeat(np.arange(table.num_rows), np.diff(first)), terms] = values
    return fit(shares, table.column("label").to_numpy())


def score_quality(
    docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS, keep_row: bool = False,
) -> DataFrame:
    """(doc, score) for every row of ``docs``; a higher score means that label 1 is likelier.

    With ``keep_row`` there is a third column ``row``, a struct of the input row.

    ``labelled`` has (doc, label) with label 0 or 1; only these rows teach, of
    which at most ``sample_rows`` are taken.  Nothing but the text goes into a
    score.  Null and empty texts score the share of label 1 in the sample, and
    all texts score 0.5 if there is no sample.  Rows with null or repeated ids
    are scored like all others, null labels and label rows without a document
    are left out, and equal texts have equal scores up to rounding.  Of labelled
    rows with equal ids those that come first by label and hash of the text
    teach.  Neighbours that tie with the last one that votes vote too.  Texts of
    any length are read whole, in pieces.  An empty table gives an
    empty table; further columns are ignored.
    """
    model = train(docs, labelled, id_column, text_column, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    doc = F.col(id_column).cast("long").alias("doc")
    if keep_row:  # the text goes through Python once, inside its row
        source = docs.select(doc, F.struct(*docs.columns).alias("row"))
        place = docs.columns.index(text_column)
        return source.mapInArrow(_scorer(sent, place), T.StructType([*SCORES.fields, source.schema["row"]]))
    source = docs.select(doc, F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_scorer(sent, None), SCORES)


def held_out(id_column):
    """Whether a row must not teach: crc32 of its id as text is 1 modulo 3."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1
