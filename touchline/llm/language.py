"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as bytes, in windows of WINDOW bytes end to end.  One gated
recurrent network reads a window forwards and one backwards; at every position
the two states together give probabilities of the languages.  A document's
probabilities are the mean over the positions of its letters.

The network is trained with numpy by backpropagation through time, each
position of a window being labelled with the language of its document, on a
bounded sample: at most SAMPLE_DOCS documents of each language (those of least
hash) and SAMPLE_WINDOWS windows of each, taken from all over its text.  The
weights, some 100 kB whatever the data, are sent to the tasks.
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
from pyspark.sql.window import Window

from touchline.llm.groups import small
from touchline.llm.text import buffers, slices
from touchline.sources.stage import stage

#: Documents of each language that teach at most, and windows of each.
SAMPLE_DOCS = 800
SAMPLE_WINDOWS = 12
WINDOW = 64
HIDDEN = 12
STEPS = 240
BATCH = 256
RATE = 0.02
CLIP = 1.0
AT_ONCE = 2048
BATCH_BYTES = 1 << 20
UNKNOWN = "und"

SAMPLE = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()),
    T.StructField("window", T.BinaryType()),
])
MODEL = T.StructType([T.StructField("langs", T.ArrayType(T.StringType(), False)), T.StructField("weights", T.ArrayType(T.BinaryType(), False))])
SCORES = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
])

#: Bytes of letters: ASCII letters and all that is not ASCII.
LETTER = np.zeros(256, np.float32)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = 1

_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; far from 0 the exponential may overflow to a share of 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(score: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    score -= score.max(0)
    np.exp(score, out=score)
    score /= score.sum(0)
    return score


@dataclass
class Direction:
    """One gated recurrent network: what each byte adds to the gates, and the recurrent weights."""

    byte: np.ndarray  # 256 x 3H: update, reset, candidate
    gates: np.ndarray  # H x 2H
    candidate: np.ndarray  # H x H

    def run(self, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; ``steps`` is time x rows of bytes."""
        size = len(self.candidate)
        h = np.zeros((steps.shape[1], size), np.float32)
        out = np.empty((*steps.shape, size), np.float32)
        gate_of, candidate_of = np.ascontiguousarray(self.byte[:, : 2 * size]), np.ascontiguousarray(self.byte[:, 2 * size:])
        for t in range(len(steps)):
            gate = h @ self.gates
            gate += gate_of.take(steps[t], 0)
            _sigmoid(gate)
            z, r = gate[:, :size], gate[:, size:]
            n = (r * h) @ self.candidate
            n += candidate_of.take(steps[t], 0)
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, n))
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out

    def back(self, steps: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gradients of byte, gates and candidate, from those of the states, back through time."""
        size = len(self.candidate)
        d_byte, d_gates, d_candidate = (np.zeros_like(w) for w in (self.byte, self.gates, self.candidate))
        carried = np.zeros_like(grad[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, n = kept[t]
            dh = grad[t] + carried
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            d_rh = dn @ self.candidate.T
            dr = d_rh * h * r * (1 - r)
            d_gate = np.concatenate([dz, dr], 1)
            carried = dh * z + d_rh * r + d_gate @ self.gates.T
            d_gates += h.T @ d_gate
            d_candidate += (r * h).T @ dn
            # Rows of equal bytes are added up by a product with their one-hot rows.
            one = np.zeros((len(h), 256), np.float32)
            one[np.arange(len(h)), steps[t]] = 1
            d_byte += one.T @ np.concatenate([d_gate, dn], 1)
        return d_byte, d_gates, d_candidate


@dataclass
class Model:
    langs: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [
            self.ahead.byte, self.ahead.gates, self.ahead.candidate,
            self.behind.byte, self.behind.gates, self.behind.candidate, self.out, self.bias,
        ]

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Language x time x row: probabilities at each position; ``steps`` is time x rows of bytes."""
        size = len(self.ahead.candidate)
        score = self.out[:size].T @ self.ahead.run(steps).reshape(-1, size).T
        score += (self.out[size:].T @ self.behind.run(steps[::-1]).reshape(-1, size).T).reshape(-1, *steps.shape)[:, ::-1].reshape(score.shape)
        score += self.bias[:, None]
        return _softmax(score).reshape(-1, *steps.shape)

    def gradients(self, steps: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all positions, in the order of ``weights``."""
        ahead, behind = [], []
        size = len(self.ahead.candidate)
        forward, backward = self.ahead.run(steps, ahead), self.behind.run(steps[::-1], behind)
        states = np.concatenate([forward, backward[::-1]], 2)
        flat = states.reshape(-1, 2 * size)
        score = _softmax((flat @ self.out + self.bias).T).T
        score[np.arange(len(score)), np.tile(label, len(steps))] -= 1
        score /= np.float32(len(score))
        d_states = (score @ self.out.T).reshape(states.shape)
        return [
            *self.ahead.back(steps, ahead, d_states[:, :, :size]),
            *self.behind.back(steps[::-1], behind, d_states[::-1, :, size:]),
            flat.T @ score, score.sum(0),
        ]


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 11) -> Model:
    draw = np.random.default_rng(seed)
    weight = lambda *shape: (draw.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
    one = lambda: Direction(weight(256, 3 * hidden) * np.float32(0.5), weight(hidden, 2 * hidden), weight(hidden, hidden))
    return Model(langs, one(), one(), weight(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def fit(windows: np.ndarray, label: np.ndarray, langs: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 11) -> Model:
    """Adam on batches with equal shares of the languages; ``windows`` is rows x WINDOW of bytes."""
    model = fresh(langs, hidden, seed)
    if len(langs) < 2:
        return model
    draw = np.random.default_rng(seed)
    members = [np.flatnonzero(label == i) for i in range(len(langs))]
    mean = [np.zeros_like(w) for w in model.weights]
    square = [np.zeros_like(w) for w in model.weights]
    for step in range(1, steps + 1):
        own = np.arange(BATCH) % len(langs)
        rows = np.array([members[i][draw.integers(len(members[i]))] for i in own])
        grads = model.gradients(np.ascontiguousarray(windows[rows].T), own)
        size = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        scale = min(1.0, CLIP / max(size, 1e-12))
        rate = RATE * (1 - step / (steps + 1))
        for w, g, m, s in zip(model.weights, grads, mean, square):
            g = g * np.float32(scale)
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            w -= np.float32(rate) * (m / np.float32(1 - 0.9 ** step)) / (np.sqrt(s / np.float32(1 - 0.99 ** step)) + np.float32(1e-8))
    return model


def _sampled(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes, places, windows = [], [], [], []
            for lang, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py().encode()
                # Windows stand at equal distances over the whole text.
                n = min(count, len(raw) // WINDOW)
                for i in range(n):
                    at = i * (len(raw) - WINDOW) // max(1, n - 1)
                    langs.append(lang), hashes.append(h), places.append(i), windows.append(raw[at: at + WINDOW])
            yield pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(windows, pa.binary()),
            ], names=SAMPLE.names)

    return run


def _fitted(steps: int, hidden: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, windows = [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            windows += batch.column(3).to_pylist()
        langs = sorted(set(names))
        place = {lang: i for i, lang in enumerate(langs)}
        rows = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)
        model = fit(rows, np.array([place[n] for n in names], np.int64), langs, steps, hidden)
        yield pa.RecordBatch.from_arrays([
            pa.array([langs], pa.list_(pa.string())), pa.array([[w.tobytes() for w in model.weights]], pa.list_(pa.binary())),
        ], names=MODEL.names)

    return run


def sampled(labelled: DataFrame, docs: int, windows: int) -> DataFrame:
    """(lang, h, at, window): windows of at most ``docs`` texts of each language.

    The texts of a language are counted first, and only those whose hash lies in
    a share that holds about twice ``docs`` of them are ranked, so that few
    texts of a frequent language are shuffled.
    """
    known = labelled.filter("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc", "text").alias("h"),
    ).filter("octet_length(text) > 0")
    counts = small(stage(known.groupBy("lang").agg(F.count("*").alias("texts")).select(F.col("lang").alias("lang_"), "texts"), "langs"))
    share = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) * F.col("texts") < F.lit((2 * docs + 64) << 30)
    known = known.join(counts, known["lang"] == counts["lang_"]).filter(share)
    ranked = known.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("at") <= docs)
    return ranked.select("lang", "h", "text").mapInArrow(_sampled(windows), SAMPLE)


def train(
    labelled: DataFrame, docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS, steps: int = STEPS, hidden: int = HIDDEN,
) -> Model:
    """Model of rows (doc, text, lang): at most ``docs`` of each language, of least hash of id and text.

    The bounded sample is brought to one task, which fits the model; only the
    weights come back.
    """
    sample = sampled(labelled, docs, windows)
    fitted = sample.repartition(1).sortWithinPartitions("lang", "h", "at", "window").mapInArrow(_fitted(steps, hidden), MODEL).collect()
    if not fitted:
        return fresh([], hidden)
    model = fresh(list(fitted[0].langs), hidden)
    for weight, raw in zip(model.weights, fitted[0].weights):
        weight[...] = np.frombuffer(raw, np.float32).reshape(weight.shape)
    return model


def document_means(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over the letters of each text; 0 for texts without any."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    end = np.minimum(start + WINDOW, offsets[doc + 1])
    sums = np.zeros((len(sizes), len(model.langs)))
    letters = np.zeros(len(sizes))
    if len(data):
        for r in range(0, len(doc), AT_ONCE):
            at = start[r: r + AT_ONCE, None] + np.arange(WINDOW)
            inside = at < end[r: r + AT_ONCE, None]
            rows = np.where(inside, data[np.minimum(at, len(data) - 1)], 0x20).astype(np.uint8)
            weight = np.ascontiguousarray((LETTER[rows] * inside).T)
            near = model.positions(np.ascontiguousarray(rows.T))
            for k, part in enumerate(near):
                sums[:, k] += np.bincount(doc[r: r + AT_ONCE], (part * weight).sum(0), minlength=len(sizes))
            letters += np.bincount(doc[r: r + AT_ONCE], weight.sum(0), minlength=len(sizes))
    return np.divide(sums, letters[:, None], out=sums, where=letters[:, None] > 0)


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if model.langs:
                    means = document_means(model, *buffers(part.column(1)))
                    best = means.argmax(1)
                    for i, text in enumerate(part.column(1)):
                        if text.is_valid and _LETTER.search(text.as_py()):
                            lang[i], score[i] = model.langs[best[i]], min(1.0, float(means[i, best[i]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=SCORES.names)

    return run


def identify(
    docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, steps: int = STEPS,
) -> DataFrame:
    """(doc, lang, score) for every row of ``docs``: the likeliest language and its probability.

    ``labelled`` has (doc, text, lang); only these rows teach, at most
    ``sample_docs`` of each language and ``sample_windows`` windows of each.
    Rows with a null language or text and texts shorter than a window teach
    nothing.  Nothing but the text goes into a prediction.

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts if nothing teaches; with one language all others are of it.  Texts of
    any length are read whole, a window at a time.  Of languages that tie the
    first by name is taken.  Rows with null or repeated ids are rows like
    others, and equal texts have equal results up to rounding.  An empty table
    gives an empty table; further columns are ignored.
    """
    model = train(labelled, sample_docs, sample_windows, steps)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_predict(sent), SCORES)
