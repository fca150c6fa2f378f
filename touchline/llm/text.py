"""Words of many texts at once, as numpy arrays over an Arrow string column.

A batch of texts is one byte buffer.  Words are found by a table of separator
bytes and get 64-bit hashes without a Python loop over words.  Work goes over
pieces of the buffer cut between words, so memory follows the piece and the
number of words, not the longest text times a constant per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes whose powers are kept, and of texts whose words are held at once: a
#: worker's memory is some forty times the latter, beside the batch.
PIECE = 1 << 18
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD1342543DE82EF95 | 1)
_MASK = (1 << 64) - 1


def _table(separators) -> np.ndarray:
    word = np.ones(256, bool)
    word[list(separators)] = False
    return word


#: Words between ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Runs of digits, lower-case letters and all that is not ASCII.
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: bytes.translate table for ALNUM words: lower case, separators to blanks.
NORMAL = bytes(LOWER[i] if ALNUM[LOWER[i]] else 0x20 for i in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept and grown in steps."""
    kept = _powers.get(int(base))
    if kept is None or len(kept[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        made = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            np.multiply.accumulate(p, out=p)
            made.append(p)
        kept = _powers[int(base)] = (made[0], made[1])
    return kept[0][:n], kept[1][:n]


@dataclass
class Words:
    """Words of ``n_docs`` texts, in order; ``first`` has n_docs + 1 places."""

    hash: np.ndarray  # uint64 per word
    first: np.ndarray  # first word of each text
    start: np.ndarray  # first byte of each word, counted in the buffer
    end: np.ndarray
    data: np.ndarray  # the bytes
    offsets: np.ndarray  # first byte of each text

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningful where valid(k)."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, np.uint64)
        power, inverse = _power_tables(_GRAM, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * power[:n], out=total[1:])
        out = np.zeros(n, np.uint64)
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1])
        return out

    def valid(self, k: int) -> np.ndarray:
        """Whether k words of the same text start at each word."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))
        return left >= k


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def words_of(column: pa.Array, word: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of every text of a column."""
    data, offsets = buffers(column)
    kind = word[LOWER] if lower else word
    is_word = kind[data]
    # A word starts where a word byte follows a separator or begins a text.
    # The last text byte before an offset ends a word likewise.
    begins, ends = is_word.copy(), is_word.copy()
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins[1:] &= ~is_word[:-1] | cut[1:-1]
        ends[:-1] &= ~is_word[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    w = 0
    while w < len(start):
        at = int(start[w])
        stop = max(w + 1, int(np.searchsorted(end, at + PIECE, "right")))
        to = int(end[stop - 1])
        power, inverse = _power_tables(_BASE, to - at + 1)
        piece = data[at:to]
        values = (LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum(values * power[: to - at], out=total[1:])
        s, e = start[w:stop] - at, end[w:stop] - at
        hashes[w:stop] = mix((total[e] - total[s]) * inverse[s])
        w = stop
    first = np.searchsorted(start, offsets, "left")
    first[-1] = len(start)
    return Words(hashes, first, start, end, data, offsets)


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text, one text at least."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(name)))
    row = 0
    while row < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), batch.num_rows)
        yield batch.slice(row, stop - row)
        row = stop


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each place on, for the places that have so many."""
    if len(values) < width:
        return values[:0]
    step, out = 1, values
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - step: width - step + n])
    return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column with counts[i] of the values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
