"""Token ids of texts by a tokenizer whose merges never cross white space.

The vocabulary used here drops white space, so the ids of a text are those of
its white-space-separated words in order.  A word is encoded when it is new and
looked up afterwards.  A task process keeps one memory of words; when it is
full, the words used once are forgotten, which changes no id.
"""

from __future__ import annotations

import functools
import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from touchline.llm.text import buffers

REMEMBERED_WORDS = 500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """``specials_are_text``: strings of special tokens in a text are plain text."""

    def __init__(self, path: str, specials_are_text: bool = False):
        # One thread: Spark runs a task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = specials_are_text
        self.kind = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        self.number: dict[bytes, int] = {}
        self.uses = np.zeros(0, np.int64)
        # Ids of all words end to end, and where each word's begin.
        self.ids, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        base = len(self.number)
        parts, counts = [self.ids], []
        for at in range(0, len(words), 5000):
            made = self.encoder.encode_batch_fast([w.decode() for w in words[at: at + 5000]], add_special_tokens=False)
            lists = [e.ids for e in made]
            counts += map(len, lists)
            parts.append(np.fromiter((i for x in lists for i in x), self.kind))
        self.number.update(zip(words, range(base, base + len(words))))
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.ids = np.concatenate(parts)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.array(counts, np.int64))])

    def _forget(self) -> None:
        """Keep the words that were used again since they were learned."""
        keep = np.flatnonzero(self.uses > 1)
        if 2 * len(keep) > REMEMBERED_WORDS:
            keep = keep[np.argsort(-self.uses[keep], kind="stable")[: REMEMBERED_WORDS // 2]]
        place = np.full(len(self.uses), -1)
        place[keep] = np.arange(len(keep))
        places = place.tolist()
        self.number = {w: places[n] for w, n in self.number.items() if places[n] >= 0}
        self.ids, self.at = self._of(keep)
        self.uses = np.ones(len(keep), np.int64)

    def _of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these numbers end to end, and where each word's begin."""
        length = self.at[numbers + 1] - self.at[numbers]
        stop = np.cumsum(length)
        place = np.repeat(self.at[numbers] - stop + length, length) + np.arange(int(length.sum()))
        return self.ids[place], np.concatenate([[0], stop])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each; nulls have none."""
        data, offsets = buffers(column)
        raw = data.tobytes()
        words: list[bytes] = []
        ends = [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words += raw[a:b].split()
            ends.append(len(words))
        if len(self.number) > REMEMBERED_WORDS:
            self._forget()
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[i] for i in new)))
            numbers[new] = np.fromiter((self.number[words[i]] for i in new), np.int64, len(new))
        del words
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        ids, at = self._of(numbers)
        return ids, np.diff(at[ends])


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str, specials_are_text: bool = False) -> WordTokenizer:
    """The tokenizer of this process, with the words that earlier tasks taught it."""
    return WordTokenizer(path, specials_are_text)
