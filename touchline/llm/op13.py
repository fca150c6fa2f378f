"""Query of the spelling variants."""

from __future__ import annotations

from touchline.llm.queries import query, table
from touchline.llm.spelling import count_words, spelling_variants

SHORTEST, OFTEN, RATIO = 7, 2, 10


def misspelt(code: int, word: bytes) -> bytes:
    """The run without one code point where 31 divides the crc32 of id and run."""
    if code % 31:
        return word
    letters = word.decode()
    at = code % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


@query("op13_spelling_variants")
def op13(spark, sf):
    words = count_words(table(spark, sf, "documents"), SHORTEST, spell=misspelt).filter(f"n >= {OFTEN}")
    return spelling_variants(words, RATIO).select("word", "form", "root", "n", "n_near", "form_n")
