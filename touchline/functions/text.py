"""Text forms of minutes and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a digit of a score is spoken, 0 to 9.
SPOKEN = ["nil", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

# Private-use characters that frame a score while it is rewritten.
_OPEN, _CLOSE = "\ue000", "\ue001"


def ordinal(number: Column) -> Column:
    last = F.pmod(number, F.lit(10))
    teen = F.pmod(number, F.lit(100)).between(11, 13)
    ending = (
        F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    )
    return F.concat(number.cast("string"), ending)


def score_words(text: Column, strict: bool = False) -> Column:
    """``2-1`` becomes ``two-one`` and ``1-1`` becomes ``one all``.

    ``strict`` leaves scores alone that touch a letter or digit, as in a
    season label such as 2023-24.  Texts without a score, nearly all of them,
    are passed on after one search.
    """
    pattern = r"\b([0-9])-([0-9])\b" if strict else r"([0-9])-([0-9])"
    out = F.regexp_replace(text, pattern, f"{_OPEN}$1$2{_CLOSE}")
    for digit, word in enumerate(SPOKEN):
        out = F.replace(out, F.lit(f"{_OPEN}{digit}{digit}{_CLOSE}"), F.lit(f"{word} all"))
    for digit, word in enumerate(SPOKEN):
        out = F.replace(out, F.lit(f"{_OPEN}{digit}"), F.lit(f"{word}-"))
    for digit, word in enumerate(SPOKEN):
        out = F.replace(out, F.lit(f"{digit}{_CLOSE}"), F.lit(word))
    return F.when(text.rlike(pattern), out).otherwise(text)


def score_text(home: Column, away: Column) -> Column:
    return F.concat(home.cast("string"), F.lit("-"), away.cast("string"))


def score_part(score: Column, side: int) -> Column:
    """Home (0) or away (1) goals out of ``h-a``; 0 when there is no score."""
    return F.coalesce(F.get(F.split(score, "-"), F.lit(side)).try_cast("int"), F.lit(0))
