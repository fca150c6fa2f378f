"""Working only on what is new, and replacing what is to be done again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.conform import contains_text


def unseen(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not worked on yet; ``done`` is cut to its keys first."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def without_team(existing: DataFrame, pattern: str) -> DataFrame:
    """Existing rows except those of matches of the team."""
    hit = contains_text(F.col("home_fd"), pattern) | contains_text(F.col("away_fd"), pattern)
    return existing.filter(~hit)


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def regenerate(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of existing rows with the same key; running it twice changes nothing."""
    return append(unseen(existing, new, keys), new)
