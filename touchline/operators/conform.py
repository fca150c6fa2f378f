"""Cleaning of raw rows: names, casts, dates, rounds, event predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numbers import lenient_double
from touchline.operators.joins import attach
from touchline.operators.running import block

# Event type, outcome and card names of the event feed.
SHOT, SUBSTITUTION = "Shot", "Substitution"
MISCONDUCT, FOUL = "Bad Behaviour", "Foul Committed"
GOAL = "Goal"
RED_PATTERN = "red|second yellow"

DEFAULT_X, DEFAULT_Y = 60.0, 40.0


# --- columns ---------------------------------------------------------------


def blank_to_null(value: Column, tokens: Sequence[str] = ("", "N/A")) -> Column:
    return F.when(~value.isin(*tokens), value)


def lenient_date(value: Column, pattern: str = "dd/MM/yyyy") -> Column:
    return F.try_to_date(value, pattern)


def name_of(value: Column) -> Column:
    """Name out of text that is either the name or JSON with a ``name``."""
    return F.when(value.startswith("{"), F.get_json_object(value, "$.name")).otherwise(value)


def coordinate(location: Column, axis: int) -> Column:
    return F.get(location, F.lit(axis)).cast("double")


def number_or_zero(value: Column) -> Column:
    return F.coalesce(lenient_double(value), F.lit(0.0))


def is_goal(outcome: Column) -> Column:
    return F.coalesce(outcome == GOAL, F.lit(False))


def is_red(card: Column) -> Column:
    return F.coalesce(F.lower(card).rlike(RED_PATTERN), F.lit(False))


def card_of(misconduct_card: Column, foul_card: Column) -> Column:
    return F.coalesce(misconduct_card, foul_card)


def contains_text(value: Column, pattern: str) -> Column:
    """Case-blind pattern test; null is no match."""
    return F.coalesce(value.rlike(f"(?i){pattern}"), F.lit(False))


def plays(home: Column, away: Column, team: str) -> Column:
    return (home == team) | (away == team)


def has_detail(
    home: Column, away: Column, round_: Column, focus_team: Column, from_round: int = 25
) -> Column:
    """Detail is shown for the focus team's matches from ``from_round`` on."""
    return ((home == focus_team) | (away == focus_team)) & (round_ >= from_round)


def usable_text(text: Column, least: int = 5) -> Column:
    return text.isNotNull() & (F.length(text) >= least) & (text != "nan")


# --- rows ------------------------------------------------------------------


def conform_names(
    df: DataFrame, names: DataFrame, columns: dict[str, str],
    feed_col: str = "feed_name", team_col: str = "team",
) -> DataFrame:
    """Add one conformed column per ``{source: target}``; unknown names pass through.

    ``names`` has one row per feed name.  No join hint is given: Spark
    broadcasts it when its size allows and falls back to a shuffle join.
    """
    out = df
    for source, target in columns.items():
        lookup = names.select(F.col(feed_col).alias("_from"), F.col(team_col).alias("_to"))
        out = (
            out.join(lookup, out[source] == F.col("_from"), "left")
            .withColumn(target, F.coalesce(F.col("_to"), F.col(source)))
            .drop("_from", "_to")
        )
    return out


def unmapped_names(
    df: DataFrame, names: DataFrame, columns: Sequence[str], feed_col: str = "feed_name"
) -> DataFrame:
    """Names in use that the dimension does not know, with their row counts."""
    used = df.select(F.explode(F.array(*columns)).alias("name")).groupBy("name").count()
    known = names.select(F.col(feed_col).alias("name"))
    return used.join(known, "name", "left_anti").withColumnRenamed("count", "uses")


def assign_round(
    df: DataFrame, keys: Sequence[str], date_col: str, row_col: str, per_round: int = 9
) -> DataFrame:
    """Round = place in date order // matches per round + 1, within ``keys``.

    ``row_col`` is the row number in the source; it settles equal dates.  The
    place itself, counted from 1, stays in the column ``place``.
    """
    # Rows inside a block of a day, blocks inside a day, days: no window holds
    # more than a block, the blocks of a day or the days of a key.
    days, blocks = [*keys, date_col], [*keys, date_col, "_block"]

    def before(rows: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
        past = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("_n").over(past), F.lit(0)))

    cut = df.withColumn("_block", block(F.col(row_col)))
    counts = cut.groupBy(*blocks).agg(F.count("*").alias("_n"))
    of_days = before(counts.groupBy(*days).agg(F.sum("_n").alias("_n")), list(keys), date_col, "_days").drop("_n")
    starts = before(counts, days, "_block", "_blocks").drop("_n").join(of_days, days)
    placed = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*blocks).orderBy(row_col)))
    placed = placed.join(starts, blocks, "left").select(
        *df.columns, (F.col("_row") + F.coalesce("_blocks", F.lit(0)) + F.coalesce("_days", F.lit(0))).alias("place"),
    )
    return placed.withColumn("round", (F.floor((F.col("place") - 1) / per_round) + 1).cast("int"))


def rounds_available(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rounds and, beside each, the last one of its season."""
    rounds = df.select(*keys, "round").distinct()
    last = rounds.groupBy(*keys).agg(F.max("round").alias("last_round"))
    return rounds.join(last, list(keys))


def prefer_given_round(
    df: DataFrame, given: DataFrame, keys: Sequence[str], given_col: str = "match_week"
) -> DataFrame:
    """Take the round stated by the feed where there is one."""
    stated = given.select(*keys, F.col(given_col).cast("int").alias("_given"))
    joined = attach(df, stated, keys, keys, "left", salts=1)
    return joined.withColumn("round", F.coalesce("_given", "round")).drop("_given")


def focus_matches(matches: DataFrame, focus_team: str, pattern: str | None = None) -> DataFrame:
    """The focus team's matches, one row each, optionally only some opponents."""
    home, away = F.col("home_fd"), F.col("away_fd")
    mine = matches.filter(plays(home, away, focus_team))
    if pattern:
        mine = mine.filter(contains_text(home, pattern) | contains_text(away, pattern))
    return mine.dropDuplicates(["match_id"])
