"""Lookups by pair of teams and by similar name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.names import alike, surname
from touchline.operators.joins import attach

PAIR = ["home_fd", "away_fd"]


# --- pairs of teams --------------------------------------------------------


def same_pair(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of two pairs in either order, usable as a join key."""
    return (F.least(*left) == F.least(*right)) & (F.greatest(*left) == F.greatest(*right))


def latest_per_pair(rows: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """One row per ordered pair; of several the last listed counts."""
    return rows.groupBy(*PAIR).agg(*[F.max_by(v, order).alias(v) for v in values])


def pair_values(
    matches: DataFrame,
    per_pair: DataFrame,
    home_value: str,
    away_value: str,
    spread_by: Sequence[str],
) -> DataFrame:
    """Attach a home and an away value by exact pair, else swapped from the reverse pair."""
    exact = per_pair.select(*PAIR, F.col(home_value).alias("_h1"), F.col(away_value).alias("_a1"))
    swapped = per_pair.select(
        F.col("away_fd").alias("home_fd"), F.col("home_fd").alias("away_fd"),
        F.col(away_value).alias("_h2"), F.col(home_value).alias("_a2"),
    )
    # Both orders are put side by side first, so that the matches are joined once.
    both = exact.withColumn("_exact", F.lit(True)).join(swapped, PAIR, "full")
    out = attach(matches, both, PAIR, spread_by)
    return (
        out.withColumn(home_value, F.when(F.col("_exact"), F.col("_h1")).otherwise(F.col("_h2")))
        .withColumn(away_value, F.when(F.col("_exact"), F.col("_a1")).otherwise(F.col("_a2")))
        .drop("_h1", "_a1", "_h2", "_a2", "_exact")
    )


def pair_round(matches: DataFrame, rounds: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Round by exact pair, else reverse pair, else 0.  ``rounds`` has one row per pair."""
    found = pair_values(
        matches,
        rounds.select(*PAIR, F.col("round").alias("_r"), F.col("round").alias("_r_again")),
        "_r", "_r_again", spread_by,
    )
    return found.withColumn("match_round", F.coalesce("_r", F.lit(0)).cast("int")).drop(
        "_r", "_r_again"
    )


def rows_of_pairs(rows: DataFrame, wanted: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Rows of the wanted pairs: exact order, reverse order only where exact has none.

    ``wanted`` has distinct pairs.  The result carries the wanted orientation
    as ``want_home`` and ``want_away``.
    """
    present = rows.select(*PAIR).distinct()
    exact = wanted.join(present, PAIR).select(
        *PAIR, F.col("home_fd").alias("want_home"), F.col("away_fd").alias("want_away")
    )
    reverse = (
        wanted.join(present, PAIR, "left_anti")
        .select(
            F.col("away_fd").alias("_h"), F.col("home_fd").alias("_a"),
            F.col("home_fd").alias("want_home"), F.col("away_fd").alias("want_away"),
        )
        .withColumnsRenamed({"_h": "home_fd", "_a": "away_fd"})
    )
    return attach(rows, exact.unionByName(reverse), PAIR, spread_by, "inner")


def with_content(matches: DataFrame, content: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the matches that have at least one content row."""
    return matches.join(content.select(*keys).distinct(), list(keys), "left_semi")


# --- similar names ---------------------------------------------------------


def _stems(rest: Column) -> Column:
    """Beginnings of a text whose lengths are powers of two."""
    # The binary form of a length has one digit more than its power of two.
    powers = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.length(rest))) - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.when(F.length(rest) > 0, F.transform(powers, lambda n: F.substring(rest, F.lit(1), n))).otherwise(
        F.array().cast("array<string>"),
    )


def held_pieces(holders: DataFrame, text: str, pieces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``holders``, less ``text``, with every ``piece`` that the text contains; ``pieces`` are distinct.

    A piece stands in a text where it begins one of its suffixes.  A suffix and
    a piece meet by their stem, the longest beginning of the piece whose length
    is a power of two, and by ``keys``, and are then compared.  A text of n
    letters makes at most n * (1 + log2 n) rows, those with a stem no piece has
    go before they are shuffled where the pieces are few.  Spark knows the size
    of the texts, not that of these rows, which are never broadcast.  A text
    that holds a piece several times meets it as often; nulls meet nothing, the
    empty piece meets every text.
    """
    asked = pieces.filter("piece is not null").withColumn("_stem", F.coalesce(F.try_element_at(_stems(F.col("piece")), F.lit(-1)), F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    suffixes = holders.filter(F.col(text).isNotNull()).withColumn("_at", F.explode(starts)).withColumn(
        "_rest", F.substring(F.col(text), F.col("_at"), F.length(text)),
    )
    empty = F.when(F.col("_at") == 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    stemmed = suffixes.withColumn("_stem", F.explode(F.concat(empty, _stems(F.col("_rest")))))
    known = stemmed.join(asked.select(*keys, "_stem").distinct(), [*keys, "_stem"], "left_semi")
    met = known.hint("merge").join(asked, [*keys, "_stem"])
    return met.filter(F.startswith("_rest", "piece")).drop(text, "_at", "_rest", "_stem")


def _first_containing(dimension: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted ``piece``, the place of the first dimension name that holds it, in any case of letters."""
    texts = dimension.select("ord", F.lower("name").alias("_text"))
    return held_pieces(texts, "_text", wanted.distinct()).groupBy("piece").agg(F.min("ord").alias("ord"))


def by_alike_name(rows: DataFrame, dimension: DataFrame, name: str, how: str = "left") -> DataFrame:
    """Columns of the dimension row whose ``name`` equals the one of ``rows`` but for case and accents.

    The names meet by an equality join of their collation, which shuffles or
    broadcasts as any other.  Where several dimension rows are alike, the one
    with the least ``ord`` counts; ``name`` keeps the spelling of ``rows``.
    """
    first = dimension.withColumn("_alike", alike(F.col("name"))).groupBy("_alike").agg(F.min("ord").alias("ord"))
    found = dimension.withColumnRenamed("name", "alike_name").join(first, "ord", "left_semi")
    found = found.withColumn("_alike", alike(F.col("alike_name")))
    return rows.withColumn("_alike", alike(F.col(name))).join(found, "_alike", how).drop("_alike", "ord")


def season_stats_of(names: DataFrame, stats: DataFrame, fold: Column | None = None) -> DataFrame:
    """Season statistics per distinct player name.

    An exact name wins; else the first dimension row whose name contains the
    player's surname.  ``names`` has one column ``player``.
    """
    exact = stats.groupBy("name").agg(F.min("ord").alias("_exact"))
    asked = names.select("player", surname(F.col("player") if fold is None else fold).alias("_last"))
    pieces = _first_containing(stats, asked.select(F.col("_last").alias("piece")))
    pieces = pieces.withColumnsRenamed({"ord": "_partial", "piece": "_last"})
    found = (
        asked
        .join(exact.withColumnRenamed("name", "player"), "player", "left")
        .join(pieces, "_last", "left")
        .withColumn("ord", F.coalesce("_exact", "_partial"))
        .select("player", "ord")
    )
    return found.join(stats.withColumnRenamed("name", "stats_name"), "ord", "left").drop("ord")


def goal_cry_of(names: DataFrame, cries: DataFrame, default: tuple[str, str, str]) -> DataFrame:
    """Goal cry, language and flag per distinct player name.

    An exact name wins; else the first dimension row that contains the name
    or is contained in it; else the default.
    """
    exact = cries.groupBy("name").agg(F.min("ord").alias("_exact"))
    asked = names.select(F.lower("player").alias("piece"))
    wider = _first_containing(cries, asked).withColumnsRenamed({"ord": "_wider", "piece": "_low"})
    key_names = cries.groupBy(F.lower("name").alias("piece")).agg(F.min("ord").alias("_inner"))
    narrower = (
        held_pieces(names.select("player", F.lower("player").alias("_text")), "_text", key_names)
        .groupBy("player")
        .agg(F.min("_inner").alias("_narrower"))
    )
    found = (
        names.withColumn("_low", F.lower("player"))
        .join(exact.withColumnRenamed("name", "player"), "player", "left")
        .join(wider, "_low", "left")
        .join(narrower, "player", "left")
        .withColumn("ord", F.coalesce("_exact", F.least("_wider", "_narrower")))
        .select("player", "ord")
        .join(cries.drop("name"), "ord", "left")
    )
    cry, language, flag = default
    return found.select(
        "player",
        F.coalesce("cry", F.lit(cry)).alias("goal_cry"),
        F.coalesce("language", F.lit(language)).alias("goal_language"),
        F.coalesce("flag", F.lit(flag)).alias("goal_flag"),
    )


def with_default(
    rows: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]
) -> DataFrame:
    """Dimension columns by key; unknown keys get the default values."""
    out = rows.join(dimension.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
