"""Match results: typed rows, statistics, display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numbers import fixed, lenient_double, safe_int
from touchline.operators.conform import blank_to_null, lenient_date
from touchline.operators.running import placed

# Columns of a results file.  Home and away goals, half-time
# goals, shots, shots on target, corners, yellow and red cards.
IDENTITY_COLUMNS = ["Date", "HomeTeam", "AwayTeam"]
COUNT_COLUMNS = [
    "FTHG", "FTAG", "HTHG", "HTAG", "HS", "AS", "HST", "AST", "HC", "AC", "HY", "AY", "HR", "AR",
]
ODDS_COLUMNS = ("PSH", "PSD", "PSA")
ODDS_NAMES = ("match_resultH", "match_resultX", "match_resultA")
STATISTICS = [
    ("Shots", "HS", "AS"),
    ("Shots on Target", "HST", "AST"),
    ("Corners", "HC", "AC"),
    ("Yellow Cards", "HY", "AY"),
    ("Red Cards", "HR", "AR"),
]


def type_results(raw: DataFrame, odds: tuple[str, str, str] = ODDS_COLUMNS, extra=()) -> DataFrame:
    """Typed results out of all-text rows: bad numbers and dates become null.

    ``extra`` names further columns to carry along, such as a season label.
    """
    chosen = raw.select(*extra, *IDENTITY_COLUMNS, *COUNT_COLUMNS, *odds)
    named = chosen.withColumnsRenamed(dict(zip(odds, ODDS_NAMES)))
    # The null tokens are no numbers and no dates, so the lenient casts cover them.
    typed = {c: lenient_double(F.col(c)) for c in (*COUNT_COLUMNS, *ODDS_NAMES)}
    typed["Date"] = lenient_date(F.col("Date"))
    typed |= {c: blank_to_null(F.col(c)) for c in ("HomeTeam", "AwayTeam")}
    return named.withColumns(typed)


def result_code(home_goals: Column, away_goals: Column) -> Column:
    return F.when(home_goals > away_goals, "H").when(away_goals > home_goals, "A").otherwise("D")


def score_line(
    eligible: Column, home_xg: Column, away_xg: Column, home_half: Column, away_half: Column
) -> Column:
    """xG of both sides when known and wanted, else the half-time score."""
    known = F.coalesce(eligible, F.lit(False)) & home_xg.isNotNull() & away_xg.isNotNull()
    xg = F.format_string("%.2f xG %.2f", home_xg, away_xg)
    half = F.concat(F.lit("HT "), home_half.cast("string"), F.lit(" – "), away_half.cast("string"))
    return F.when(known, xg).otherwise(half)


def statistics(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per match and statistic with the home and away value."""
    entries = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(label).alias("label"),
            safe_int(F.col(h)).alias("home_value"), safe_int(F.col(a)).alias("away_value"),
        )
        for i, (label, h, a) in enumerate(STATISTICS, 1)
    ]
    return results.select(*keys, F.inline(F.array(*entries)))


def results_view(results: DataFrame, keys: list[str]) -> DataFrame:
    """Display columns of a results list: whole goals, result code, odds text."""
    home, away = safe_int(F.col("FTHG")), safe_int(F.col("FTAG"))
    return results.select(
        *keys,
        home.alias("home_goals"),
        away.alias("away_goals"),
        result_code(home, away).alias("result"),
        *[fixed(F.col(o)).alias(f"odds_{o[-1].lower()}") for o in ODDS_NAMES],
    )


def in_date_order(rows: DataFrame) -> DataFrame:
    """Rows by date and match, numbered from 1."""
    order = ["match_date", "match_id"]
    return placed(rows, [], [F.col(c) for c in order], "place").orderBy(*order)
