"""Column expressions against worked examples."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import names, numbers, pitch, text
from touchline.operators import conform, results


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_ordinals(spark):
    given = [0, 1, 2, 3, 4, 11, 12, 13, 21, 92, 101, 111, 112]
    wanted = "0th 1st 2nd 3rd 4th 11th 12th 13th 21st 92nd 101st 111th 112th".split()
    assert values(spark, given, text.ordinal, "int") == wanted


def test_scores_to_words(spark):
    given = ["2-1", "1-1", "0-0", "1-2-3", "", "won 3-0 and 2-2.", "2023-24", None]
    wanted = ["two-one", "one all", "nil all", "one-two-3", "", "won three-nil and two all.", "202three-two4", None]
    assert values(spark, given, text.score_words) == wanted


def test_scores_to_words_strict(spark):
    given = ["2023-24", "a 2-1 win"]
    assert values(spark, given, lambda c: text.score_words(c, strict=True)) == ["2023-24", "a two-one win"]


def test_initials(spark):
    given = ["Leverkusen", "RB Leipzig", "M'gladbach", "1. FC Union Berlin", "Ein Frankfurt"]
    assert values(spark, given, names.initials) == ["LEV", "RL", "MGL", "1FU", "EF"]


def test_surname(spark):
    given = ["Florian Wirtz", "  Ana  María Ñusta ", "Solo", "", None]
    assert values(spark, given, names.surname) == ["wirtz", "ñusta", "solo", None, None]


def test_fold_accents(spark):
    assert values(spark, ["Josip Stanišić", "Ødegård"], names.fold_accents) == ["Josip Stanisic", "Odegard"]


def test_shorten(spark):
    given = ["x" * 30, "x" * 31]
    assert values(spark, given, names.shorten) == ["x" * 30, "x" * 28 + "…"]


def test_asset_name(spark):
    df = spark.createDataFrame([("M'gladbach A", "RB Leipzig", "highlight", 3)], "h string, a string, t string, i int")
    out = df.select(names.asset_name(F.col("h"), F.col("a"), F.col("t"), F.col("i"))).first()[0]
    assert out == "Mgladbach_A_vs_RB_Leipzig_highlight_3.mp3"


def test_safe_int(spark):
    given = ["3", "3.9", "-2", "", "x", None, "nan", "1e3", "inf"]
    assert values(spark, given, numbers.safe_int) == [3, 3, 0, 0, 0, 0, 0, 1000, 0]


def test_fixed(spark):
    assert values(spark, ["1.5", "2", "x", None], numbers.fixed) == ["1.50", "2.00", "—", "—"]


def test_signed(spark):
    assert values(spark, [3, 0, -2], numbers.signed, "int") == ["+3", "0", "-2"]


@pytest.mark.parametrize("goals,round_,last,wanted", [(9, 17, 34, 4), (11, 17, 34, 6), (1, 17, 34, 0), (3, 17, 34, 2)])
def test_half_even(spark, goals, round_, last, wanted):
    out = spark.range(1).select(numbers.half_even(F.lit(goals) * (F.lit(round_) / F.lit(last)))).first()[0]
    assert out == wanted == round(goals * (round_ / last))


def test_rounded_is_half_up_on_digits(spark):
    out = spark.range(1).select(
        numbers.rounded(F.lit(0.125), 2), numbers.rounded(F.lit(0.0045), 3), numbers.rounded(F.lit(None).cast("double"), 2)
    ).first()
    assert tuple(out) == (0.13, 0.005, None)


def test_pitch(spark):
    given = [0.0, 60.0, 90.0, 120.0]
    assert values(spark, given, pitch.map_x, "double") == [4.0, 4.0, 280.0, 556.0]
    assert values(spark, [0.0, 40.0, 80.0], pitch.map_y, "double") == [4.0, 160.0, 316.0]
    assert values(spark, [0.01, 0.2, 0.9], pitch.marker_radius, "double") == [8, 13, 20]
    assert values(spark, [0.01, 0.2, 0.9], pitch.bar_width, "double") == [2, 56, 140]


def test_red_cards(spark):
    given = ["Red Card", "Second Yellow", "Yellow Card", None]
    assert values(spark, given, conform.is_red) == [True, True, False, False]


def test_name_of(spark):
    given = ['{"id": 97, "name": "Goal"}', "Goal", None]
    assert values(spark, given, conform.name_of) == ["Goal", "Goal", None]


def test_text_predicates(spark):
    assert values(spark, ["Augsburg", None], lambda c: conform.contains_text(c, "AUGS")) == [True, False]
    df = spark.createDataFrame([("nan",), ("abcd",), ("abcde",), (None,)], "t string")
    assert [r[0] for r in df.filter(conform.usable_text(F.col("t"))).collect()] == ["abcde"]


def test_score_line(spark):
    df = spark.createDataFrame(
        [(True, 1.25, 0.5), (False, 1.25, 0.5), (True, None, 0.5)], "e boolean, h double, a double"
    )
    out = [r[0] for r in df.select(results.score_line(
        F.col("e"), F.col("h"), F.col("a"), F.lit(1), F.lit(0)
    )).collect()]
    assert out == ["1.25 xG 0.50", "HT 1 – 0", "HT 1 – 0"]


def test_result_code(spark):
    out = spark.range(1).select(*[
        results.result_code(F.lit(h), F.lit(a)) for h, a in ((2, 1), (1, 2), (1, 1))
    ]).first()
    assert tuple(out) == ("H", "A", "D")
