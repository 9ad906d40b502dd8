import pytest
from pyspark.sql import functions as F

from convlens.functions import columns as X

EDGES = [17, 25, 35, 45, 55, 65, 100]
LABELS = ["18-25", "26-35", "36-45", "46-55", "56-65", "66+"]


def _column(spark, values, kind, expr):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in t.orderBy("i").select(expr).collect()]


def test_bands_are_closed_on_the_right(spark):
    ages = [16, 17, 18, 25, 26, 65, 66, 100, 101, None]
    got = _column(spark, ages, "int", X.band("x", EDGES, LABELS))
    assert got == [None, "18-25", "18-25", "18-25", "26-35", "56-65", "66+", "66+", None, None]
    got = _column(spark, ages, "int", X.band("x", EDGES, LABELS, include_lowest=False))
    assert got[:3] == [None, None, "18-25"]
    with pytest.raises(ValueError):
        X.band("x", EDGES, LABELS[:-1])


def test_tiers_take_the_first_rule(spark):
    n = F.col("x")
    got = _column(
        spark,
        [0, 1, 2, 3, 4, 6, 7, None],
        "int",
        X.tier([(n == 1, "first"), (n <= 3, "optimal"), (n <= 6, "diminishing")], "over"),
    )
    assert got == ["optimal", "first", "optimal", "optimal", "diminishing", "diminishing", "over", "over"]


def test_rounding_is_half_away_from_zero_in_binary(spark):
    got = _column(spark, [2.5, -2.5, 1.005, 0.125, None, 1e18, -0.4], "double", X.round_half_up("x", 0))
    assert got == [3.0, -3.0, 1.0, 0.0, None, 1e18, 0.0]
    assert _column(spark, [0.125], "double", X.round_half_up("x", 2)) == [0.13]


def test_rates_of_nothing_are_null(spark):
    assert _column(spark, [0], "int", X.percent(F.col("x"), F.lit(0))) == [None]
    assert _column(spark, [1], "int", X.ratio(F.col("x"), F.lit(0))) == [None]
    assert _column(spark, [1], "int", X.percent(F.col("x"), F.lit(3))) == [33.33]


def test_text_is_stripped_of_all_white_space(spark):
    got = _column(spark, [" \tA b\n ", "", None], "string", X.norm_text("x"))
    assert got == ["a b", "", None]


def test_missing_values_in_flags_and_caps(spark):
    values = [1, 5, 999, None]
    assert _column(spark, values, "int", X.cap("x", 3)) == [1, 3, 3, None]
    assert _column(spark, values, "int", X.sentinel_flag("x", 999)) == [1, 1, 0, None]
    assert _column(spark, values, "int", X.strip_sentinel("x", 999)) == [1, 5, -1, None]
    assert _column(spark, values, "int", X.flag(F.col("x") > 3)) == [0, 1, 1, 0]


def test_codes(spark):
    values = ["a", "b", "z", None]
    assert _column(spark, values, "string", X.map_codes("x", {"a": 1, "b": 2})) == [1, 2, None, None]
    assert _column(spark, values, "string", X.ordinal("x", ["b", "a"], default=9)) == [2, 1, 9, 9]


def test_not_finite_becomes_null(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert _column(spark, values, "double", X.finite_or_null("x")) == [1.0, None, None, None, None]


def test_numbers_from_text(spark):
    assert _column(spark, ["1", "x"], "string", X.number("x", "int", strict=False)) == [1, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        _column(spark, ["x"], "string", X.number("x", "int"))


def test_keywords_match_inside_words(spark):
    got = _column(spark, ["The AVERAGE", "none", None], "string", X.contains_any("x", ["age"]))
    assert got == [True, False, None]


def test_minutes_and_lists(spark):
    assert _column(spark, [90], "int", X.minutes("x")) == [1.5]
    assert _column(spark, [["a", "b"]], "array<string>", X.join_list("x")) == ["a, b"]
