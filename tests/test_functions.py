from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspan.functions import numeric, text


def one(spark, value, fn, dtype="string"):
    df = spark.createDataFrame([(value,)], f"c {dtype}")
    return df.select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [("  a b\t", "a b"), (" x ", "x"), ("　\n", ""), ("a\x1f", "a"), (None, None)],
)
def test_strip_removes_any_white_space(spark, raw, expected):
    assert one(spark, raw, text.strip) == expected
    assert raw is None or raw.strip() == expected


@pytest.mark.parametrize(
    "raw, expected", [(" jen-pvp\t", "JEN-PVP"), ("žižkov", "ŽIŽKOV"), (None, ""), ("  ", "")]
)
def test_code_key(spark, raw, expected):
    assert one(spark, raw, text.code_key) == expected


def test_blank_and_null(spark):
    assert one(spark, "  ", text.blank_to_null) is None
    assert one(spark, None, text.null_to_blank) == ""
    assert one(spark, " <NULL> ", text.null_words_to_null) is None
    assert one(spark, "Null", text.null_words_to_null) is None
    assert one(spark, " ", text.null_words_to_null) is None
    assert one(spark, " 12 ", text.null_words_to_null) == "12"


@pytest.mark.parametrize(
    "raw, double, whole",
    [
        (" 7 ", 7.0, 7),
        ("92.0", 92.0, 92),
        ("1e3", 1000.0, 1000),
        ("x", None, None),
        ("1.5", 1.5, None),
        ("1d", None, None),
        ("", None, None),
        ("NaN", None, None),
        (None, None, None),
        ("9007199254740993", 9007199254740992.0, 9007199254740993),
        ("-3.", -3.0, -3),
    ],
)
def test_safe_numbers_from_text(spark, raw, double, whole):
    assert one(spark, raw, numeric.safe_double) == double
    assert one(spark, raw, numeric.safe_long) == whole


def test_safe_numbers_from_numbers(spark):
    def from_double(fn):
        return lambda c: fn(c, T.DoubleType())

    assert one(spark, float("nan"), from_double(numeric.safe_double), "double") is None
    assert one(spark, 92.0, from_double(numeric.safe_long), "double") == 92
    assert one(spark, 92.5, from_double(numeric.safe_long), "double") is None
    assert one(spark, 7, lambda c: numeric.safe_long(c, T.IntegerType()), "int") == 7


def test_ratio_is_null_without_capacity(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (5.0, 10.0)], "a double, b double")
    found = [r[0] for r in df.select(numeric.guarded_ratio(F.col("a"), F.col("b"))).collect()]
    assert found == [None, None, 0.5]


def test_total_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double").groupBy("k")
    assert dict(df.agg(numeric.total(F.col("v"), "zero")).collect()) == {"a": 0.0, "b": 1.0}
    assert dict(df.agg(numeric.total(F.col("v"), "null")).collect()) == {"a": None, "b": 1.0}


@pytest.mark.parametrize(
    "raw, expected", [(1234567.4, "1 234 567"), (-1000.0, "-1 000"), (0.5, "0"), (None, "—")]
)
def test_grouped_number(spark, raw, expected):
    assert one(spark, raw, text.grouped_number, "double") == expected


def test_yes_no(spark):
    assert [one(spark, v, text.yes_no, "boolean") for v in (True, False, None)] == ["Ano", "Ne", "—"]
