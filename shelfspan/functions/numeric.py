"""Number functions: coercion that never fails, sums and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspan.functions.text import strip

# A plain or scientific decimal number; words and type suffixes are not numbers.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d+$"


def whole_number(text: Column) -> Column:
    """Digits as long, anything else null.

    Looking at the digits first keeps failing casts, each of which costs an exception, to
    the numbers that are too large.
    """
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


def safe_double(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """The column as double; whatever is not a number becomes null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def safe_long(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """The column as long; ``"92.0"`` is 92, a fraction or a word becomes null."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    d = safe_double(c, dtype)
    whole = F.when((d == F.floor(d)) & (F.abs(d) < 2.0**63), d.cast("bigint"))
    if isinstance(dtype, T.NumericType):
        return whole
    return F.coalesce(whole_number(strip(c.cast("string"))), whole)


def total(c: Column, all_null_sum: str = "null") -> Column:
    """Sum of a group; ``all_null_sum`` says what a group without any number gives."""
    s = F.sum(c)
    return F.coalesce(s, F.lit(0)) if all_null_sum == "zero" else s


def guarded_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null where there is nothing to divide by."""
    w = whole.cast("double")
    return F.when(w != 0, part.cast("double") / w)


def guarded_pct(part: Column, whole: Column) -> Column:
    """``part * 100 / whole`` as double, null where there is nothing to divide by."""
    w = whole.cast("double")
    return F.when(w != 0, part.cast("double") * 100.0 / w)
