"""Text functions: trimming, matching keys, blank and null words, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspan import fixed_values as fv

# Every character that counts as white space, not just the blank that trim() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_to_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def code_key(c: Column) -> Column:
    """Location codes match regardless of case and surrounding space; null is blank."""
    return F.upper(null_to_blank(c))


def name_key(c: Column) -> Column:
    """Branch names match regardless of case and surrounding space; null stays null."""
    return F.lower(strip(c))


def null_words_to_null(c: Column) -> Column:
    """The words an export client prints for a missing value, and blanks, become null."""
    return F.when(~F.lower(strip(c)).isin("", *fv.EXPORT_NULL_WORDS), strip(c))


def grouped_number(c: Column) -> Column:
    """12345.6 as ``12 346``; a missing number as a dash."""
    text = F.translate(F.format_number(F.bround(c.cast("double"), 0), 0), ",", " ")
    return F.coalesce(text, F.lit(fv.UNKNOWN))


def yes_no(c: Column) -> Column:
    return F.when(c.isNull(), fv.UNKNOWN).when(c, fv.YES).otherwise(fv.NO)
