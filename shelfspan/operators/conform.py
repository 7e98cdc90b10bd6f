"""Column conformance: header normalisation, aliases, missing columns, types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspan import fixed_values as fv
from shelfspan.functions.numeric import safe_double, safe_long
from shelfspan.functions.text import blank_to_null, code_key, null_to_blank, strip


def normalize_columns(df: DataFrame) -> DataFrame:
    """Headers without outer space, in lower case, with inner blanks as underscores."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"headers equal after normalisation: {', '.join(clash)}")
    return df.toDF(*names)


def canonicalize(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename to each target the first of its aliases at hand, unless the target is."""
    taken = set(df.columns)
    renames: dict[str, str] = {}
    for target, candidates in aliases.items():
        if target in taken:
            continue
        found = next((a for a in candidates if a in taken and a not in renames), None)
        if found is not None:
            renames[found] = target
            taken.add(target)
    return df.withColumnsRenamed(renames)


def conform_part(df: DataFrame, branch_name: Column | str) -> DataFrame:
    """Headers of one capacity part, with the part's name as its branch name."""
    name = F.lit(branch_name) if isinstance(branch_name, str) else branch_name
    out = normalize_columns(df.drop("branch_name"))
    out = canonicalize(out.drop("pobocka_nazev"), fv.PART_ALIASES)
    return out.withColumn("branch_name", name)


def column_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _as(df: DataFrame, name: str, kind: str) -> Column:
    """One conformed column; a missing one is null (or blank) of the right type."""
    if name in df.columns:
        dtype, c = df.schema[name].dataType, F.col(name)
    else:
        dtype, c = T.StringType(), F.lit(None).cast("string")
    text = c.cast("string")
    kinds = {
        "long": lambda: safe_long(c, dtype),
        "count": lambda: F.coalesce(safe_double(c, dtype), F.lit(0.0)).try_cast("bigint"),
        "double": lambda: safe_double(c, dtype),
        "text": lambda: strip(text),
        "name": lambda: null_to_blank(text),
        "optional": lambda: blank_to_null(text),
        "raw": lambda: text,
    }
    return kinds[kind]().alias(name)


def _conform(df: DataFrame, spec: Mapping[str, str], keep: Sequence[str] = ()) -> list[Column]:
    return [_as(df, n, k) for n, k in spec.items()] + [F.col(c) for c in keep if c in df.columns]


CAPACITY_KINDS = {
    "branch_id": "long",
    "branch_name": "text",
    "area": "optional",
    "code": "text",
    "category": "optional",
    "marking": "optional",
    "capacity_physical": "double",
    "stock_on_shelf": "double",
}
REALLOC_KINDS = {
    "branch_id": "long",
    "branch_name": "name",
    "code": "text",
    "category": "optional",
    "descriptor": "optional",
    "capacity_realloc": "double",
}
STOCK_KINDS = {
    "location_id": "long",
    "branch_id": "long",
    "branch_name": "text",
    "code": "text",
    "stock_total": "count",
    "as_of": "raw",
}
ORDER = ("src_file", "src_row")


def conform_capacity(df: DataFrame) -> DataFrame:
    """Capacity rows in the fixed schema; the type is the category unless it is given."""
    kind = _as(df, "type", "optional") if "type" in df.columns else _as(df, "category", "optional")
    out = df.select(*_conform(df, CAPACITY_KINDS, ORDER), kind.alias("type"))
    return out.withColumn("code_norm", code_key(F.col("code")))


def conform_realloc(df: DataFrame) -> DataFrame:
    """Reallocation rows in the fixed schema."""
    out = df.select(*_conform(df, REALLOC_KINDS))
    return out.withColumn("code_norm", code_key(F.col("code")))


def conform_stock(df: DataFrame) -> DataFrame:
    """Stock per location in the fixed schema; a missing count is zero."""
    out = df.select(*_conform(df, STOCK_KINDS, ORDER))
    return out.withColumn("code_norm", code_key(F.col("code")))


def unreadable(df: DataFrame, name: str) -> DataFrame:
    """How many rows hold something that is no whole number where one is expected."""
    dtype = df.schema[name].dataType
    given = blank_to_null(F.col(name).cast("string")).isNotNull()
    lost = given & safe_long(F.col(name), dtype).isNull()
    return df.agg(F.count(F.when(lost, 1)).alias("rows"))


def require(df: DataFrame, name: str) -> DataFrame:
    """Raise unless the column exists and holds at least one value."""
    if name not in df.columns:
        raise ValueError(f"column {name} is missing; there are: {', '.join(sorted(df.columns))}")
    if df.where(F.col(name).isNotNull()).select(name).isEmpty():
        raise ValueError(f"column {name} is empty in every row")
    return df
