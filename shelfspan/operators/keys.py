"""Set logic on keys: presence in two sources, append of new keys, lookups, picks.

The plans here avoid three things that break on a key holding a large share of the rows:
windows over an unbounded key, joins whose unique side repeats, and ``OR`` in join
conditions.  Counting and picking go through aggregates, which shrink a hot key before it
is shuffled; row-level joins only ever meet a side that is unique on the join key, so the
adaptive skew join can split a hot partition without repeating work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.functions.text import blank_to_null, code_key, name_key, strip

_L, _R = "l", "r"


def same_keys(keys: Sequence[str], left: str = _L, right: str = _R) -> Column:
    """All keys equal, where null equals null; stays a hashable equi-join condition."""
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(Column.__and__, pairs)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on keys where null equals null, keeping the left side's key columns.

    Lookups of rows that may share a key in large numbers go through here even if their
    keys are never null.  Compared this way, the unique side is shuffled for the join itself
    and not joined straight from the aggregate that made it unique; only then can the
    adaptive skew join split a hot key of the left side.
    """
    joined = left.alias(_L).join(right.alias(_R), same_keys(keys), how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [F.col(f"{_R}.{c}") for c in right.columns if c not in keys]
    return joined.select(f"{_L}.*", *extra)


def semi_filter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs among the ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def key_presence(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, how many rows of ``a`` and of ``b`` carry it (``n_a``, ``n_b``).

    Intersection, both differences, anti-join counts and overlap sizes all follow from one
    aggregation of the two sources; null is a key like any other.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = a.select(*keys, one.alias("n_a"), zero.alias("n_b")).unionByName(
        b.select(*keys, zero.alias("n_a"), one.alias("n_b"))
    )
    return both.groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def append_new_keys(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``base`` and the rows of ``extra`` whose key ``base`` does not have."""
    known = rows_with_keys_of(base, extra, keys).distinct()
    new = join_null_safe(extra, known, keys, "left_anti")
    return base.unionByName(new.select(*base.columns))


def rows_with_keys_of(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the rows of ``base`` whose key ``extra`` has too.

    Where Spark broadcasts the keys of a small ``extra``, the rows of ``base`` are not shuffled.
    """
    return join_null_safe(base.select(*keys), extra.select(*keys).distinct(), keys, "left_semi")


def dedupe(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first"
) -> DataFrame:
    """One row per key: the first or last in the order given (unique within a key)."""
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[*keys, "_row.*"]).select(*df.columns)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return join_null_safe(df, repeated, keys, "left_semi")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The number of rows whose key occurs more than once, without touching the rows."""
    counts = df.groupBy(*keys).count().where("count > 1")
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))


def conform_code_map(df: DataFrame) -> DataFrame:
    """Code map with matching keys; the last row per branch and source code wins."""
    ordered = df.select(
        "branch_id",
        code_key(F.col("source_code")).alias("source_norm"),
        code_key(F.col("target_code")).alias("target_norm"),
        "src_file",
        "src_row",
    ).where("branch_id is not null and source_norm != '' and target_norm != ''")
    return dedupe(ordered, ("branch_id", "source_norm"), ("src_file", "src_row"), "last")


def apply_code_map(df: DataFrame, code_map: DataFrame) -> DataFrame:
    """Replace code and key where the map has an entry for branch and code."""
    entries = code_map.select(
        "branch_id", F.col("source_norm").alias("code_norm"), F.col("target_norm").alias("_to")
    )
    hit = join_null_safe(df, entries, ["branch_id", "code_norm"])
    return hit.select(
        *[
            F.coalesce("_to", c).alias(c) if c in ("code", "code_norm") else F.col(c)
            for c in df.columns
        ]
    )


def override_branch(df: DataFrame, rules: Sequence[tuple[str, int, str, str]]) -> DataFrame:
    """Rewrite number, name and area of the branches the rules name."""
    key = name_key(F.col("branch_name"))
    new: dict[str, Column] = {c: F.col(c) for c in ("branch_id", "branch_name", "area")}
    for match, number, name, area in rules:
        hit = key == match.strip().lower()
        new["branch_id"] = F.when(hit, F.lit(number).cast("bigint")).otherwise(new["branch_id"])
        new["branch_name"] = F.when(hit, F.lit(name)).otherwise(new["branch_name"])
        new["area"] = F.when(hit, F.lit(area)).otherwise(new["area"])
    # One projection: every rule looks at the name as it came in.
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def clean_warehouse(df: DataFrame) -> DataFrame:
    """Warehouse rows that name a location and hold some capacity."""
    return df.where((F.col("code_norm") != "") & (F.coalesce("capacity_physical", F.lit(0)) != 0))


def name_catalogue(stock: DataFrame, order: Sequence[str]) -> DataFrame:
    """Branch number by matching key of the name, the first in order where names repeat."""
    names = stock.where("branch_id is not null").select(
        name_key(F.col("branch_name")).alias("name_key"), "branch_id", *order
    )
    known = names.where("name_key is not null")
    return dedupe(known, ["name_key"], order).select("name_key", "branch_id")


def fill_branch_from_catalogue(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fill a missing branch number by the branch name."""
    names = catalogue.withColumnRenamed("branch_id", "_found")
    # Rows that have their number, or no name, get keys that match nothing but spread well.
    nothing = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)))
    wanted = F.when(F.col("branch_id").isNull(), name_key(F.col("branch_name")))
    hit = join_null_safe(
        df.withColumn("name_key", F.coalesce(wanted, nothing)), names, ["name_key"]
    )
    return hit.select(
        *[F.coalesce("branch_id", "_found").alias(c) if c == "branch_id" else c for c in df.columns]
    )


def fill_branch_name(df: DataFrame, branches: DataFrame) -> DataFrame:
    """Fill a blank branch name by the branch number."""
    names = branches.select("branch_id", F.col("branch_name").alias("_found"))
    hit = join_null_safe(df, names, ["branch_id"])
    name = F.coalesce(blank_to_null(F.col("branch_name")), strip(F.col("_found")), F.lit(""))
    return hit.select(*[name.alias(c) if c == "branch_name" else c for c in df.columns])
