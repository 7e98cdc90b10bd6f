"""Data-quality checks, each a small DataFrame, and their report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.operators.areas import conflicts, votes_by_name, votes_by_number
from shelfspan.operators.keys import duplicate_rows, key_presence, rows_with_keys_of

LOCATION_KEY = ("branch_id", "code_norm")
CELL_KEY = ("branch_id", "code_norm", "category")


def _named(df: DataFrame) -> DataFrame:
    """Keys with both a branch and a code."""
    return df.where("branch_id is not null and code_norm != ''")


def _count(condition) -> Column:
    return F.count(F.when(condition, 1))


def source_overlap(stock: DataFrame, realloc: DataFrame) -> DataFrame:
    """How many keys the stock and the reallocation source have, share and do not share."""
    keys = key_presence(_named(stock), _named(realloc), LOCATION_KEY)
    a, b = F.col("n_a") > 0, F.col("n_b") > 0
    return keys.agg(
        _count(a).alias("stock_keys"),
        _count(b).alias("realloc_keys"),
        _count(a & b).alias("shared"),
        _count(a & ~b).alias("only_stock"),
        _count(b & ~a).alias("only_realloc"),
    )


def warehouse_merge(physical: DataFrame, warehouse: DataFrame) -> DataFrame:
    """How many cleaned warehouse rows were new and how many were already known."""
    keys = key_presence(rows_with_keys_of(physical, warehouse, CELL_KEY), warehouse, CELL_KEY)

    def rows(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n_b"))), F.lit(0))

    return keys.agg(
        rows(F.lit(True)).alias("cleaned_rows"),
        rows(F.col("n_a") == 0).alias("new_rows"),
        rows(F.col("n_a") > 0).alias("ignored_rows"),
    )


def area_conflicts(capacity: DataFrame) -> DataFrame:
    """Branches whose capacity rows name more than one area."""
    by_number = conflicts(votes_by_number(capacity), "branch_id")
    by_name = conflicts(votes_by_name(capacity), "branch_name")
    return by_number.withColumn("branch_name", F.lit(None).cast("string")).unionByName(
        by_name.withColumn("branch_id", F.lit(None).cast("bigint"))
    )


def _odd_areas(branches: DataFrame, canonical: Sequence[str], unassigned: str) -> DataFrame:
    odd = F.col("area").isNotNull() & ~F.col("area").isin(*canonical, unassigned)
    return branches.where(odd).select("area").distinct()


def unknown_areas(branches: DataFrame, canonical: Sequence[str], unassigned: str) -> DataFrame:
    """How many areas outside the canonical set branches carry, and which."""
    odd = _odd_areas(branches, canonical, unassigned)
    listed = F.concat_ws(", ", F.sort_array(F.collect_list("area")))
    return odd.agg(F.count("*").alias("unknown_areas"), listed.alias("areas"))


def details(
    capacity: DataFrame, branches: DataFrame, canonical: Sequence[str], unassigned: str
) -> DataFrame:
    """What the report only counts: ``check, key, text``, a row per branch in conflict and per unknown area.

    The key is the branch's number, or its name where it has none, and empty for areas.
    """
    conflicting = area_conflicts(capacity).select(
        F.lit("area_conflicts").alias("check"),
        F.coalesce(F.col("branch_id").cast("string"), F.col("branch_name")).alias("key"),
        F.col("areas").alias("text"),
    )
    unknown = _odd_areas(branches, canonical, unassigned).select(
        F.lit("unknown_areas").alias("check"), F.lit("").alias("key"), F.col("area").alias("text")
    )
    return conflicting.unionByName(unknown)


def duplicate_ids(locations: DataFrame) -> DataFrame:
    """Rows whose location id occurs more than once."""
    return duplicate_rows(locations, ["location_id"])


def duplicate_keys(locations: DataFrame) -> DataFrame:
    """Rows whose branch and code occur more than once; the smallest id stands for them."""
    return duplicate_rows(locations, LOCATION_KEY)


def duplicate_branches(branch_rows: DataFrame) -> DataFrame:
    """Branch rows beyond the first of their number, equal ones too, which the model leaves out."""
    listed = branch_rows.where("branch_id is not null").groupBy("branch_id").count()
    return listed.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows"))


def no_physical(locations: DataFrame, physical: DataFrame) -> DataFrame:
    """Location ids without a row in the physical fact."""
    found = physical.where("location_id is not null")
    keys = key_presence(locations.where("location_id is not null"), found, ["location_id"])
    return keys.agg(_count((F.col("n_a") > 0) & (F.col("n_b") == 0)).alias("locations"))


def orphan_capacity(capacity: DataFrame, stock: DataFrame) -> DataFrame:
    """Capacity keys without a location; a missing branch matches a missing branch."""
    keys = key_presence(capacity, stock, LOCATION_KEY)
    return keys.agg(_count((F.col("n_a") > 0) & (F.col("n_b") == 0)).alias("keys"))


def no_effective(locations: DataFrame, effective: DataFrame) -> DataFrame:
    """Locations without any row of effective capacity."""
    known = effective.where("location_id is not null")
    keys = key_presence(locations, known, ["location_id"])
    missing = F.sum(F.when(F.col("n_b") == 0, F.col("n_a")))
    return keys.agg(F.coalesce(missing, F.lit(0)).alias("locations"))


def zero_stock(locations: DataFrame) -> DataFrame:
    """Locations with no stock, or none known."""
    return locations.agg(_count(F.coalesce("stock_total", F.lit(0)) == 0).alias("locations"))


def coverage(locations: DataFrame, effective: DataFrame) -> DataFrame:
    """All locations, and those with a defined effective capacity."""
    defined = effective.where("capacity_effective is not null and location_id is not null")
    keys = key_presence(locations, defined, ["location_id"])
    return keys.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("locations"),
        _count(F.col("n_b") > 0).alias("covered_locations"),
    )


def plan_diff(effective: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Flagged locations whose physical and planned sums over shared categories differ."""
    both = effective.where(
        "is_realloc and location_id is not null"
        " and capacity_physical is not null and capacity_realloc is not null"
    )
    sums = both.groupBy("location_id").agg(
        F.min("code_norm").alias("code_norm"),
        F.sum("capacity_physical").alias("capacity_physical"),
        F.sum("capacity_realloc").alias("capacity_realloc"),
    )
    return sums.where(F.abs(F.col("capacity_physical") - F.col("capacity_realloc")) > tolerance)


def no_branch(locations: DataFrame) -> DataFrame:
    """Locations without a branch number."""
    return locations.agg(_count(F.col("branch_id").isNull()).alias("locations"))


def location_audit(locations: DataFrame, counted: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """All checks keyed by location id, from one aggregation.

    ``counted`` are the cells with their effective capacity.
    """
    listed = locations.select(
        "location_id",
        F.lit(True).alias("_listed"),
        (F.coalesce("stock_total", F.lit(0)) == 0).alias("_zero"),
        F.col("branch_id").isNull().alias("_nowhere"),
    )
    cells = counted.where("location_id is not null").select(
        "location_id", "has_physical", "is_realloc", "capacity_physical", "capacity_realloc",
        "capacity_effective",
    )
    physical, planned = F.col("capacity_physical"), F.col("capacity_realloc")
    compared = F.col("is_realloc") & physical.isNotNull() & planned.isNotNull()
    per_location = listed.unionByName(cells, allowMissingColumns=True).groupBy("location_id").agg(
        F.count("_listed").alias("rows"),
        F.count_if("_zero").alias("zero"),
        F.count_if("_nowhere").alias("nowhere"),
        F.count_if("has_physical").alias("physical"),
        F.count("has_physical").alias("cells"),
        F.count("capacity_effective").alias("effective"),
        F.sum(F.when(compared, physical)).alias("_physical"),
        F.sum(F.when(compared, planned)).alias("_planned"),
    )
    rows, known = F.col("rows"), F.col("location_id").isNotNull()

    def add(n, condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return per_location.agg(
        add(rows, rows > 1).alias("duplicate_ids__rows"),
        _count((rows > 0) & known & (F.col("physical") == 0)).alias("no_physical__locations"),
        add(rows, F.col("cells") == 0).alias("no_effective__locations"),
        F.coalesce(F.sum("zero"), F.lit(0)).alias("zero_stock__locations"),
        F.coalesce(F.sum(rows), F.lit(0)).alias("coverage__locations"),
        _count(F.col("effective") > 0).alias("coverage__covered_locations"),
        _count(F.abs(F.col("_physical") - F.col("_planned")) > tolerance).alias(
            "plan_diff__locations"
        ),
        F.coalesce(F.sum("nowhere"), F.lit(0)).alias("no_branch__locations"),
    )


def key_audit(stock: DataFrame, realloc: DataFrame, capacity: DataFrame) -> DataFrame:
    """All checks keyed by branch and code, from one aggregation."""
    sides = {"listed": stock, "planned": realloc, "capacity": capacity}
    stacked = None
    for side, df in sides.items():
        part = df.select(*LOCATION_KEY, F.lit(True).alias(side))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    keys = stacked.groupBy(*LOCATION_KEY).agg(*[F.count(side).alias(side) for side in sides])
    named = F.col("branch_id").isNotNull() & (F.col("code_norm") != "")
    a, b = named & (F.col("listed") > 0), named & (F.col("planned") > 0)
    listed = F.col("listed")
    return keys.agg(
        _count(a).alias("source_overlap__stock_keys"),
        _count(b).alias("source_overlap__realloc_keys"),
        _count(a & b).alias("source_overlap__shared"),
        _count(a & ~b).alias("source_overlap__only_stock"),
        _count(b & ~a).alias("source_overlap__only_realloc"),
        F.coalesce(F.sum(F.when(listed > 1, listed)), F.lit(0)).alias("duplicate_keys__rows"),
        _count((F.col("capacity") > 0) & (listed == 0)).alias("orphan_capacity__keys"),
    )


def report(audits: Sequence[DataFrame]) -> DataFrame:
    """One-row audits as ``check, measure, value``; columns are named ``check__measure``."""
    lines = []
    for df in audits:
        long = df.select([F.col(c).cast("bigint").alias(c) for c in df.columns])
        lines.append(long.unpivot([], long.columns, "_line", "value"))
    name = F.split("_line", "__")
    return reduce(DataFrame.unionByName, lines).select(
        name[0].alias("check"), name[1].alias("measure"), "value"
    )
