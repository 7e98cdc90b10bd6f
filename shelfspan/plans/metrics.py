"""Effective capacity and the metrics from category to network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.config import ModelConfig
from shelfspan.functions.numeric import guarded_pct, guarded_ratio
from shelfspan.operators.keys import join_null_safe

EFFECTIVE = (
    "location_id",
    "branch_id",
    "code_norm",
    "category",
    "capacity_physical",
    "capacity_realloc",
    "is_realloc",
    "capacity_effective",
)


def with_effective(cells: DataFrame, branches: DataFrame, storage_area: str) -> DataFrame:
    """Located cells with the capacity that counts; cells that count nowhere are left out.

    Storage branches count their physical capacity, flagged locations their planned one,
    the others their physical one.  A planned capacity without a physical cell counts at
    flagged locations only, and there whatever the area.
    """
    areas = branches.select("branch_id", "area")
    located = F.col("location_id").isNotNull()
    kept = cells.where(F.col("has_physical") | (located & F.col("is_realloc")))
    planned = F.when(located, F.col("capacity_realloc"))
    effective = (
        F.when(~F.col("has_physical"), planned)
        .when(located & (F.col("area") == storage_area), F.col("capacity_physical"))
        .when(F.col("is_realloc"), planned)
        .otherwise(F.col("capacity_physical"))
    )
    return kept.join(areas, "branch_id", "left").withColumns(
        {"capacity_effective": effective, "capacity_realloc": planned}
    )


def effective_capacity(
    cells: DataFrame, branches: DataFrame, config: ModelConfig = ModelConfig()
) -> DataFrame:
    """Effective capacity of every physical cell."""
    return with_effective(cells.where("has_physical"), branches, config.storage_area).select(
        *EFFECTIVE
    )


def effective_capacity_full(
    cells: DataFrame, branches: DataFrame, config: ModelConfig = ModelConfig()
) -> DataFrame:
    """Effective capacity of physical cells and of cells that are only planned."""
    return with_effective(cells, branches, config.storage_area).select(*EFFECTIVE)


def metrics_location_category(
    cells: DataFrame, branches: DataFrame, config: ModelConfig = ModelConfig()
) -> DataFrame:
    """Capacities and shelf stock per location and category."""
    counted = with_effective(cells.where("location_id is not null"), branches, config.storage_area)
    return counted.select(
        "location_id",
        "code",
        "branch_name",
        "branch_id",
        "area",
        "is_realloc",
        "category",
        "capacity_physical",
        "capacity_realloc",
        "capacity_effective",
        F.col("stock_on_shelf").alias("stock_category"),
    )


def location_sums(cells: DataFrame) -> DataFrame:
    """Capacities per location id, planned ones split by whether a physical cell exists."""
    physical, planned = F.col("capacity_physical"), F.col("capacity_realloc")
    shared = F.col("has_physical")
    return cells.where("location_id is not null").groupBy("location_id").agg(
        F.sum(physical).alias("_physical"),
        F.sum(F.when(shared, planned)).alias("_planned_shared"),
        F.sum(F.when(~shared, planned)).alias("_planned_alone"),
    )


def _either(a: Column, b: Column) -> Column:
    """Sum in which a null counts as nothing, unless both are null."""
    return F.coalesce(a + b, a, b)


def metrics_location(
    locations: DataFrame,
    branches: DataFrame,
    cells: DataFrame,
    config: ModelConfig = ModelConfig(),
) -> DataFrame:
    """Capacities summed per location; a location without any has nulls.

    The rules for the capacity that counts are the same for all cells of a location, so
    cells, which need the location id only, are summed first and the rules applied to the
    sums.  Locations listed twice with the same attributes are summed up on the partitioning
    by location id, before the branch is looked up: nothing relies on the partitioning of
    that last join, so the adaptive skew join can split a hot branch.
    """
    listed = ("location_id", "code", "branch_name", "branch_id", "is_realloc", "stock_total")
    sums = ("_physical", "_planned_shared", "_planned_alone")
    once = locations.join(location_sums(cells), "location_id", "left").groupBy(*listed).agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    areas = branches.where("branch_id is not null").select("branch_id", "area")
    joined = join_null_safe(once, areas, ["branch_id"])
    physical, flagged = F.col("_physical"), F.col("is_realloc")
    planned = _either(F.col("_planned_shared"), F.col("_planned_alone"))
    stored = F.when(flagged, _either(physical, F.col("_planned_alone"))).otherwise(physical)
    effective = (
        F.when(F.col("area") == config.storage_area, stored)
        .when(flagged, planned)
        .otherwise(physical)
    )
    counted = F.when(flagged, planned).otherwise(F.col("_planned_shared"))
    return joined.select(
        "location_id", "code", "branch_name", "branch_id", "area", "is_realloc", "stock_total",
        effective.alias("capacity_total"),
        physical.alias("capacity_physical_sum"),
        counted.alias("capacity_realloc_sum"),
    )


def enrich(location_metrics: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Free space, fill and flags per location; all null without a usable capacity."""
    stock, capacity = F.col("stock_total"), F.col("capacity_total")
    ratio = guarded_ratio(stock, capacity)
    return location_metrics.withColumns(
        {
            "free": capacity - stock,
            "fill_pct": ratio * 100.0,
            "diff": stock - capacity,
            "overloaded": ratio > config.overload_ratio,
            "at_risk": ratio > config.risk_ratio,
        }
    )


def _measures() -> list[Column]:
    stock, capacity = F.col("stock_total"), F.col("capacity_total")
    covered = F.sum(F.when(capacity.isNotNull(), stock))
    return [
        F.count("*").alias("locations"),
        F.count(capacity).alias("covered_locations"),
        F.sum(stock).alias("stock_total"),
        F.sum(capacity).alias("capacity_total"),
        covered.alias("covered_stock"),
        guarded_pct(covered, F.sum(capacity)).alias("fill_pct"),
    ]


def metrics_area(enriched: DataFrame) -> DataFrame:
    """Rollup per area; locations of unknown branches form the null area."""
    return enriched.groupBy("area").agg(*_measures())


def metrics_branch(enriched: DataFrame) -> DataFrame:
    """Rollup per branch number."""
    return enriched.groupBy("branch_id").agg(
        F.max("branch_name").alias("branch_name"), F.max("area").alias("area"), *_measures()
    )


def metrics_network(enriched: DataFrame) -> DataFrame:
    """Rollup over everything, one row."""
    return enriched.agg(*_measures())


def metrics_grouping_sets(enriched: DataFrame) -> DataFrame:
    """Area, branch and network rollups from one pass, told apart by ``level``.

    Locations are first summed per branch and area, so the rows that the grouping sets
    multiply are few.
    """
    stock, capacity = F.col("stock_total"), F.col("capacity_total")
    base = enriched.groupBy("branch_id", "area").agg(
        F.count("*").alias("locations"),
        F.count(capacity).alias("covered_locations"),
        F.sum(stock).alias("stock_total"),
        F.sum(capacity).alias("capacity_total"),
        F.sum(F.when(capacity.isNotNull(), stock)).alias("covered_stock"),
    )
    area, branch = F.col("area"), F.col("branch_id")
    level = (
        F.when(F.grouping("area") == 0, "area")
        .when(F.grouping("branch_id") == 0, "branch")
        .otherwise("network")
    )
    measures = ("locations", "covered_locations", "stock_total", "capacity_total", "covered_stock")
    return base.groupingSets([[area], [branch], []], area, branch).agg(
        level.alias("level"),
        *[F.sum(m).alias(m) for m in measures],
        guarded_pct(F.sum("covered_stock"), F.sum("capacity_total")).alias("fill_pct"),
    )
