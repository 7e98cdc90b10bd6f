"""Facts: physical and planned capacity per cell, and stock.

A cell is one (branch, code, category); its key columns may be null, and null is a value
like any other when grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.functions.numeric import total
from shelfspan.functions.text import null_to_blank
from shelfspan.operators.flags import attach_location_id

CELL = ("branch_id", "code_norm", "category")


def grouped_rows(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Source rows with equal attributes as one row each, measures summed.

    Everything the model asks of capacity rows can be had from these: sums of sums, distinct
    attributes, and which keys occur.  Raw codes and places in files are left behind.
    """
    left = {*measures, "code", "src_file", "src_row"}
    attributes = [c for c in rows.columns if c not in left]
    return rows.groupBy(*attributes).agg(*[F.sum(m).alias(m) for m in measures])


def capacity_cells(
    physical: DataFrame, realloc: DataFrame, all_null_sum: str = "zero"
) -> DataFrame:
    """Both capacities of every cell side by side.

    Rows of the two sources are stacked and summed in one aggregation.  That settles at
    once what joins between two facts would: which cells both have, which only one has.
    """

    def typed(df: DataFrame, name: str):
        return F.lit(None).cast(df.schema[name].dataType).alias(name)

    stacked = physical.select(
        *CELL,
        "capacity_physical",
        "stock_on_shelf",
        typed(realloc, "capacity_realloc"),
        F.lit(True).alias("_physical"),
    ).unionByName(
        realloc.select(
            *CELL,
            typed(physical, "capacity_physical"),
            typed(physical, "stock_on_shelf"),
            "capacity_realloc",
            F.lit(False).alias("_physical"),
        )
    )

    sums = stacked.groupBy(*CELL).agg(
        F.bool_or("_physical").alias("has_physical"),
        F.bool_or(~F.col("_physical")).alias("has_realloc"),
        F.sum("capacity_physical").alias("capacity_physical"),
        F.sum("stock_on_shelf").alias("stock_on_shelf"),
        F.sum("capacity_realloc").alias("capacity_realloc"),
    )
    if all_null_sum == "zero":
        sums = sums.withColumns(
            {
                name: F.when(F.col(present), F.coalesce(name, F.lit(0))).otherwise(F.col(name))
                for name, present in (
                    ("capacity_physical", "has_physical"),
                    ("stock_on_shelf", "has_physical"),
                    ("capacity_realloc", "has_realloc"),
                )
            }
        )
    return sums


def fact_physical(physical: DataFrame, loc_map: DataFrame, all_null_sum: str = "zero") -> DataFrame:
    """Physical capacity and shelf stock per cell, with the id of the location."""
    sums = physical.groupBy(*CELL).agg(
        total(F.col("capacity_physical"), all_null_sum).alias("capacity_physical"),
        total(F.col("stock_on_shelf"), all_null_sum).alias("stock_on_shelf"),
    )
    return attach_location_id(sums, loc_map)


def fact_realloc(realloc: DataFrame, loc_map: DataFrame, all_null_sum: str = "zero") -> DataFrame:
    """Planned capacity per cell, with the id of the location."""
    sums = realloc.groupBy(*CELL).agg(
        total(F.col("capacity_realloc"), all_null_sum).alias("capacity_realloc")
    )
    return attach_location_id(sums, loc_map)


def physical_part(cells: DataFrame) -> DataFrame:
    """The physical fact, read off the located cells."""
    return cells.where("has_physical").select(
        *CELL, "capacity_physical", "stock_on_shelf", "location_id"
    )


def realloc_part(cells: DataFrame) -> DataFrame:
    """The reallocation fact, read off the located cells."""
    return cells.where("has_realloc").select(*CELL, "capacity_realloc", "location_id")


def fact_stock(locations: DataFrame, cells: DataFrame) -> DataFrame:
    """Total stock of each location, and shelf stock per category where one is given.

    Category lines carry the date of their own location.
    """
    totals = locations.select(
        "location_id",
        "as_of",
        F.lit(None).cast("string").alias("category"),
        F.col("stock_total").alias("stock"),
    )
    by_category = cells.where("has_physical and category is not null").select(
        "location_id", "as_of", "category", F.col("stock_on_shelf").alias("stock")
    )
    return totals.unionByName(by_category)


def _lookup(rows: DataFrame, attributes: dict[str, str], loc_map: DataFrame) -> DataFrame:
    named = rows.select(
        "branch_id",
        "code_norm",
        *[null_to_blank(F.col(c)).alias(name) for c, name in attributes.items()],
    ).distinct()
    # Branch and code stand for exactly one location, so the rows stay distinct.
    located = named.join(loc_map.where("location_id is not null"), ["branch_id", "code_norm"])
    return located.select("location_id", *attributes.values())


def lookup_physical(capacity: DataFrame, loc_map: DataFrame) -> DataFrame:
    """Marking and type of each location in the physical source."""
    return _lookup(capacity, {"marking": "marking", "type": "type"}, loc_map)


def lookup_realloc(realloc: DataFrame, loc_map: DataFrame) -> DataFrame:
    """Descriptor and category of each location in the reallocation source."""
    return _lookup(realloc, {"descriptor": "descriptor", "category": "category"}, loc_map)
