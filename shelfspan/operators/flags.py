"""The reallocation flag and the key of a location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.functions.text import name_key
from shelfspan.operators.keys import join_null_safe


def flag_realloc(stock: DataFrame, realloc: DataFrame) -> DataFrame:
    """Locations with ``is_realloc``: the reallocation source names them in some way.

    A reallocation row names a location by code and branch number, by code alone when it
    has no number, or by code and branch name.  Each way is an equi join against distinct
    keys of its own; a single join with alternatives would compare every location with
    every reallocation row of the same code.  Many locations may share a code.
    """
    marked = F.lit(True)
    coded = realloc.where("code_norm != ''")
    anywhere = coded.where("branch_id is null").select("code_norm").distinct()
    numbered = coded.where("branch_id is not null").select("code_norm", "branch_id").distinct()
    named = realloc.select("code_norm", name_key(F.col("branch_name")).alias("_name"))
    named = named.where("_name != ''").distinct()

    found = stock.withColumn("_name", name_key(F.col("branch_name")))
    found = join_null_safe(found, numbered.withColumn("_by_number", marked), ["code_norm", "branch_id"])
    found = join_null_safe(found, named.withColumn("_by_name", marked), ["code_norm", "_name"])
    found = join_null_safe(found, anywhere.withColumn("_by_code", marked), ["code_norm"])
    flag = F.coalesce("_by_number", "_by_name", "_by_code", F.lit(False)).alias("is_realloc")
    return found.select(*stock.columns, flag)


def location_map(locations: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """For each branch and code the location that stands for them: the smallest id.

    Attributes of that location can come along, so that facts need no join to locations.
    """
    keyed = locations.where("branch_id is not null and code_norm is not null")
    groups = keyed.groupBy("branch_id", "code_norm")
    if not attributes:
        return groups.agg(F.min("location_id").alias("location_id"))
    chosen = F.struct("location_id", *attributes)
    lowest = groups.agg(F.min_by(chosen, "location_id").alias("_lowest"))
    return lowest.select("branch_id", "code_norm", "_lowest.*")


def attach_location_id(df: DataFrame, loc_map: DataFrame) -> DataFrame:
    """Location id and attributes for rows keyed by branch and code, null when unknown."""
    return df.join(loc_map, ["branch_id", "code_norm"], "left")
