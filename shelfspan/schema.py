"""Schemas of the conformed tables, and empty stand-ins for absent optional sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BRANCHES = "branch_id bigint, branch_name string, area string"

LOCATIONS = (
    "location_id bigint, code string, code_norm string, branch_id bigint, branch_name string, "
    "stock_total bigint, as_of string, is_realloc boolean"
)

REALLOC = (
    "branch_id bigint, branch_name string, code string, code_norm string, category string, "
    "descriptor string, capacity_realloc double"
)

AREA_MAP = "branch_id bigint, branch_name string, area string, src_file string, src_row bigint"

CODE_MAP = "branch_id bigint, source_norm string, target_norm string, src_file string, src_row bigint"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """An absent optional source: no rows, but all the columns."""
    return spark.createDataFrame([], schema)


def names(schema: str) -> list[str]:
    """Column names of a schema."""
    return [column.split()[0] for column in schema.split(",")]
