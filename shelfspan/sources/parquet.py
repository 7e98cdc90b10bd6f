"""Readers of the Parquet inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan import fixed_values as fv
from shelfspan.functions.numeric import safe_long
from shelfspan.functions.text import strip
from shelfspan.operators.conform import (
    canonicalize,
    conform_capacity,
    conform_part,
    conform_realloc,
    conform_stock,
)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The file with each row's place in it."""
    return spark.read.parquet(path).select(
        "*",
        F.col("_metadata.file_name").alias("src_file"),
        F.col("_metadata.row_index").alias("src_row"),
    )


def _must_have(df: DataFrame, names: Sequence[str], path: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns for {', '.join(missing)}")
    return df


Headers = Mapping[str, Sequence[str]]


def read_branches(
    spark: SparkSession, path: str, headers: Headers = fv.BRANCH_HEADERS
) -> DataFrame:
    """Branch numbers and names, with their place in the file."""
    df = _must_have(canonicalize(_read(spark, path), headers), ("branch_id", "branch_name"), path)
    number = safe_long(F.col("branch_id"), df.schema["branch_id"].dataType)
    name = strip(F.col("branch_name").cast("string"))
    return df.select(
        number.alias("branch_id"), name.alias("branch_name"), "src_file", "src_row"
    )


def physical_columns(
    spark: SparkSession, path: str, headers: Headers = fv.CAPACITY_HEADERS
) -> DataFrame:
    """The main capacity file under the conformed names, values as they are."""
    df = canonicalize(_read(spark, path), headers)
    return _must_have(df, tuple(n for n in fv.CAPACITY_HEADERS if n != "marking"), path)


def read_physical(
    spark: SparkSession, path: str, headers: Headers = fv.CAPACITY_HEADERS
) -> DataFrame:
    """Rows of the main capacity file; only the marking may be missing."""
    return conform_capacity(physical_columns(spark, path, headers))


def read_warehouse(
    spark: SparkSession, path: str, headers: Headers = fv.CAPACITY_HEADERS
) -> DataFrame:
    """Rows of the warehouse capacity file; any column may be missing."""
    return conform_capacity(canonicalize(_read(spark, path), headers))


def read_stock(
    spark: SparkSession, path: str, headers: Headers = fv.STOCK_HEADERS
) -> DataFrame:
    """Actual stock per location."""
    df = canonicalize(_read(spark, path), headers)
    return conform_stock(_must_have(df, tuple(fv.STOCK_HEADERS), path))


def read_realloc(
    spark: SparkSession, path: str, headers: Headers = fv.CAPACITY_ALIASES
) -> DataFrame:
    """Rows of the reallocation plan; headers may be any of the known aliases."""
    df = canonicalize(conform_part(spark.read.parquet(path), ""), headers)
    planned = df.drop("capacity_realloc").withColumnRenamed("capacity_physical", "capacity_realloc")
    return conform_realloc(planned)
