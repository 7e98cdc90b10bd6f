"""Writers: the exported tables, the quality report, and named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.plans.model import Model
from shelfspan.sources.listing import list_files

# Export name and the model's table behind it.
EXPORTS = {
    "dim_branch": "branches",
    "dim_location": "locations",
    "fact_physical": "fact_physical",
    "fact_realloc": "fact_realloc",
    "fact_stock": "fact_stock",
    "metrics_location": "metrics_location_enriched",
    "metrics_location_category": "metrics_location_category",
    "metrics_network": "metrics_network",
    "metrics_area": "metrics_area",
    "metrics_branch": "metrics_branch",
    "lookup_physical": "lookup_physical",
    "lookup_realloc": "lookup_realloc",
}


def export(model: Model, folder: str, fmt: str = "parquet") -> None:
    """Write the twelve result tables, one folder each, replacing earlier ones."""
    for name, table in EXPORTS.items():
        writer = getattr(model, table).write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(f"{folder}/{name}")
        else:
            writer.format(fmt).save(f"{folder}/{name}")


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether every table is there; a write moves its files into place when it is done."""
    done = list_files(spark, folder).select(F.element_at(F.split("path", "/"), -2).alias("name")).where(F.col("name").isin(*EXPORTS))
    return done.distinct().count() == len(EXPORTS)


def write_dq(report: DataFrame, folder: str, details: DataFrame | None = None) -> None:
    """Write the quality report as a table and as lines of text, and its details as a table."""
    if details is not None:
        details.write.mode("overwrite").parquet(f"{folder}/details")
    report.write.mode("overwrite").parquet(f"{folder}/table")
    line = F.concat(
        F.col("check"), F.lit(" / "), F.col("measure"), F.lit(": "), F.col("value").cast("string")
    )
    stored = report.sparkSession.read.parquet(f"{folder}/table")
    stored.select(line.alias("line")).orderBy("line").write.mode("overwrite").text(
        f"{folder}/lines"
    )


def register(model: Model, prefix: str = "") -> list[str]:
    """Offer the model's tables to SQL under their export names."""
    names = {**EXPORTS, "effective_capacity": "effective_capacity"}
    names["effective_capacity_full"] = "effective_capacity_full"
    for name, table in names.items():
        getattr(model, table).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in names]
