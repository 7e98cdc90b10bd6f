"""Batch run: ``python -m shelfspan <input folder> <output folder> [parquet|csv [names.json]]``."""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shelfspan.config import SESSION_OPTIONS, ModelConfig, SourceNames
from shelfspan.plans.model import build_model
from shelfspan.sources import sinks
from shelfspan.sources.listing import input_manifest, resolve_sources, unchanged


MODEL_VERSION = 2  # raised when the same inputs give other results


def run(
    spark: SparkSession, root: str, out: str, fmt: str = "parquet", raw: str | None = None,
    capacity: str | None = None, config: ModelConfig = ModelConfig(), names: SourceNames = SourceNames(),
) -> bool:
    """Rebuild the exports of a folder; False when inputs, format and settings are those of the exports at hand."""
    sources = resolve_sources(spark, root, raw, capacity, names)
    settings = repr((MODEL_VERSION, fmt, sources.mode, sorted(sources.paths.items()), config))
    # Taken before anything is read, so that a change during the build is noticed next time.
    seen = input_manifest(spark, sorted(sources.paths.values())).withColumn("settings", F.lit(settings))
    manifest = spark.createDataFrame([seen.first()], seen.schema)
    try:
        same = unchanged(manifest, spark.read.parquet(f"{out}/manifest"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        same = False
    if same and sinks.complete(spark, f"{out}/exports"):
        return False
    model = build_model(spark, sources, config)
    sinks.export(model, f"{out}/exports", fmt)
    sinks.write_dq(model.dq_report, f"{out}/quality", model.dq_details)
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    return True


def main(argv: list[str]) -> int:
    if len(argv) not in (2, 3, 4):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("shelfspan").getOrCreate()
    for name, value in SESSION_OPTIONS.items():
        spark.conf.set(name, value)
    names = SourceNames()
    if len(argv) == 4:
        with open(argv[3], encoding="utf-8") as file:
            names = SourceNames.from_json(file.read())
    done = run(spark, *argv[:3], names=names)
    print("exports written" if done else "inputs unchanged, nothing to do")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
