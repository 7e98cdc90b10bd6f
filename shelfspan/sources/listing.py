"""Which input files there are, which of them count, and whether they have changed."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.config import SourceNames
from shelfspan.schema import empty

REQUIRED = ("physical", "branches", "stock")


@dataclass(frozen=True)
class SourceSet:
    """Paths of the sources that take part in a build."""

    mode: str  # "parquet" or "csv"
    paths: dict[str, str] = field(default_factory=dict)

    def get(self, role: str) -> str | None:
        return self.paths.get(role)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder with its size and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        found = files.load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, _LISTING)
    return found.select("path", "modificationTime", "length")


_LISTING = "path string, modificationTime timestamp, length bigint"


def list_entries(spark: SparkSession, root: str) -> DataFrame:
    """Files and folders directly below a folder, by name."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    folder = re.sub(scheme, "", root).rstrip("/") + "/"
    path = F.regexp_replace("path", scheme, "")
    if folder.startswith("/"):
        below = F.substr(path, F.lit(len(folder) + 1))
    else:  # relative to wherever the file system says
        below = F.substring_index(path, f"/{folder}", -1)
    entry = F.split_part(below, F.lit("/"), F.lit(1))
    return list_files(spark, root).select(entry.alias("entry")).distinct()


def parquet_role(entry: Column, names: SourceNames = SourceNames()) -> Column:
    """The part a Parquet file plays, judged by words in its name."""
    n = F.lower(entry)
    is_stock = F.greatest(F.lit(False), *(n.contains(word) for word in names.stock_words))
    return (
        F.when(n.contains(names.realloc_word), "realloc")
        .when(n.contains(names.physical_word), "physical")
        .when(
            n.startswith(names.branches_prefix) & ~n.contains(names.branch_stock_word),
            "branches",
        )
        .when(is_stock, "stock")
        .when(n.contains(names.warehouse_word), "warehouse")
    )


def discover_parquet(entries: DataFrame, names: SourceNames = SourceNames()) -> DataFrame:
    """Role and file name; of several files for a role, the last in name order counts."""
    known = entries.where(F.lower("entry").endswith(".parquet")).select(
        parquet_role(F.col("entry"), names).alias("role"), "entry"
    )
    return known.where("role is not null").groupBy("role").agg(
        F.max_by("entry", "entry").alias("entry")
    )


def resolve_sources(
    spark: SparkSession, root: str, raw: str | None = None, capacity: str | None = None,
    names: SourceNames = SourceNames(),
) -> SourceSet:
    """Decide which files a build reads.

    A complete set of Parquet files in the root folder wins over the CSV files in the raw
    folder (``<root>/data_raw`` unless given).  Without it, capacity comes from the path
    given, if there is anything, else from the main or the spare folder of parts, else from the capacity CSV.
    """
    root = root.rstrip("/")
    raw = (raw or f"{root}/data_raw").rstrip("/")
    # At most one row per role.
    found = {r.role: f"{root}/{r.entry}" for r in discover_parquet(list_entries(spark, root), names).collect()}
    wanted = (
        names.stock_export,
        *names.stock_fallbacks,
        names.realloc,
        names.area_map,
        names.code_map,
        *names.capacity_parts,
        names.capacity,
    )
    entries = list_entries(spark, raw).where(F.col("entry").isin(*wanted))
    at_hand = {r.entry for r in entries.collect()}

    def first(*files: str) -> str | None:
        return next((f"{raw}/{n}" for n in files if n in at_hand), None)

    maps = {"area_map": first(names.area_map), "code_map": first(names.code_map)}
    if all(role in found for role in REQUIRED):
        return SourceSet("parquet", _present({**found, **maps}))
    if capacity is not None and list_files(spark, capacity).isEmpty():
        capacity = None
    texts = {
        "stock": first(names.stock_export, *names.stock_fallbacks),
        "realloc": first(names.realloc),
        "capacity": capacity or first(*names.capacity_parts, names.capacity),
        **maps,
    }
    missing = [role for role in ("stock", "capacity") if texts[role] is None]
    if missing:
        raise FileNotFoundError(f"no source for {' and '.join(missing)} in {root} or {raw}")
    return SourceSet("csv", _present(texts))


def _present(paths: dict[str, str | None]) -> dict[str, str]:
    return {role: path for role, path in paths.items() if path is not None}


def input_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One fingerprint over name, time and size of all input files.

    Built from one hash per file, so the files may be many.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    line = F.concat_ws("|", "path", F.unix_micros("modificationTime"), "length")
    h = F.xxhash64(line)
    return files.select(h.alias("h"), "length").agg(
        F.count("*").alias("files"),
        F.sum("length").alias("bytes"),
        F.sha2(
            F.concat_ws(
                "|", F.count("*"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 31)))
            ),
            256,
        ).alias("fingerprint"),
    )


def unchanged(current: DataFrame, stored: DataFrame) -> bool:
    """Whether the inputs are those of the stored manifest, so a rebuild can be skipped."""
    if set(current.columns) != set(stored.columns):
        return False
    return not current.join(stored, current.columns, "left_semi").isEmpty()
