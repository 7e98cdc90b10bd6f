"""The whole model: from source rows to metrics, checks and reader queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan import schema
from shelfspan.config import ModelConfig
from shelfspan.operators import areas, conform, flags, keys, ordered
from shelfspan.plans import facts, metrics, quality
from shelfspan.sources import parquet as pq
from shelfspan.sources import text as txt
from shelfspan.sources.listing import SourceSet


_CELL_ATTRIBUTES = ("code", "branch_name", "is_realloc", "as_of")


@dataclass(frozen=True)
class ModelInputs:
    """Conformed source rows, the same whichever files they came from."""

    stock: DataFrame
    branches: DataFrame
    physical: DataFrame
    realloc: DataFrame
    # Warehouse rows after mapping and cleaning; only for the checks.
    warehouse: DataFrame | None = None
    # Main physical rows before the warehouse rows were appended; only for the checks.
    physical_main: DataFrame | None = None
    # What reading left out, as one-row counts by check.
    losses: Mapping[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    """Tables of the model, each a lazy plan over the inputs.

    Capacity rows, locations, cells and location metrics feed most of the others.
    ``materialize`` writes them (capacity rows grouped, which are far fewer) and cuts the
    lineage behind them, so that they are worked out once for any number of results.
    """

    inputs: ModelInputs
    config: ModelConfig = field(default_factory=ModelConfig)
    materialize: bool = False

    def _keep(self, df: DataFrame) -> DataFrame:
        return checkpointed(df) if self.materialize else df

    @property
    def branches(self) -> DataFrame:
        return self.inputs.branches

    @cached_property
    def _physical(self) -> DataFrame:
        rows = self.inputs.physical
        if not self.materialize:
            return rows
        return self._keep(facts.grouped_rows(rows, ["capacity_physical", "stock_on_shelf"]))

    @cached_property
    def _realloc(self) -> DataFrame:
        rows = self.inputs.realloc
        if not self.materialize:
            return rows
        return self._keep(facts.grouped_rows(rows, ["capacity_realloc"]))

    @cached_property
    def locations(self) -> DataFrame:
        flagged = flags.flag_realloc(self.inputs.stock, self._realloc)
        return self._keep(flagged.select(*schema.names(schema.LOCATIONS)))

    @cached_property
    def location_ids(self) -> DataFrame:
        """Which location stands for a branch and code."""
        return flags.location_map(self.locations)

    @cached_property
    def _all_cells(self) -> DataFrame:
        """Cells with every attribute of their location that some table asks for."""
        return self._keep(self._located(_CELL_ATTRIBUTES))

    def _located(self, attributes: Sequence[str]) -> DataFrame:
        cells = facts.capacity_cells(self._physical, self._realloc, self.config.all_null_sum)
        named = flags.location_map(self.locations, attributes)
        return flags.attach_location_id(cells, named)

    def cells(self, *attributes: str) -> DataFrame:
        """Both capacities per branch, code and category, with the location they belong to.

        A lazy plan only looks up the attributes asked for; a materialized model looks up
        all of them once.
        """
        return self._all_cells if self.materialize else self._located(attributes)

    @cached_property
    def fact_physical(self) -> DataFrame:
        return facts.physical_part(self.cells())

    @cached_property
    def fact_realloc(self) -> DataFrame:
        return facts.realloc_part(self.cells())

    @cached_property
    def fact_stock(self) -> DataFrame:
        return facts.fact_stock(self.locations, self.cells("as_of"))

    @cached_property
    def lookup_physical(self) -> DataFrame:
        return facts.lookup_physical(self._physical, self.location_ids)

    @cached_property
    def lookup_realloc(self) -> DataFrame:
        return facts.lookup_realloc(self._realloc, self.location_ids)

    @cached_property
    def effective_capacity(self) -> DataFrame:
        cells = self.cells("is_realloc")
        return metrics.effective_capacity(cells, self.branches, self.config)

    @cached_property
    def effective_capacity_full(self) -> DataFrame:
        cells = self.cells("is_realloc")
        return metrics.effective_capacity_full(cells, self.branches, self.config)

    @cached_property
    def metrics_location_category(self) -> DataFrame:
        cells = self.cells("code", "branch_name", "is_realloc")
        return metrics.metrics_location_category(cells, self.branches, self.config)

    @cached_property
    def metrics_location(self) -> DataFrame:
        # Only the id of a location is taken along; its flag is looked at where it is joined.
        cells = self.cells().select(
            "location_id", "has_physical", "capacity_physical", "capacity_realloc"
        )
        return self._keep(
            metrics.metrics_location(self.locations, self.branches, cells, self.config)
        )

    @cached_property
    def metrics_location_enriched(self) -> DataFrame:
        return metrics.enrich(self.metrics_location, self.config)

    @cached_property
    def metrics_area(self) -> DataFrame:
        return metrics.metrics_area(self.metrics_location_enriched)

    @cached_property
    def metrics_branch(self) -> DataFrame:
        return metrics.metrics_branch(self.metrics_location_enriched)

    @cached_property
    def metrics_network(self) -> DataFrame:
        return metrics.metrics_network(self.metrics_location_enriched)

    @cached_property
    def metrics_grouping_sets(self) -> DataFrame:
        return metrics.metrics_grouping_sets(self.metrics_location_enriched)

    def checks(self) -> dict[str, DataFrame]:
        """The data-quality checks one by one."""
        rows, loc, full = self.inputs, self.locations, self.effective_capacity_full
        found = {
            "source_overlap": quality.source_overlap(rows.stock, rows.realloc),
            "area_conflicts": quality.area_conflicts(rows.physical),
            "unknown_areas": self._unknown_areas,
            "duplicate_ids": quality.duplicate_ids(loc),
            "duplicate_keys": quality.duplicate_keys(loc),
            "no_physical": quality.no_physical(loc, self.fact_physical),
            "orphan_capacity": quality.orphan_capacity(rows.physical, rows.stock),
            "no_effective": quality.no_effective(loc, full),
            "zero_stock": quality.zero_stock(loc),
            "coverage": quality.coverage(loc, full),
            "plan_diff": quality.plan_diff(full, self.config.plan_tolerance),
            "no_branch": quality.no_branch(loc),
        }
        if rows.warehouse is not None and rows.physical_main is not None:
            found["warehouse_merge"] = quality.warehouse_merge(rows.physical_main, rows.warehouse)
        return found | dict(rows.losses)

    @property
    def _unknown_areas(self) -> DataFrame:
        config = self.config
        return quality.unknown_areas(
            self.branches, config.canonical_areas, config.unassigned_area
        )

    @cached_property
    def dq_details(self) -> DataFrame:
        """Branches in conflict with their areas, and unknown areas, by name."""
        config = self.config
        return quality.details(
            self._physical, self.branches, config.canonical_areas, config.unassigned_area
        )

    @cached_property
    def dq_report(self) -> DataFrame:
        """The counts of all checks, worked out together where they share a key."""
        rows = self.inputs
        counted = metrics.with_effective(
            self.cells("is_realloc"), self.branches, self.config.storage_area
        )
        conflicts = quality.area_conflicts(self._physical)
        audits = [
            quality.key_audit(rows.stock, self._realloc, self._physical),
            quality.location_audit(self.locations, counted, self.config.plan_tolerance),
            conflicts.agg(F.count("*").alias("area_conflicts__branches")),
            self._unknown_areas.select(
                F.col("unknown_areas").alias("unknown_areas__unknown_areas")
            ),
        ]
        if rows.warehouse is not None and rows.physical_main is not None:
            merged = quality.warehouse_merge(rows.physical_main, rows.warehouse)
            audits.append(merged.toDF(*[f"warehouse_merge__{c}" for c in merged.columns]))
        for check, lost in rows.losses.items():
            audits.append(lost.toDF(*[f"{check}__{c}" for c in lost.columns]))
        return quality.report(audits)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's checkpoint folder and read back from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _unique_branches(branches: DataFrame) -> DataFrame:
    """One row per branch number, the first in the file; doubles would repeat every sum."""
    numbered = branches.where("branch_id is not null")
    return keys.dedupe(numbered, ["branch_id"], conform.ORDER).select("branch_id", "branch_name")


def _parquet_inputs(
    spark: SparkSession, sources: SourceSet, config: ModelConfig
) -> ModelInputs:
    stock = pq.read_stock(spark, sources.paths["stock"])
    code_map = txt.read_code_map(spark, sources.get("code_map"))
    raw = pq.physical_columns(spark, sources.paths["physical"])
    read = conform.conform_capacity(raw)
    main = physical = keys.apply_code_map(read, code_map)
    warehouse = None
    if sources.get("warehouse"):
        extra = pq.read_warehouse(spark, sources.paths["warehouse"])
        extra = keys.apply_code_map(extra, code_map)
        extra = keys.override_branch(extra, config.branch_overrides)
        # Branch numbers may have changed, so the map can hit codes it passed over before.
        warehouse = keys.clean_warehouse(keys.apply_code_map(extra, code_map))
        physical = keys.append_new_keys(main, warehouse, facts.CELL)

    branch_rows = pq.read_branches(spark, sources.paths["branches"])
    branches = areas.assign_area(
        _unique_branches(branch_rows),
        # Areas of the main file only, as read.
        areas.elect(areas.votes_by_number(read), "branch_id"),
        None,
        txt.read_area_map(spark, sources.get("area_map")),
        config.unassigned_area,
    )
    branches = _small_table(branches, config)
    if sources.get("realloc"):
        realloc = pq.read_realloc(spark, sources.paths["realloc"])
        realloc = keys.fill_branch_name(realloc, branches)
    else:
        realloc = schema.empty(spark, schema.REALLOC)
    losses = {
        "duplicate_branches": quality.duplicate_branches(branch_rows),
        "unreadable_branches": conform.unreadable(raw, "branch_id"),
    }
    return ModelInputs(stock, branches, physical, realloc, warehouse, main, losses)


def _csv_inputs(spark: SparkSession, sources: SourceSet, config: ModelConfig) -> ModelInputs:
    stock = conform.conform_stock(txt.parse_stock_export(spark, sources.paths["stock"]))
    path = sources.paths["capacity"]
    single = path.lower().endswith(".csv")
    raw = txt.read_capacity_csv(spark, path) if single else txt.read_parts(spark, path)
    rows = conform.conform_capacity(raw)
    if not single:
        # Inside a part, which is one branch, rows without a number take that of the others.
        rows = ordered.fill_within_group(rows, ["branch_name"], "branch_id", conform.ORDER)
    names = keys.name_catalogue(stock, conform.ORDER)
    rows = keys.fill_branch_from_catalogue(rows, names)
    rows = conform.require(rows, "branch_id")
    code_map = txt.read_code_map(spark, sources.get("code_map"))
    physical = keys.apply_code_map(rows, code_map).drop(*conform.ORDER)

    branches = areas.assign_area(
        _unique_branches(stock),
        areas.elect(areas.votes_by_number(physical), "branch_id"),
        areas.elect(areas.votes_by_name(physical), "branch_name"),
        txt.read_area_map(spark, sources.get("area_map")),
        config.unassigned_area,
    )
    if sources.get("realloc"):
        realloc = conform.conform_realloc(txt.read_realloc_csv(spark, sources.paths["realloc"]))
    else:
        realloc = schema.empty(spark, schema.REALLOC)
    lines = txt.read_export_lines(spark, sources.paths["stock"])
    rejected = txt.rejected_lines(lines)
    losses = {
        # Stock rows repeat their branch; what the model leaves out are further spellings of it.
        "duplicate_branches": quality.duplicate_branches(
            stock.select("branch_id", "branch_name").distinct()
        ),
        "rejected_lines": rejected.agg(F.count("*").alias("rows")),
        "doubtful_lines": txt.doubtful_lines(lines),
        # Capacity records with surplus or missing fields, a quote left open, or too many lines to gather.
        "rejected_fields": txt.rejected_fields(txt.capacity_rejects(spark, path)),
    }
    if "branch_id" in raw.columns:
        losses["unreadable_branches"] = conform.unreadable(raw, "branch_id")
    return ModelInputs(
        stock, _small_table(branches, config), physical, realloc, losses=losses
    )


def _small_table(branches: DataFrame, config: ModelConfig) -> DataFrame:
    """Branches, worked out once, and broadcast when counted to be few."""
    return checkpointed(branches)


def read_inputs(
    spark: SparkSession, sources: SourceSet, config: ModelConfig = ModelConfig()
) -> ModelInputs:
    """Conformed rows of all sources.  The two sets of files differ in readers only."""
    read = _parquet_inputs if sources.mode == "parquet" else _csv_inputs
    return read(spark, sources, config)


def build_model(
    spark: SparkSession, sources: SourceSet, config: ModelConfig = ModelConfig(),
    materialize: bool = True,
) -> Model:
    """The model over a resolved set of sources."""
    return Model(read_inputs(spark, sources, config), config, materialize)
