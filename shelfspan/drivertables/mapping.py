"""Sample tables as the sources of a capacity model (see FIXTURES.md).

Customers are locations, nations branches, regions areas; finished orders are physical
capacity, open ones planned capacity, pending ones stock.  Money is kept exact, as
decimals, so that sums do not depend on the order they are formed in.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.config import ModelConfig
from shelfspan.functions.text import code_key
from shelfspan.plans.model import Model, ModelInputs

STORAGE = "MIDDLE EAST"
CONFIG = ModelConfig(
    storage_area=STORAGE,
    unassigned_area="UNASSIGNED",
    canonical_areas=("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    branch_overrides=(("nation_4", 9, "NATION_9", STORAGE),),
)
MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Tables:
    """The sample tables of one folder, and the source rows derived from them."""

    spark: SparkSession
    folder: str

    _read: dict[str, DataFrame] = field(default_factory=dict)
    _models: dict[bool, Model] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        """A table, its schema looked up once."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]

    # --- dimensions ---------------------------------------------------------------

    def nations(self) -> DataFrame:
        """Every branch with its area."""
        regions = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        joined = self.table("nation").join(regions, "n_regionkey", "left")
        return joined.select(
            F.col("n_nationkey").cast("bigint").alias("branch_id"),
            F.col("n_name").alias("branch_name"),
            F.col("r_name").alias("area"),
        )

    def branches(self) -> DataFrame:
        """The branch catalogue.  One branch is not in it, so its locations have no area."""
        return self.nations().where("branch_name != 'NATION_24'")

    def places(self) -> DataFrame:
        """Locations by branch number, without their stock."""
        return self.table("customer").select(
            F.col("c_custkey").alias("location_id"),
            F.col("c_name").alias("code"),
            code_key(F.col("c_name")).alias("code_norm"),
            F.col("c_nationkey").cast("bigint").alias("branch_id"),
            "c_mktsegment",
            "c_acctbal",
        )

    def named_places(self) -> DataFrame:
        """Locations with name and area of their branch."""
        return self.places().join(self.nations(), "branch_id", "left")

    def stock(self) -> DataFrame:
        """Locations with the value and date of their pending orders."""
        pending = self.orders("P").groupBy("location_id").agg(
            F.sum("price").alias("stock_total"),
            F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("as_of"),
        )
        return self.named_places().join(pending, "location_id", "left").select(
            "location_id",
            "branch_id",
            "branch_name",
            "code",
            "code_norm",
            F.coalesce("stock_total", F.lit(0)).alias("stock_total"),
            "as_of",
        )

    # --- capacity rows --------------------------------------------------------------

    def orders(self, status: str) -> DataFrame:
        return self.table("orders").where(F.col("o_orderstatus") == status).select(
            "o_orderkey",
            F.col("o_custkey").alias("location_id"),
            F.col("o_orderstatus").alias("marking"),
            F.col("o_orderpriority").alias("type"),
            "o_orderdate",
            F.col("o_totalprice").cast(MONEY).alias("price"),
        )

    def _by_location(self, rows: DataFrame, **sums: Column) -> DataFrame:
        """Order rows summed per location and type, before they meet the locations."""
        return rows.groupBy("location_id", "marking", "type").agg(
            *[c.alias(name) for name, c in sums.items()]
        )

    def physical(self, shelf: bool = False) -> DataFrame:
        """Physical capacity rows, on request with the stock on the shelf."""
        rows = self.orders("F")
        if shelf:
            items = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
                F.sum(F.col("l_extendedprice").cast(MONEY)).alias("shelf")
            )
            rows = rows.join(items, "o_orderkey", "left")
            on_shelf = F.sum("shelf")
        else:
            on_shelf = F.lit(None).cast("decimal(38,2)")
        cells = self._by_location(rows, capacity_physical=F.sum("price"), stock_on_shelf=on_shelf)
        return cells.join(self.places(), "location_id").select(
            "branch_id", "code", "code_norm", category(), "type", "marking",
            "capacity_physical", "stock_on_shelf",
        )

    def realloc(self) -> DataFrame:
        """Planned capacity rows, of one segment of locations."""
        cells = self._by_location(self.orders("O"), capacity_realloc=F.sum("price"))
        building = self.places().where("c_mktsegment = 'BUILDING'")
        return cells.join(building, "location_id").select(
            "branch_id", F.lit("").alias("branch_name"), "code", "code_norm", category(),
            F.col("c_mktsegment").alias("descriptor"), "capacity_realloc",
        )

    def capacity_orders(self, status: str) -> DataFrame:
        """Capacity rows one by one, as they come before any summing."""
        return self.orders(status).join(self.named_places(), "location_id").select(
            "o_orderkey", "branch_id", "branch_name", "area", "code", "code_norm", category(),
            F.col("price").alias("capacity_physical"), "c_mktsegment", "c_acctbal",
        )

    def warehouse(self) -> DataFrame:
        """Warehouse rows of the storage branches, some without a code or a capacity."""
        rows = self.capacity_orders("P").where(F.col("area") == STORAGE)
        no_code = F.col("c_acctbal") > 9000
        no_capacity = F.col("c_mktsegment") == "FURNITURE"
        code = F.when(no_code, F.lit("")).otherwise(F.col("code"))
        capacity = F.when(no_capacity, F.lit(0).cast(MONEY)).otherwise(F.col("capacity_physical"))
        return rows.withColumns(
            {"code": code, "code_norm": code_key(code), "capacity_physical": capacity}
        )

    def depot_map(self) -> DataFrame:
        """Code map that only applies once a branch has been renumbered."""
        overdrawn = self.named_places().where("c_acctbal < 0 and branch_name = 'NATION_4'")
        return overdrawn.select(
            F.lit(9).cast("bigint").alias("branch_id"),
            F.col("code").alias("source_code"),
            F.lit("depot").alias("target_code"),
            F.lit("map").alias("src_file"),
            F.col("location_id").alias("src_row"),
        )

    def voting_rows(self) -> DataFrame:
        """Capacity rows with unclear areas and missing branch numbers."""
        places = self.named_places()
        unnumbered = F.col("c_acctbal") < 0
        area = (
            F.when(F.col("area") == "ASIA", None)
            .when((F.col("area") == "AFRICA") & ~unnumbered, F.lit("  "))
            .when(F.col("c_mktsegment") == "MACHINERY", "EUROPE")
            .otherwise(F.col("area"))
        )
        return places.select(
            F.when(~unnumbered, F.col("branch_id")).alias("branch_id"),
            F.concat(F.lit(" "), F.lower("branch_name"), F.lit("\t")).alias("branch_name"),
            area.alias("area"),
            "code_norm",
        )

    def area_map(self) -> DataFrame:
        """Map of the areas no capacity row tells: some by number, some by name only."""
        asia = self.nations().where("area = 'ASIA'")
        by_number = F.col("branch_name") <= "NATION_17"
        by_name = F.col("branch_name") == "NATION_2"
        return asia.where(by_number | by_name).select(
            F.when(by_number, F.col("branch_id")).alias("branch_id"),
            F.when(by_name, F.lower("branch_name")).alias("branch_name"),
            F.concat("area", F.lit(" ")).alias("area"),
            F.lit("map").alias("src_file"),
            F.col("branch_id").alias("src_row"),
        )

    # --- locations with repeated codes ------------------------------------------------

    def shelves(self) -> DataFrame:
        """Locations under short codes that many of them share."""
        bucket = F.floor(F.col("c_acctbal") / 1375).cast("string")
        short = F.concat(F.substring("c_mktsegment", 1, 1), bucket)
        return self.named_places().withColumns({"code": short, "code_norm": code_key(short)})

    def named_keys(self) -> DataFrame:
        """Reallocation rows naming shelves by code only, by number, or by branch name."""
        shelves, none = self.shelves(), F.lit(None).cast("bigint")
        blank = F.lit("")
        by_code = shelves.where("c_acctbal < -900").select(
            "code_norm", none.alias("branch_id"), blank.alias("branch_name")
        )
        by_number = shelves.where("c_acctbal between 5000 and 5200").select(
            "code_norm", "branch_id", blank.alias("branch_name")
        )
        by_name = shelves.where("c_acctbal between 7000 and 7200").select(
            "code_norm",
            F.pmod(F.col("branch_id") + 1, F.lit(25)).alias("branch_id"),
            F.concat(F.lit(" "), F.lower("branch_name")).alias("branch_name"),
        )
        return by_code.unionByName(by_number).unionByName(by_name)

    # --- the model ----------------------------------------------------------------------

    def inputs(self, shelf: bool = False) -> ModelInputs:
        physical = self.physical(shelf)
        return ModelInputs(self.stock(), self.branches(), physical, self.realloc())

    def checked_inputs(self) -> ModelInputs:
        """Inputs with what only the quality checks look at: branch names, areas, warehouse."""
        plain = self.inputs()
        named = plain.physical.join(self.nations(), "branch_id", "left")
        return replace(plain, physical=named)

    def model(self, shelf: bool = False) -> Model:
        """The model over these tables, as lazy plans."""
        if shelf not in self._models:
            self._models[shelf] = Model(self.inputs(shelf), CONFIG)
        return self._models[shelf]


def tables(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder, as they are now."""
    return Tables(spark, folder)


def category() -> Column:
    """The lowest priority stands for no category."""
    return F.nullif(F.col("type"), F.lit("5-LOW")).alias("category")
