"""Named queries over the sample tables, one for each behaviour of the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspan.config import FilterSpec
from shelfspan.drivertables.mapping import CONFIG, Tables, tables
from shelfspan.fixed_values import BLANK_OPTION, CAPACITY_ALIASES
from shelfspan.functions.text import code_key
from shelfspan.operators import areas, conform, flags, keys, ordered
from shelfspan.plans import explore, facts, quality
from shelfspan.plans.model import Model
from shelfspan.sources import parquet as pq
from shelfspan.sources import quoted
from shelfspan.sources import text as txt

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}

SELECTION = FilterSpec(
    areas=("ASIA", "EUROPE", "MIDDLE EAST"),
    types=("1-URGENT", "3-MEDIUM"),
    realloc_categories=("2-HIGH", BLANK_OPTION),
)


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, for comparing with other engines."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plain(fn(tables(spark, folder)))


# --- readers, with the headers of the sample tables -----------------------------------------


@query
def read_branches(t: Tables) -> DataFrame:
    headers = {"branch_id": ["n_nationkey"], "branch_name": ["n_name"]}
    return pq.read_branches(t.spark, t.path("nation"), headers).drop(*conform.ORDER)


@query
def read_physical(t: Tables) -> DataFrame:
    headers = {
        "branch_id": ["l_suppkey"], "branch_name": ["l_linestatus"], "area": ["l_returnflag"],
        "code": ["l_partkey"], "category": ["l_linenumber"], "capacity_physical": ["l_quantity"],
        "stock_on_shelf": ["l_extendedprice"],
    }
    return pq.read_physical(t.spark, t.path("lineitem"), headers).drop(*conform.ORDER)


@query
def read_warehouse(t: Tables) -> DataFrame:
    headers = {"branch_id": ["s_nationkey"], "code": ["s_name"], "capacity_physical": ["s_acctbal"]}
    return pq.read_warehouse(t.spark, t.path("supplier"), headers).drop(*conform.ORDER)


@query
def read_stock(t: Tables) -> DataFrame:
    headers = {
        "location_id": ["o_orderkey"], "branch_id": ["o_custkey"], "branch_name": ["o_orderstatus"],
        "code": ["o_orderpriority"], "stock_total": ["o_totalprice"], "as_of": ["o_orderdate"],
    }
    return pq.read_stock(t.spark, t.path("orders"), headers).drop(*conform.ORDER)


@query
def read_realloc(t: Tables) -> DataFrame:
    headers = {
        "branch_id": ["p_size"], "code": ["p_name"], "category": ["p_type"],
        "descriptor": ["p_brand"], "capacity_physical": ["p_retailprice"],
    }
    return pq.read_realloc(t.spark, t.path("part"), headers)


# --- facts and metrics ------------------------------------------------------------------


@query
def fact_physical(t: Tables) -> DataFrame:
    return facts.fact_physical(t.physical(shelf=True), flags.location_map(t.places()))


@query
def fact_realloc(t: Tables) -> DataFrame:
    return facts.fact_realloc(t.realloc(), flags.location_map(t.places()))


@query
def fact_stock(t: Tables) -> DataFrame:
    return t.model(shelf=True).fact_stock


@query
def lookup_physical(t: Tables) -> DataFrame:
    return facts.lookup_physical(t.physical(), flags.location_map(t.places()))


@query
def lookup_realloc(t: Tables) -> DataFrame:
    return facts.lookup_realloc(t.realloc(), flags.location_map(t.places()))


@query
def effective_capacity(t: Tables) -> DataFrame:
    return t.model().effective_capacity


@query
def effective_capacity_full(t: Tables) -> DataFrame:
    return t.model().effective_capacity_full


@query
def metrics_location_category(t: Tables) -> DataFrame:
    return t.model(shelf=True).metrics_location_category


@query
def metrics_location(t: Tables) -> DataFrame:
    return t.model().metrics_location


@query
def metrics_location_enriched(t: Tables) -> DataFrame:
    return t.model().metrics_location_enriched


@query
def metrics_area(t: Tables) -> DataFrame:
    return t.model().metrics_area


@query
def metrics_branch(t: Tables) -> DataFrame:
    return t.model().metrics_branch


@query
def metrics_network(t: Tables) -> DataFrame:
    return t.model().metrics_network


@query
def metrics_grouping_sets(t: Tables) -> DataFrame:
    return t.model().metrics_grouping_sets


# --- conformance --------------------------------------------------------------------------


@query
def location_map(t: Tables) -> DataFrame:
    return flags.location_map(t.shelves())


@query
def realloc_flag(t: Tables) -> DataFrame:
    named = keys.fill_branch_name(t.named_keys(), t.branches())
    flagged = flags.flag_realloc(t.shelves(), named)
    return flagged.select("location_id", "branch_id", "code_norm", "is_realloc")


@query
def code_map_applied(t: Tables) -> DataFrame:
    places = t.places()
    lowest = places.groupBy("branch_id").agg(F.min_by("code", "location_id").alias("target_code"))
    own = places.where("c_acctbal < 0").join(lowest, "branch_id").select(
        "branch_id",
        F.col("code").alias("source_code"),
        "target_code",
        F.lit("a").alias("src_file"),
        F.col("location_id").alias("src_row"),
    )
    # Spelled otherwise and further down, so these win over the rows above.
    later = places.where("c_acctbal < -500").select(
        "branch_id",
        F.concat(F.lower("code"), F.lit(" ")).alias("source_code"),
        F.lit(" depot").alias("target_code"),
        F.lit("b").alias("src_file"),
        F.col("location_id").alias("src_row"),
    )
    messy = F.concat(F.lit("  "), F.lower("code"), F.lit("\t"))
    rows = places.select(
        "location_id", "branch_id", messy.alias("code"), code_key(messy).alias("code_norm")
    )
    return keys.apply_code_map(rows, keys.conform_code_map(own.unionByName(later)))


def _warehouse(t: Tables) -> DataFrame:
    depot = keys.conform_code_map(t.depot_map())
    rows = keys.apply_code_map(t.warehouse(), depot)
    rows = keys.override_branch(rows, CONFIG.branch_overrides)
    return keys.clean_warehouse(keys.apply_code_map(rows, depot))


@query
def warehouse_append(t: Tables) -> DataFrame:
    both = keys.append_new_keys(t.capacity_orders("F"), _warehouse(t), facts.CELL)
    return both.drop("c_mktsegment", "c_acctbal")


@query
def area_mode(t: Tables) -> DataFrame:
    return areas.mode_area(t.named_places(), "c_mktsegment")


@query
def area_assigned(t: Tables) -> DataFrame:
    rows = t.voting_rows()
    return areas.assign_area(
        t.nations(),
        areas.elect(areas.votes_by_number(rows), "branch_id"),
        areas.elect(areas.votes_by_name(rows), "branch_name"),
        t.area_map(),
        CONFIG.unassigned_area,
    )


@query
def fill_within_group(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("priority")
    rows = t.table("orders").select("o_custkey", "o_orderkey", value)
    return ordered.fill_within_group(rows, ["o_custkey"], "priority", ["o_orderkey"])


@query
def dedupe_first_last(t: Tables) -> DataFrame:
    rows = t.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")

    def kept(keep: str) -> DataFrame:
        one = keys.dedupe(rows, ["o_custkey", "o_orderstatus"], ["o_orderkey"], keep)
        return one.withColumn("keep", F.lit(keep))

    return kept("first").unionByName(kept("last"))


@query
def branch_from_catalogue(t: Tables) -> DataFrame:
    nations = t.nations().select("branch_id", "branch_name")
    suppliers = t.table("supplier").select(
        "s_suppkey", "s_acctbal", F.col("s_nationkey").cast("bigint").alias("branch_id")
    )
    known = F.when(F.col("s_acctbal") >= 2000, F.col("branch_id"))
    messy = F.concat(F.lit("\t"), F.upper("branch_name"), F.lit(" "))
    rows = suppliers.join(nations, "branch_id", "left").select(
        "s_suppkey", known.alias("branch_id"), messy.alias("branch_name")
    )
    stock = t.named_places().withColumn("branch_name", F.lower("branch_name"))
    return keys.fill_branch_from_catalogue(rows, keys.name_catalogue(stock, ["location_id"]))


@query
def conform_aliases(t: Tables) -> DataFrame:
    """Planned capacity under hand-made headers and as text, then conformed."""
    places = t.places().select("location_id", "branch_id", "code", "c_mktsegment")
    orders = t.table("orders").select(
        "o_orderkey", F.col("o_custkey").alias("location_id"), "o_orderpriority", "o_totalprice",
        "o_orderstatus",
    )
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = orders.join(places, "location_id").select(
        F.col("o_orderkey").alias("Order Key"),
        F.concat(F.lit(" "), F.col("branch_id").cast("string"), F.lit(".0 ")).alias(
            " KAPACITA_CISLOKNIH"
        ),
        F.concat(F.lit("\t"), F.lower("code"), F.lit(" ")).alias("Kapacita Lokace Short"),
        F.when(F.col("o_orderpriority") == "5-LOW", "  ")
        .otherwise(F.concat("o_orderpriority", F.lit(" ")))
        .alias("Kapacita OCH"),
        F.when(F.col("o_orderstatus") == "P", "x")
        .when(F.col("o_orderstatus") == "O", F.concat(price, F.lit("e1")))
        .otherwise(F.concat(F.lit(" "), price))
        .alias("Kapacita_Plan"),
    )
    part = conform.canonicalize(conform.conform_part(raw, ""), CAPACITY_ALIASES)
    plan = conform.conform_realloc(part.withColumnRenamed("capacity_physical", "capacity_realloc"))
    return plan.select(
        "branch_id", "branch_name", "code", "code_norm", "category", "descriptor",
        "capacity_realloc",
    )


@query
def parse_stock_export(t: Tables) -> DataFrame:
    return txt.parse_stock_lines(_export_lines(t))


@query
def stock_export_doubts(t: Tables) -> DataFrame:
    """Export lines of which some names hold a comma and some branches are no numbers."""
    name = F.when(F.col("c_acctbal") > 5000, "Main, north").otherwise("Main")
    branch = F.when(F.col("c_mktsegment") == "MACHINERY", "z").otherwise(
        F.col("c_nationkey").cast("string")
    )
    count = F.when(F.col("c_acctbal") < 0, "n/a").otherwise("1 0")
    lines = t.table("customer").select(
        F.concat_ws(
            ",", F.col("c_custkey").cast("string"), branch, name, F.lit("A1"), count,
            F.lit("2026-01-01"),
        ).alias("value")
    )
    return txt.doubtful_lines(lines)


@query
def stock_export_rejects(t: Tables) -> DataFrame:
    return txt.rejected_lines(_export_lines(t))


def _export_lines(t: Tables) -> DataFrame:
    """Locations as printed by a SQL client, between lines that are no records."""
    branch = F.when(F.col("c_mktsegment") == "FURNITURE", "<null>").otherwise(
        F.col("branch_id").cast("string")
    )
    count = F.when(F.col("c_acctbal") < 0, "n/a").otherwise(
        F.concat(F.lit("1 "), F.col("location_id").cast("string"))
    )
    records = t.places().select(
        F.concat_ws(
            ",", F.col("location_id").cast("string"), branch,
            F.when(F.col("c_acctbal") > 9000, "NULL").otherwise(F.col("code")),
            F.concat(F.lit(" "), F.lower("code")), count, F.lit("2026-01-01"),
        ).alias("value")
    )
    noise = t.nations().select(
        F.explode(
            F.array(
                F.concat(F.lit("select * from "), F.col("branch_name")),
                F.concat(F.lit("Records: "), F.col("branch_id").cast("string")),
                F.concat(F.col("branch_id").cast("string"), F.lit(", ===, a, b, c, d")),
                F.lit(" "),
            )
        ).alias("value")
    )
    short = t.table("supplier").select(
        F.concat_ws(" , ", F.col("s_suppkey").cast("string"), "s_name").alias("value")
    )
    return records.unionByName(noise).unionByName(short)


def _csv_field(value) -> F.Column:
    """A value as a quoted CSV field, its quotes doubled."""
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def _csv_lines(records: DataFrame, header: str) -> DataFrame:
    """Records (key >= 0, record) after a header cut into the physical lines of one file, in blocks of a thousand keys."""
    head = records.sparkSession.createDataFrame([(-1, header)], "key long, record string")
    lines = head.unionByName(records).select("key", F.posexplode(F.split("record", "\n")).alias("k", "value"))
    return lines.select(
        F.lit("generated.csv").alias("file"), (F.floor(F.col("key") / 1000)).alias("block"),
        (F.col("key") * 1_000_000 + F.col("k")).alias("place"), "value",
    )


@query
def csv_quoted_records(t: Tables) -> DataFrame:
    """Customers written as CSV whose names hold quotes and separators and some segments two line breaks, read back."""
    name = F.concat("c_name", F.lit(' "q"; r'))
    broken = F.concat("c_mktsegment", F.lit("\n\n"), F.col("c_nationkey").cast("string"))
    segment = F.when(F.col("c_acctbal") > 0, broken).otherwise(F.col("c_mktsegment"))
    records = t.table("customer").select(
        F.col("c_custkey").cast("long").alias("key"),
        F.concat_ws(";", F.col("c_custkey").cast("string"), _csv_field(name), _csv_field(segment)).alias("record"),
    )
    found, _ = quoted.quoted_records(_csv_lines(records, "c_custkey;c_name;c_segment"))
    table = quoted.parsed(found.where(F.col("place") >= 0), ["c_custkey", "c_name", "c_segment"], ";")
    return table.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_segment", "n_lines", "open", "n_fields")


@query
def csv_rejects(t: Tables) -> DataFrame:
    """Suppliers written as CSV of three fields, some with a surplus or a missing one; the records that do not fit."""
    three = F.array(F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string"))
    fields = F.when(F.col("s_nationkey") % 5 == 0, F.concat(three, F.array(F.lit("extra"))))
    fields = fields.when(F.col("s_nationkey") % 7 == 1, F.slice(three, 1, 2)).otherwise(three)
    records = t.table("supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.array_join(fields, ",").alias("record"))
    found, _ = quoted.quoted_records(_csv_lines(records, "a,b,c"))
    table = quoted.parsed(found.where(F.col("place") >= 0), ["a", "b", "c"], ",")
    reason = F.when(F.col("n_fields") > 3, "surplus fields").when(F.col("n_fields") < 3, "missing fields")
    return table.select(
        F.col("a").cast("long").alias("s_suppkey"), F.col("n_fields").cast("int").alias("n_fields"), reason.alias("reason")
    ).where("reason is not null")


@query
def parts_union(t: Tables) -> DataFrame:
    customers = t.table("customer").select(
        F.col("c_name").alias("Kod Lokace"), F.col("c_nationkey").alias("Cislo Pobocky"),
        F.col("c_acctbal").alias("Mista"), F.col("c_mktsegment").alias("KRAJ"),
    )
    suppliers = t.table("supplier").select(
        F.col("s_name").alias("lokace"), F.col("s_nationkey").alias("CISLO KNIH"),
        F.col("s_acctbal").alias("plan"),
    )
    parts = [
        conform.canonicalize(conform.conform_part(df, name), CAPACITY_ALIASES)
        for name, df in (("customers", customers), ("suppliers", suppliers))
    ]
    rows = conform.conform_capacity(txt.union_parts(parts))
    return rows.select("branch_id", "branch_name", "area", "code", "code_norm", "capacity_physical")


# --- data quality ---------------------------------------------------------------------------


@query
def dq_source_overlap(t: Tables) -> DataFrame:
    return quality.source_overlap(t.places(), t.realloc())


@query
def dq_warehouse_merge(t: Tables) -> DataFrame:
    return quality.warehouse_merge(t.capacity_orders("F"), _warehouse(t))


@query
def dq_area_conflicts(t: Tables) -> DataFrame:
    return quality.area_conflicts(t.voting_rows())


@query
def dq_unknown_areas(t: Tables) -> DataFrame:
    return quality.unknown_areas(t.branches(), CONFIG.canonical_areas, CONFIG.unassigned_area)


@query
def dq_duplicate_ids(t: Tables) -> DataFrame:
    suppliers = t.table("supplier").select(F.col("s_suppkey").alias("location_id"))
    return quality.duplicate_ids(t.places().select("location_id").unionByName(suppliers))


@query
def dq_duplicate_keys(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.shelves())


@query
def duplicate_key_rows(t: Tables) -> DataFrame:
    rows = keys.duplicates(t.shelves(), quality.LOCATION_KEY)
    return rows.select("location_id", "branch_id", "code_norm")


@query
def dq_no_physical(t: Tables) -> DataFrame:
    physical = facts.fact_physical(t.physical(), flags.location_map(t.places()))
    return quality.no_physical(t.places(), physical)


@query
def dq_orphan_capacity(t: Tables) -> DataFrame:
    return quality.orphan_capacity(t.voting_rows(), t.places())


@query
def dq_no_effective(t: Tables) -> DataFrame:
    m = t.model()
    return quality.no_effective(m.locations, m.effective_capacity_full)


@query
def dq_zero_stock(t: Tables) -> DataFrame:
    return quality.zero_stock(t.stock())


@query
def dq_coverage(t: Tables) -> DataFrame:
    m = t.model()
    return quality.coverage(m.locations, m.effective_capacity_full)


@query
def dq_plan_diff(t: Tables) -> DataFrame:
    return quality.plan_diff(t.model().effective_capacity_full, CONFIG.plan_tolerance)


@query
def dq_no_branch(t: Tables) -> DataFrame:
    return quality.no_branch(txt.parse_stock_lines(_export_lines(t)))


@query
def dq_report(t: Tables) -> DataFrame:
    return Model(t.checked_inputs(), CONFIG).dq_report


@query
def dq_details(t: Tables) -> DataFrame:
    canonical, unassigned = CONFIG.canonical_areas, CONFIG.unassigned_area
    return quality.details(t.voting_rows(), t.branches(), canonical, unassigned)


# --- reader queries ---------------------------------------------------------------------------


@query
def filter_locations(t: Tables) -> DataFrame:
    spec = FilterSpec(areas=("ASIA", "EUROPE"), is_realloc=True)
    return explore.filter_locations(t.model().metrics_location_enriched, spec)


def _selected(t: Tables) -> DataFrame:
    m = t.model()
    some = explore.filter_locations(m.metrics_location_enriched, SELECTION)
    return explore.filter_source_dims(some, m.lookup_physical, m.lookup_realloc, SELECTION)


@query
def filter_source_dims(t: Tables) -> DataFrame:
    return _selected(t)


@query
def filter_categories(t: Tables) -> DataFrame:
    m = t.model(shelf=True)
    spec = FilterSpec(categories=("1-URGENT", "2-HIGH"))
    categories = explore.filter_locations(m.metrics_location_category, spec)
    overfull = m.metrics_location_enriched.where("overloaded")
    return explore.restrict_categories(categories, overfull)


@query
def facet_options(t: Tables) -> DataFrame:
    return explore.facet_options(t.model().lookup_realloc, "category")


@query
def kpi_selection(t: Tables) -> DataFrame:
    return explore.kpi(_selected(t))


@query
def kpi_network(t: Tables) -> DataFrame:
    return explore.kpi(t.model().metrics_location)


@query
def present_kpi(t: Tables) -> DataFrame:
    return explore.present_kpi(explore.kpi(t.model().metrics_location))


@query
def realloc_share(t: Tables) -> DataFrame:
    return explore.realloc_share(_selected(t))


@query
def kpi_series(t: Tables) -> DataFrame:
    return explore.kpi_series(_selected(t))


@query
def areas_ranked(t: Tables) -> DataFrame:
    return explore.areas_ranked(t.model().metrics_area)


@query
def branches_top40(t: Tables) -> DataFrame:
    return explore.branches_top(t.model().metrics_branch, 40, ("ASIA", "EUROPE", "AFRICA"))


@query
def branches_top5(t: Tables) -> DataFrame:
    return explore.branches_top(t.model().metrics_branch, 5, ("ASIA", "EUROPE", "AFRICA"))


@query
def branch_detail(t: Tables) -> DataFrame:
    return explore.branch_detail(t.model().metrics_location_enriched, "NATION_7")


@query
def category_detail(t: Tables) -> DataFrame:
    return explore.category_detail(
        t.model(shelf=True).metrics_location_category, "Customer#000000007"
    )


@query
def overloaded_top30(t: Tables) -> DataFrame:
    return explore.overloaded_top(t.model().metrics_location_enriched, 30)


@query
def least_used_bottom30(t: Tables) -> DataFrame:
    return explore.least_used(t.model().metrics_location_enriched, 30)


@query
def present_locations(t: Tables) -> DataFrame:
    return explore.present_locations(t.model().metrics_location_enriched)


@query
def present_areas(t: Tables) -> DataFrame:
    return explore.present_areas(t.model().metrics_area)


@query
def present_categories(t: Tables) -> DataFrame:
    return explore.present_categories(t.model(shelf=True).metrics_location_category)
