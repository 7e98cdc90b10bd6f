"""Reader queries: filters, facets, key figures, rankings, details, display tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan import fixed_values as fv
from shelfspan.config import FilterSpec
from shelfspan.functions.numeric import guarded_ratio
from shelfspan.functions.text import grouped_number, strip, yes_no


def _one_of(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Rows with one of the chosen options; the word for blank means blank."""
    if not values or name not in df.columns:
        return df
    return df.where(F.col(name).isin(*["" if v == fv.BLANK_OPTION else v for v in values]))


def filter_locations(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows of the selected areas, branches, codes, categories and kind of location."""
    out = _one_of(df, "area", spec.areas)
    out = _one_of(out, "branch_name", spec.branches)
    out = _one_of(out, "code", spec.codes)
    out = _one_of(out, "category", spec.categories)
    if spec.is_realloc is None or "is_realloc" not in df.columns:
        return out
    return out.where(F.col("is_realloc") == F.lit(spec.is_realloc))


def filter_source_dims(
    df: DataFrame, lookup_physical: DataFrame, lookup_realloc: DataFrame, spec: FilterSpec
) -> DataFrame:
    """Restrict each kind of location by the attributes of its own source.

    Marking and type restrict unflagged locations, descriptor and category of the plan
    restrict flagged ones; a kind without a selection passes whole.
    """
    allowed = []
    for kind, lookup, wanted in (
        (False, lookup_physical, {"marking": spec.markings, "type": spec.types}),
        (
            True,
            lookup_realloc,
            {"descriptor": spec.descriptors, "category": spec.realloc_categories},
        ),
    ):
        if not any(wanted.values()):
            continue
        for name, values in wanted.items():
            lookup = _one_of(lookup, name, values)
        allowed.append((kind, lookup.select("location_id", F.lit(kind).alias("is_realloc"))))
    if not allowed:
        return df.where("is_realloc is not null")
    hits = allowed[0][1] if len(allowed) == 1 else allowed[0][1].unionByName(allowed[1][1])
    marked = hits.distinct().withColumn("_hit", F.lit(True))
    free = [kind for kind in (False, True) if kind not in {k for k, _ in allowed}]
    passes = F.col("_hit").isNotNull()
    if free:
        passes = passes | F.col("is_realloc").isin(*free)
    return df.join(marked, ["location_id", "is_realloc"], "left").where(passes).select(*df.columns)


def restrict_categories(categories: DataFrame, locations: DataFrame) -> DataFrame:
    """Category rows of the selected locations."""
    return categories.join(locations.select("location_id").distinct(), "location_id", "left_semi")


def facet_options(df: DataFrame, name: str) -> DataFrame:
    """The options of one attribute, sorted; blank values appear as one word."""
    c = F.col(name)
    shown = F.when(strip(c) == "", fv.BLANK_OPTION).otherwise(c).alias("option")
    return df.where(c.isNotNull()).select(shown).distinct().orderBy("option")


def kpi(df: DataFrame) -> DataFrame:
    """The six key figures of a selection.

    Sums of nothing are zero.  Fill compares stock and physical capacity of the locations
    that have a physical capacity; what remains is counted over all.
    """
    capacity, stock = F.col("capacity_physical_sum"), F.col("stock_total")
    covered = F.sum(F.when(capacity.isNotNull(), stock))

    def filled(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return df.agg(
        filled(capacity).alias("capacity_physical"),
        filled(F.col("capacity_realloc_sum")).alias("capacity_realloc"),
        filled(stock).alias("stock"),
        (guarded_ratio(covered, F.sum(capacity)) * 100.0).alias("fill_pct"),
        (filled(capacity) - filled(stock)).alias("remaining"),
        F.count("*").alias("locations"),
    )


def realloc_share(df: DataFrame) -> DataFrame:
    """How many locations are flagged and how many are not."""
    return df.groupBy("is_realloc").agg(F.count("*").alias("locations"))


def kpi_series(df: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """The three sums of a selection, one row each."""
    sums = kpi(df).select(
        *[F.col(c).cast("double").alias(c) for c in ("capacity_physical", "stock", "capacity_realloc")]
    )
    named = sums.withColumnsRenamed(dict(labels)) if labels else sums
    return named.unpivot([], named.columns, "series", "items")


def areas_ranked(area_metrics: DataFrame, areas: Sequence[str] = ()) -> DataFrame:
    """Areas by fill, fullest first, areas without a fill last."""
    return _one_of(area_metrics, "area", areas).orderBy(F.desc_nulls_last("fill_pct"), "area")


def top_k(df: DataFrame, by: str, k: int, ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), ties).limit(k)


def bottom_k(df: DataFrame, by: str, k: int, ties: str, max_value: float) -> DataFrame:
    return df.where(F.col(by) <= max_value).orderBy(F.asc_nulls_last(by), ties).limit(k)


def branches_top(branch_metrics: DataFrame, k: int = 40, areas: Sequence[str] = ()) -> DataFrame:
    """The fullest branches."""
    return top_k(_one_of(branch_metrics, "area", areas), "fill_pct", k, "branch_id")


def branch_detail(df: DataFrame, branch_name: str) -> DataFrame:
    """Locations of one branch."""
    return df.where(F.col("branch_name") == branch_name)


def category_detail(df: DataFrame, code: str) -> DataFrame:
    """Categories of the locations with one code."""
    return df.where(F.col("code") == code)


def overloaded_top(df: DataFrame, k: int = 30) -> DataFrame:
    """The most overloaded locations."""
    return top_k(df.where("overloaded"), "fill_pct", k, "location_id")


def least_used(df: DataFrame, k: int = 30) -> DataFrame:
    """The emptiest locations that are not overfull."""
    return bottom_k(df, "fill_pct", k, "location_id", 100.0)


def _present(df: DataFrame, labels: Mapping[str, str], flags: Sequence[str]) -> DataFrame:
    return df.select(
        *[
            (yes_no(F.col(c)) if c in flags else F.col(c)).alias(labels.get(c, c))
            for c in df.columns
        ]
    )


def present_locations(df: DataFrame, labels: Mapping[str, str] = fv.LOCATION_LABELS) -> DataFrame:
    """Location metrics under reader-facing labels, flags as words."""
    return _present(df, labels, ("is_realloc", "overloaded", "at_risk"))


def present_areas(df: DataFrame, labels: Mapping[str, str] = fv.AREA_LABELS) -> DataFrame:
    return _present(df, labels, ())


def present_categories(df: DataFrame, labels: Mapping[str, str] = fv.CATEGORY_LABELS) -> DataFrame:
    return _present(df, labels, ("is_realloc",))


def present_kpi(figures: DataFrame) -> DataFrame:
    """Key figures as text: grouped whole numbers, fill with two places and a sign, the number of locations as it is."""
    pct = F.when(F.col("fill_pct").isNotNull(), F.format_string("%.2f %%", "fill_pct"))
    return figures.select(
        *[
            F.coalesce(pct, F.lit(fv.UNKNOWN)).alias(c)
            if c == "fill_pct"
            else (F.col(c).cast("string") if c == "locations" else grouped_number(F.col(c))).alias(c)
            for c in figures.columns
        ]
    )
