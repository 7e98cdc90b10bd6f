"""Areas of branches: majority vote, conflicts, and the order in which sources count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.functions.text import blank_to_null, name_key, strip
from shelfspan.operators.keys import dedupe


def area_votes(df: DataFrame, key: str, area: str = "area") -> DataFrame:
    """Rows per key and non-blank area."""
    named = df.select(key, blank_to_null(F.col(area)).alias("area"))
    return named.dropna().groupBy(key, "area").agg(F.count("*").alias("votes"))


def elect(votes: DataFrame, key: str) -> DataFrame:
    """The most frequent area of each key; of equals, the first in order."""
    best = F.min(F.struct((-F.col("votes")).alias("rank"), "area")).alias("_best")
    return votes.groupBy(key).agg(best).select(key, F.col("_best.area").alias("area"))


def conflicts(votes: DataFrame, key: str) -> DataFrame:
    """Keys with more than one area, the areas listed in order."""
    areas = F.concat_ws(", ", F.sort_array(F.collect_list("area"))).alias("areas")
    found = votes.groupBy(key).agg(F.count("*").alias("n_areas"), areas)
    return found.where("n_areas > 1")


def mode_area(df: DataFrame, key: str, area: str = "area") -> DataFrame:
    return elect(area_votes(df, key, area), key)


def votes_by_number(capacity: DataFrame) -> DataFrame:
    """Votes of the rows that carry a branch number."""
    return area_votes(capacity, "branch_id")


def votes_by_name(capacity: DataFrame) -> DataFrame:
    """Votes of the rows that carry a name but no number."""
    named = capacity.where(F.col("branch_id").isNull()).withColumn(
        "branch_name", blank_to_null(F.col("branch_name"))
    )
    return area_votes(named, "branch_name")


def _unique_names(areas: DataFrame) -> DataFrame:
    """Areas by matching key of the name; spellings that meet there keep the first area."""
    keyed = areas.select(name_key(F.col("branch_name")).alias("_name"), "area")
    return keyed.where("_name != ''").groupBy("_name").agg(F.min("area").alias("area"))


def assign_area(
    branches: DataFrame,
    by_number: DataFrame,
    by_name: DataFrame | None,
    area_map: DataFrame | None,
    unassigned: str,
    order: Sequence[str] = ("src_file", "src_row"),
) -> DataFrame:
    """Branches with their area, from the first source that knows one.

    Sources in this order: capacity rows by number, capacity rows by name, area map by
    number, area map by name.  What none of them knows is unassigned.
    """
    named = branches.select("branch_id", "branch_name").withColumn(
        "_name", name_key(F.col("branch_name"))
    )
    lookups: list[tuple[str, DataFrame]] = [("branch_id", by_number.select("branch_id", "area"))]
    if by_name is not None:
        lookups.append(("_name", _unique_names(by_name)))
    if area_map is not None:
        known = area_map.withColumn("area", strip(F.col("area")))
        numbered = known.where("branch_id is not null")
        last = dedupe(numbered, ["branch_id"], order, "last")
        lookups.append(("branch_id", last.select("branch_id", "area")))
        spelled = known.withColumn("_name", name_key(F.col("branch_name")))
        last = dedupe(spelled.dropna(subset=["_name", "area"]), ["_name"], order, "last")
        lookups.append(("_name", last.select("_name", "area")))
    for i, (key, areas) in enumerate(lookups):
        named = named.join(areas.withColumnRenamed("area", f"_area{i}"), key, "left")
    found = F.coalesce(*[f"_area{i}" for i in range(len(lookups))], F.lit(unassigned))
    return named.select("branch_id", "branch_name", found.alias("area"))
