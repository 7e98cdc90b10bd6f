"""Connected components of links between 64-bit numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import checkpointed


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm (Kiveris et al., 2014): nodes hand their smallest neighbour to the others.

    Links are (a, b) with a > b. The large step hands it to neighbours above a node, the small step to those below and the node.
    """
    if large:
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = links
    least = ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("node", "low").alias("low"))
    joined = ends.join(least, F.col("a") == F.col("node"))
    moved = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("low"))
    handed = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        handed = handed.union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return handed.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (columns a, b); the root is the smallest node of the component.

    Every round is written to the shared folder, so rounds don't pile up in one plan and a lost executor repeats one round.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links, before = checkpointed(ordered), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = (state["n"], state["s"])
        links = checkpointed(_stars(_stars(links, large=True), large=False))
