"""Order-dependent fill that does not need a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18


def fill_within_group(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    order: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill nulls with the last value before, else the first value after, in the group.

    The order must be unique within a group and end in a whole-number column, such as a row
    number inside a file.  Groups are cut into blocks of that number, so that a group of any
    size is spread over many tasks: windows run inside the blocks, one line per block tells
    its first and last value, and what a block inherits from its neighbours is worked out on
    those lines alone.
    """
    *major, minor = order
    block = F.struct(*major, F.floor(F.col(minor) / block_rows).alias("_n")).alias("_block")
    # Group and block as one value, equal also where a group column is null: rows are shuffled
    # by it once, for the windows and for the join.
    rows = df.withColumn("_at", F.struct(*group, block))

    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy("_at").rowsBetween(*up_to_here)
    downwards = [F.desc(c) for c in order]
    filled = rows.withColumns(
        {
            "_before": F.last(value, True).over(inside.orderBy(*order)),
            "_after": F.last(value, True).over(inside.orderBy(*downwards)),
        }
    )

    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = rows.groupBy("_at").agg(
        F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last")
    )
    across = Window.partitionBy(*[F.col("_at")[c] for c in group]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    place = F.col("_at._block")
    inherited = ends.select(
        "_at",
        F.last("_last", True).over(across.orderBy(place)).alias("_carry"),
        F.last("_first", True).over(across.orderBy(place.desc())).alias("_ahead"),
    )

    joined = filled.join(inherited, "_at", "left")
    found = F.coalesce("_before", "_carry", "_after", "_ahead")
    return joined.select(*[found.alias(c) if c == value else F.col(c) for c in df.columns])
