"""Records of delimited text whose quoted values may hold line breaks, read from splittable lines.

A parallel quote-state scan. Every line knows the parity of the quote signs in it. Lines are dealt by split (block) over as many
tasks as the scan had, and each split is walked in order: its parity prefix is summed, and for either state the split may start in
(outside or inside quotes) the place where its latest record began is kept. Each split then reports what it turns the state into
and where, in either case, its last record begins. The small table of splits (one row each, so its size is bounded by input bytes
over the split size) is composed in file order, so every split learns its real starting state and the record that runs into it.
Lines then know their record; lines that are a whole record stay where they are, and only the lines of records over more than one
line are gathered, by record. Records of more than `most_lines` lines (an unclosed quote swallowing a file) are not gathered: they
go to the reject channel with their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LINES = 10_000


def _parity(value: Column, quote: str) -> Column:
    return ((F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))) % 2).cast("int")


def quoted_records(lines: DataFrame, quote: str = '"', most_lines: int = MOST_LINES) -> tuple[DataFrame, DataFrame]:
    """Records of lines (file, block, place, value): places order the lines of a file, a block holds a run of places.

    Returns (records, overlong): records are file, place (of the first line), record (lines joined by a line feed), n_lines and
    open (a quote still open where the file ends); overlong are file, place, n_lines of records not gathered.
    """
    tasks = lines.rdd.getNumPartitions()
    in_block = Window.partitionBy("file", "block").orderBy("place")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = (
        lines.select("file", "block", "place", "value", _parity(F.col("value"), quote).alias("parity"))
        .repartition(max(tasks, 1), "file", "block")
        .withColumn("before", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
        # where the latest record began, if the block starts outside (0) or inside (1) quotes
        .withColumn("from0", F.max(F.when(F.col("before") == 0, F.col("place"))).over(so_far))
        .withColumn("from1", F.max(F.when(F.col("before") == 1, F.col("place"))).over(so_far))
    )
    blocks = scanned.groupBy("file", "block").agg(
        (F.sum("parity") % 2).alias("turns"), F.max("from0").alias("last0"), F.max("from1").alias("last1")
    )
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("turns").over(in_file), F.lit(0)) % 2
    composed = blocks.withColumn("state", start).withColumn(
        "last", F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    )
    composed = composed.withColumn("carried", F.last("last", ignorenulls=True).over(in_file)).select("file", "block", "state", "carried")
    placed = scanned.join(F.broadcast(composed), ["file", "block"]).select(
        "file", "place", "value", "parity",
        F.coalesce(F.when(F.col("state") == 0, F.col("from0")).otherwise(F.col("from1")), F.col("carried")).alias("record_at"),
        ((F.col("before") + F.col("state") + F.col("parity")) % 2).alias("after"),
    )
    # A line that begins a record and leaves no quote open is a whole record; all other lines belong to longer ones.
    single = (F.col("record_at") == F.col("place")) & (F.col("after") == 0)
    alone = placed.where(single).select(
        "file", "place", F.col("value").alias("record"), F.lit(1).cast("long").alias("n_lines"), F.lit(False).alias("open")
    )
    longer = placed.where(~single)
    sizes = longer.groupBy("file", "record_at").agg(F.count("*").alias("n_lines"))
    overlong = sizes.where(F.col("n_lines") > most_lines)
    gathered = (
        longer.join(F.broadcast(overlong.select("file", "record_at")), ["file", "record_at"], "left_anti")
        .groupBy("file", "record_at")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n").alias("record"),
            F.count("*").alias("n_lines"),
            (F.sum("parity") % 2 == 1).alias("open"),
        )
        .withColumnRenamed("record_at", "place")
    )
    return alone.unionByName(gathered), overlong.withColumnRenamed("record_at", "place")


def field_count(record: Column, sep: str, quote: str = '"') -> Column:
    """Fields of a record: separators outside quotes, plus one."""
    q = "\\" + quote
    bare = F.regexp_replace(record, f"{q}(?:[^{q}]|{q}{q})*{q}?", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def header_names(header: str, sep: str, quote: str = '"') -> list[str]:
    """Column names of a header record, as the CSV reader names them: blanks become _c{i}, repeats get their place appended."""
    names, field, inside, k = [], [], False, 0
    while k < len(header):
        ch = header[k]
        if ch == quote and inside and header[k + 1 : k + 2] == quote:
            field.append(quote)
            k += 1
        elif ch == quote:
            inside = not inside
        elif ch == sep and not inside:
            names.append("".join(field))
            field = []
        else:
            field.append(ch)
        k += 1
    names.append("".join(field))
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    low = [n.lower() for n in names]
    return [f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def parsed(records: DataFrame, names: list[str], sep: str, quote: str = '"') -> DataFrame:
    """Records as their fields under names (all text), with n_fields; surplus fields are cut, missing ones null."""
    schema = ", ".join(f"`_f{i}` string" for i in range(len(names)))
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false"}
    values = F.from_csv(F.col("record"), schema, options).alias("v")
    return records.select("*", values, field_count(F.col("record"), sep, quote).alias("n_fields")).select(
        *(F.col(f"v._f{i}").alias(n) for i, n in enumerate(names)), *(c for c in records.columns if c != "record"), "n_fields"
    )
