"""Line dedup by how often a site repeats a line.

Method. Pages are grouped by host. A line's ratio is the number of the host's pages that hold it divided by the host's pages; lines
above `ratio` that stand on at least `least_pages` pages are furniture of that site and are dropped from its pages.

A page that consists of such lines only is not furniture around content but a copy of another page: it stays whole, for a later
document dedup, unless keep_whole is off. Lines are compared without surrounding blanks; blank lines are neither counted nor
dropped. A line counts once per page. Hosts compare null-safe (null is a host of its own). Null texts stay null and count as pages.
Repeated rows are pages of their own. Extra columns are carried along.

At scale: lines travel as 128-bit hashes, and partial sums shrink a line that stands everywhere before it is shuffled. A host's
list of furniture is short by arithmetic: at most (mean lines per page) / ratio entries, so it can travel as one row per host. The
list of all hosts is broadcast if its measured size allows, so that texts need not be shuffled; else it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import BLANKS, checkpointed, let

RATIO = 0.1
LEAST_PAGES = 5
ENTRY_BYTES = 48
BROADCAST_BYTES = 64 << 20


def _key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def furniture(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per host that has such lines: furniture_host, furniture (array of line keys)."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), _filled), _key))
    held = (
        pages.select(F.col(host).alias("host"), F.explode(keys).alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_pages)
    )
    totals = pages.groupBy(F.col(host).alias("all_host")).agg(F.count("*").alias("pages"))
    often = held.join(totals, F.col("host").eqNullSafe(F.col("all_host"))).where(F.col("n") > F.col("pages") * F.lit(ratio))
    return often.groupBy(F.col("host").alias("furniture_host")).agg(F.collect_list("key").alias("furniture"))


def drop_furniture(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    keep_whole: bool = True,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """All columns of pages with the text cleaned; counts names two more columns: lines that are not blank, and those dropped."""
    found = checkpointed(furniture(pages, host, text, ratio, least_pages))
    entries = found.agg(F.sum(F.size("furniture") + 4)).first()[0] or 0
    if entries * ENTRY_BYTES <= BROADCAST_BYTES:  # else Spark joins by host, and splits a large one
        found = F.broadcast(found)
    packed = pages.select(F.struct("*").alias("_page")).join(
        found.withColumnsRenamed({"furniture_host": "_furniture_host", "furniture": "_furniture"}),
        F.col(f"_page.`{host}`").eqNullSafe(F.col("_furniture_host")),
        "left",
    )
    page_text = F.col(f"_page.`{text}`")

    def cleaned(lines: Column) -> Column:
        def sorted_out(bad: Column) -> Column:
            n_lines = F.size(F.filter(lines, _filled))
            n_bad = F.size(F.filter(bad, lambda b: b))
            whole = (n_bad == n_lines) if keep_whole else F.lit(False)
            kept = F.array_join(F.filter(lines, lambda line, k: ~F.get(bad, k)), "\n")
            return F.struct(
                F.when(whole | (n_bad == 0), page_text).otherwise(kept).alias("text"),
                n_lines.cast("long").alias("n_lines"),
                F.when(whole, 0).otherwise(n_bad).cast("long").alias("n_dropped"),
            )

        bad = F.transform(lines, lambda line: _filled(line) & F.array_contains(F.col("_furniture"), _key(line)))
        return let(F.when(F.col("_furniture").isNull(), F.transform(lines, lambda _: F.lit(False))).otherwise(bad), sorted_out)

    nothing = F.struct(page_text.alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    done = packed.select("_page", F.when(page_text.isNull(), nothing).otherwise(let(_lines(page_text), cleaned)).alias("_clean"))
    columns = [
        (F.col("_clean.text") if name == text else F.col(f"_page.`{name}`")).alias(name) for name in pages.columns
    ]
    if counts:
        columns += [F.col("_clean.n_lines").alias(counts[0]), F.col("_clean.n_dropped").alias(counts[1])]
    return done.select(*columns)
