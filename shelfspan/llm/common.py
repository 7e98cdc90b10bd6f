"""What several operators share: tables, the shared folder, and expressions over texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's shared checkpoint folder; a folder of our own only where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body's own lambdas use it for every element."""
    return F.transform(F.array(value), body)[0]


def slices(sizes: Sequence[int | None], most: int) -> Iterator[tuple[int, int]]:
    """Start and end of stretches of a list whose sizes add up to at most `most`; a larger one stands alone."""
    at = size = 0
    for k, n in enumerate(sizes):
        if k > at and size + (n or 0) > most:
            yield at, k
            at, size = k, 0
        size += n or 0
    if at < len(sizes):
        yield at, len(sizes)


def no_nulls(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def blank_words(text: Column) -> Column:
    """Words between runs of space, tab, line feed, vertical tab, form feed and carriage return."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def matches(text: Column, pattern: Column | str, groups: tuple[int, ...] = (0,)) -> Column:
    """Leftmost matches, one after the other, of a pattern that never matches nothing.

    Array of struct(start, end, g0, g1, ...): code points, end exclusive, and the asked groups. Matches and the parts between them
    alternate, so their lengths give the places. Most texts have no match and are passed over once.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    names = [f"g{k}" for k in range(len(groups))]
    fields = ", ".join(["start: int", "end: int", *(f"{n}: string" for n in names)])
    none = F.array().cast(f"array<struct<{fields}>>")

    def placed(whole: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            start = state["at"] + F.length(F.get(state["parts"], k))
            end = start + F.length(F.get(state["found"], k))
            row = F.struct(start.alias("start"), end.alias("end"), *(F.get(state[n], k).alias(n) for n in names))
            kept = [state[n].alias(n) for n in ("parts", "found", *names)]
            return F.struct(end.alias("at"), *kept, F.concat(state["out"], F.array(row)).alias("out"))

        first = F.struct(
            F.lit(0).alias("at"),
            F.split(text, pattern, -1).alias("parts"),
            whole.alias("found"),
            *((whole if g == 0 else F.regexp_extract_all(text, pattern, F.lit(g))).alias(n) for g, n in zip(groups, names)),
            none.alias("out"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), first, step, lambda state: state["out"])

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda whole: F.when(F.size(whole) == 0, none).otherwise(placed(whole)))
