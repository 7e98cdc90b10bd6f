"""A third of all rows under one key: results stay right and the hot key is split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfspan.operators import flags, keys, ordered
from shelfspan.plans import facts, metrics

ROWS = 60_000


@pytest.fixture
def small_partitions(spark):
    """Thresholds of the adaptive skew join, scaled down to test data."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "64k",
    }
    before = {name: spark.conf.get(name, None) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def skewed(spark):
    """Rows of which every third has the same key, in many map tasks."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), (n % 5000).cast("string")))
    return spark.range(0, ROWS, 1, 24).select(
        F.lit(1).cast("bigint").alias("branch_id"),
        key.alias("code_norm"),
        F.when(n % 2 == 0, F.lit("x")).alias("category"),
        n.alias("n"),
        F.sha2(n.cast("string"), 256).alias("load"),
    )


def run(df):
    """Number of rows, and the plan as it was run in the end."""
    out = df.select("*")
    count = len(out.collect())
    return count, out._jdf.queryExecution().executedPlan().toString()


def test_append_splits_a_hot_key(spark, small_partitions):
    extra = skewed(spark)
    base = extra.where("code_norm like 'K1%'").limit(500)
    base = spark.createDataFrame(base.collect(), base.schema)
    out = keys.append_new_keys(base, extra, facts.CELL)
    known = {(r.branch_id, r.code_norm, r.category) for r in base.collect()}
    every = [(r.branch_id, r.code_norm, r.category) for r in extra.collect()]
    count, plan = run(out)
    assert count == base.count() + sum(k not in known for k in every)
    assert "skewed" in plan and "skew=true" in plan.lower()


def test_code_map_splits_a_hot_key(spark, small_partitions):
    df = skewed(spark).withColumn("code", F.col("code_norm"))
    code_map = keys.conform_code_map(
        spark.createDataFrame(
            [(1, "hot", "DEPOT", "f", 0)] + [(1, f"K{i}", f"L{i}", "f", i) for i in range(2000)],
            "branch_id bigint, source_code string, target_code string, src_file string, src_row bigint",
        )
    )
    out = keys.apply_code_map(df, code_map)
    count, plan = run(out)
    assert count == ROWS and "skewed" in plan
    assert out.where("code_norm = 'DEPOT'").count() == ROWS // 3


def test_flags_split_a_hot_code(spark, small_partitions):
    branch = F.when(F.col("n") % 7 == 0, 2).otherwise(1).cast("bigint")
    name = F.when(F.col("n") % 7 == 0, "Two").otherwise("One")
    places = skewed(spark).select(
        branch.alias("branch_id"), "code_norm", "load", F.col("n").alias("location_id"),
        name.alias("branch_name"),
    )
    realloc = spark.createDataFrame(
        [("HOT", None, ""), ("K1", 1, ""), ("K2", 2, " one")],
        "code_norm string, branch_id bigint, branch_name string",
    )
    out = flags.flag_realloc(places, realloc)
    count, plan = run(out)
    final = plan.split("Initial Plan")[0]
    joins = [line for line in final.splitlines() if "SortMergeJoin" in line]
    # By number, by name and by code: each join splits the hot code by itself.
    assert count == ROWS and len(joins) == 3
    assert all("skew=true" in line.lower() for line in joins)
    hits = places.where(
        "code_norm = 'HOT' or code_norm = 'K1' and branch_id = 1"
        " or code_norm = 'K2' and (branch_id = 2 or branch_name = 'One')"
    ).count()
    assert out.where("is_realloc").count() == hits


def test_sums_and_picks_shrink_a_hot_key_before_the_shuffle(spark, small_partitions):
    df = skewed(spark)
    for out in (
        df.groupBy(*facts.CELL).agg(F.sum("n")),
        keys.dedupe(df, ["code_norm"], ["n"]),
        keys.key_presence(df, df, ["code_norm"]),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan.split("Exchange", 1)[1]


def test_fill_spreads_a_hot_group(spark, small_partitions):
    df = skewed(spark).select(
        "code_norm", "n", F.when(F.col("n") % 1000 == 999, F.col("n")).alias("v")
    )
    out = ordered.fill_within_group(df, ["code_norm"], "v", ["n"], block_rows=1000)
    got = out.where("code_norm = 'HOT'").select("n", "v").collect()
    assert len(got) == ROWS // 3
    marks = [n for n in range(0, ROWS, 3) if n % 1000 == 999]
    for r in got:
        before = [m for m in marks[max(0, r.n // 3000 - 2): r.n // 3000 + 2] if m <= r.n]
        assert r.v == (before[-1] if before else marks[0])
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [w for w in plan.splitlines() if " Window " in w]
    # Two run over rows, inside blocks; the others over one line per block.
    assert len(windows) == 4 and sum("windowspecdefinition(_at#" in w for w in windows) == 2
    # Rows are shuffled once, the lines per block three times.
    assert plan.count("Exchange hashpartitioning(") == 4


def test_metrics_split_a_hot_branch(spark, small_partitions):
    n = F.col("id")
    # A third of the locations in one branch, a sixth in none; the first two are listed twice.
    branch = F.when(n % 3 == 0, 1).when(n % 6 == 1, F.lit(None)).otherwise(n % 5000).cast("bigint")
    once = spark.range(0, ROWS, 1, 24).select(
        n.alias("location_id"), F.sha2(n.cast("string"), 256).alias("code"), F.lit("b").alias("branch_name"),
        branch.alias("branch_id"), F.lit(False).alias("is_realloc"), F.lit(1).cast("bigint").alias("stock_total"),
    )
    cells = once.select(
        "location_id", F.lit(True).alias("has_physical"), F.lit(2.0).alias("capacity_physical"),
        F.lit(None).cast("double").alias("capacity_realloc"),
    )
    branches = spark.range(5000).select(n.alias("branch_id"), F.concat(F.lit("A"), n % 5).alias("area"))
    out = metrics.metrics_location(once.unionByName(once.where("location_id < 2")), branches, cells)
    count, plan = run(out)
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "SortMergeJoin" in line]
    assert count == ROWS and any("skew=true" in line.lower() and "branch_id" in line for line in joins)
    total = out.agg(F.sum("capacity_total"), F.count_if(F.col("area").isNull())).first()
    assert tuple(total) == (2.0 * (ROWS + 2), ROWS // 6)
