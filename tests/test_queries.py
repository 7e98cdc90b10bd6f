"""Every named query against its SQL twin, and the shape of the plans."""

from __future__ import annotations

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shelfspan.drivertables.mapping import Tables
from shelfspan.drivertables.oracle import ORACLE
from shelfspan.drivertables.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
NAMES = sorted(QUERIES)  # those of the optional folder have tests of their own

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not at hand")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    picked = [tuple(r[i] for i in order) for r in rows]
    return sorted(picked, key=lambda t: [(v is None, str(v)) for v in t])


def test_every_query_has_its_twin():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, df.collect()) == normal(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry(spark).count() > 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_and_no_nested_loops(spark, name):
    # Whatever the table sizes: joins stay equi joins when nothing may be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"CartesianProduct|NestedLoop|Python|InPandas|Arrow", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries()["fact_realloc"](spark, FOLDER))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "o_totalprice" in line)
    assert "EqualTo(o_orderstatus,O)" in scan and "o_orderdate" not in scan


def test_metrics_read_each_capacity_source_once(spark):
    m = Tables(spark, FOLDER).model()
    text = plan(m.metrics_area)
    scans = [line for line in text.splitlines() if "FileScan" in line and "o_totalprice" in line]
    # Physical, planned and pending orders; sums are formed before any join.
    assert len(scans) == 3 and "lineitem" not in text


def test_key_counts_need_no_join(spark):
    for name in ("dq_source_overlap", "dq_duplicate_keys"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            text = plan(queries()[name](spark, FOLDER))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Window" not in text and "Anti" not in text and "Semi" not in text
