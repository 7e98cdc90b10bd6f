"""Quoted line breaks in split files: the parallel quote-state scan against a reader that takes each file in one task."""

from __future__ import annotations

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfspan.sources import quoted, text


def write_csv(path, rows, sep=";"):
    buf = io.StringIO()
    csv.writer(buf, delimiter=sep, lineterminator="\n").writerows(rows)
    path.write_text(buf.getvalue(), encoding="utf-8")
    return str(path)


def random_rows(seed, n):
    rng = random.Random(seed)
    values = ["plain", "with;sep", 'multi\nline "q" x', "two\n\nbreaks", "", '"', "ž\nč", "end\n"]
    return [(str(i), rng.choice(values), "z" * rng.randint(0, 40)) for i in range(n)]


@pytest.fixture
def split_small(spark):
    def set_for(path, splits):
        spark.conf.set("spark.sql.files.maxPartitionBytes", max(os.path.getsize(path) // splits, 64))

    yield set_for
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def as_set(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda t: [(v is None, str(v)) for v in t])


def test_sixteen_splits_equal_one_task_reader(spark, tmp_path, split_small):
    path = write_csv(tmp_path / "q.csv", [("a", "b", "c"), *random_rows(1, 4000)])
    split_small(path, 16)
    assert spark.read.text(path).rdd.getNumPartitions() >= 16
    got = text.read_csv(spark, path, ";")
    one = spark.read.options(header=True, sep=";", quote='"', escape='"', multiLine=True).csv(path)
    assert one.rdd.getNumPartitions() == 1
    assert as_set(got, "a", "b", "c") == as_set(one, "a", "b", "c")
    # every record keeps the place of its first line, in file order
    places = [int(r.a) for r in got.orderBy("src_row").select("a").collect()]
    assert places == list(range(4000))


def test_several_files_and_blocks_in_one_task(spark, tmp_path, split_small):
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(3):
        write_csv(folder / f"p{k}.csv", [("a", "b", "c"), *random_rows(10 + k, 300)])
    split_small(str(folder / "p0.csv"), 5)
    got = text.read_csv(spark, str(folder), ";")
    one = spark.read.options(header=True, sep=";", quote='"', escape='"', multiLine=True).csv(str(folder))
    assert as_set(got, "a", "b", "c") == as_set(one, "a", "b", "c")


def test_records_of_lines_in_any_order(spark):
    """Lines not dealt by block are arranged first; the blocks may be of any size."""
    rows = random_rows(5, 500)
    body = "\n".join(";".join('"' + v.replace('"', '""') + '"' for v in r) for r in rows)
    lines = [("f", k // 37, k, v) for k, v in enumerate(body.split("\n"))]
    random.Random(2).shuffle(lines)
    df = spark.createDataFrame(lines, "file string, block long, place long, value string").repartition(7)
    records, overlong = quoted.quoted_records(df)
    got = quoted.parsed(records, ["a", "b", "c"], ";")
    assert overlong.count() == 0
    empty_is_null = [tuple(v or None for v in r) for r in rows]  # as the CSV parser reads "" by default
    assert as_set(got, "a", "b", "c") == sorted(empty_is_null, key=lambda t: [(v is None, str(v)) for v in t])
    assert sorted(r.n_lines for r in got.collect()) == sorted(1 + sum(v.count("\n") for v in r) for r in rows)


def test_rejects_of_surplus_missing_and_open_records(spark, tmp_path, split_small):
    body = 'a;b;c\n1;x;y\n2;x\n3;x;y;z\n4;"x\ny";z\n5;"open\nto the end\n6;a;b\n'
    path = tmp_path / "bad.csv"
    path.write_text(body, encoding="utf-8")
    split_small(str(path), 4)
    got = as_set(text.csv_rejects(spark, str(path), ";"), "src_row", "n_fields", "expected", "reason")
    data = text.read_csv(spark, str(path), ";")
    kept = as_set(data, "a", "b", "c")
    assert [r[1:] for r in got] == [(2, 3, "missing fields"), (4, 3, "surplus fields"), (2, 3, "open quote")]
    assert ("4", "x\ny", "z") in kept and ("2", "x", None) in kept and ("3", "x", "y") in kept


def test_an_unclosed_quote_is_not_gathered_beyond_the_bound(spark):
    lines = [("f", 0, 0, "a,b"), ("f", 0, 1, '1,"never closed')] + [("f", k // 50, k, f"line {k}") for k in range(2, 400)]
    df = spark.createDataFrame(lines, "file string, block long, place long, value string")
    records, overlong = quoted.quoted_records(df, most_lines=100)
    assert as_set(records, "place", "n_lines") == [(0, 1)]
    assert as_set(overlong, "place", "n_lines") == [(1, 399)]


def test_empty_file_and_header_only(spark, tmp_path):
    empty = tmp_path / "e.csv"
    empty.write_text("", encoding="utf-8")
    assert text.csv_rejects(spark, str(empty), ";").count() == 0
    head = tmp_path / "h.csv"
    head.write_text("\n\na;b\n", encoding="utf-8")
    df = text.read_csv(spark, str(head), ";")
    assert df.columns[:2] == ["a", "b"] and df.count() == 0


def test_header_names_as_the_csv_reader_gives_them():
    assert quoted.header_names('a;"b;c";;a;"x""y"', ";") == ["a0", "b;c", "_c2", "a3", 'x"y']


def test_field_count_skips_quoted_separators(spark):
    df = spark.createDataFrame([('a;"b;c";d',), ('"x""y;";;',), ("",), ('"open;',)], "record string")
    got = [r[0] for r in df.select(quoted.field_count(F.col("record"), ";")).collect()]
    assert got == [3, 3, 1, 1]


def test_rejected_fields_are_counted_in_one_row(spark, tmp_path):
    path = tmp_path / "kapacita.csv"
    path.write_text('a;b;c\n1;x;y\n2;x\n3;x;y;z\n4;"x\ny";z\n5;"open\nto the end\n', encoding="utf-8")
    got = text.rejected_fields(text.capacity_rejects(spark, str(path))).collect()
    assert [tuple(r) for r in got] == [(3, 1, 1, 1, 0)]
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "p1.csv").write_text("a;b\n1;2;3\n", encoding="utf-8")
    (folder / "p2.csv").write_text("a;b;c\n1\n", encoding="utf-8")
    got = text.rejected_fields(text.capacity_rejects(spark, str(folder))).collect()
    assert [tuple(r) for r in got] == [(2, 1, 1, 0, 0)]
