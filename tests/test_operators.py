from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfspan import fixed_values as fv
from shelfspan.operators import areas, conform, flags, keys, ordered


# --- conformance ------------------------------------------------------------------------


def test_headers_are_normalised_and_aliased_in_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  KNODDEL CisloKnih".replace(" C", "_C"), "Plan", "Mista"])
    out = conform.canonicalize(conform.normalize_columns(df), fv.CAPACITY_ALIASES)
    assert out.columns == ["branch_id", "capacity_physical", "mista"]


def test_existing_target_is_kept(spark):
    df = spark.createDataFrame([(1, 2)], ["code", "lokace"])
    assert conform.canonicalize(df, fv.CAPACITY_ALIASES).columns == ["code", "lokace"]


def test_first_pass_prefers_its_own_order(spark):
    df = spark.createDataFrame([(1, 2)], ["knoddel_cisloknih", "kapacita_cisloknih"])
    out = conform.conform_part(df, "p")
    assert out.columns == ["knoddel_cisloknih", "branch_id", "branch_name"]


def test_equal_headers_are_refused(spark):
    with pytest.raises(ValueError, match="equal after normalisation"):
        conform.normalize_columns(spark.createDataFrame([(1, 2)], ["A b", "a_b"]))


def test_part_name_replaces_names_in_rows(spark):
    df = spark.createDataFrame([("x",)], ["Pobocka nazev"])
    assert conform.conform_part(df, "Chodov").collect()[0].asDict() == {"branch_name": "Chodov"}


def test_missing_columns_become_typed_nulls(spark):
    df = spark.createDataFrame([(" a1 ", " ")], ["code", "category"])
    out = conform.conform_capacity(df)
    row = out.first()
    assert dict(out.dtypes)["capacity_physical"] == "double"
    assert (row.code, row.code_norm, row.category, row.type, row.branch_id) == (
        "a1", "A1", None, None, None,
    )


def test_null_category_stays_null(spark):
    df = spark.createDataFrame([(None, None)], "category string, code string")
    row = conform.conform_capacity(df).first()
    assert row.category is None and row.code_norm == ""


def test_require(spark):
    df = spark.createDataFrame([(None, 1)], "a int, b int")
    with pytest.raises(ValueError, match="missing"):
        conform.require(df, "c")
    with pytest.raises(ValueError, match="empty"):
        conform.require(df, "a")
    assert conform.require(df, "b") is df


# --- keys -------------------------------------------------------------------------------


KEYED = "k bigint, c string, v string"


def test_append_new_keys_matches_null_with_null(spark, rows):
    base = spark.createDataFrame([(1, None, "b1"), (None, "x", "b2"), (1, "y", "b3")], KEYED)
    extra = spark.createDataFrame(
        [(1, None, "e1"), (None, "x", "e2"), (None, None, "e3"), (2, "y", "e4"), (2, "y", "e5")],
        KEYED,
    )
    out = keys.append_new_keys(base, extra, ["k", "c"])
    assert [r[0] for r in rows(out, "v")] == ["b1", "b2", "b3", "e3", "e4", "e5"]


def test_key_presence_counts_both_sides(spark, rows):
    a = spark.createDataFrame([(1, "x", ""), (1, "x", ""), (None, None, "")], KEYED)
    b = spark.createDataFrame([(1, "x", ""), (3, "z", "")], KEYED)
    assert rows(keys.key_presence(a, b, ["k", "c"])) == [
        (1, "x", 2, 1), (3, "z", 0, 1), (None, None, 1, 0),
    ]


def test_dedupe_first_and_last_by_order(spark, rows):
    df = spark.createDataFrame(
        [("a", 2, "mid"), ("a", 1, "low"), ("a", 3, None), ("b", 9, "only"), (None, 1, "null")],
        "k string, n bigint, v string",
    )
    assert rows(keys.dedupe(df, ["k"], ["n"])) == [
        ("a", 1, "low"), ("b", 9, "only"), (None, 1, "null"),
    ]
    assert rows(keys.dedupe(df, ["k"], ["n"], "last")) == [
        ("a", 3, None), ("b", 9, "only"), (None, 1, "null"),
    ]


def test_duplicates(spark, rows):
    df = spark.createDataFrame(
        [(1, "x", "p"), (1, "x", "q"), (1, None, "r"), (1, None, "s"), (2, "x", "t")], KEYED
    )
    assert [r[0] for r in rows(keys.duplicates(df, ["k", "c"]), "v")] == ["p", "q", "r", "s"]
    assert keys.duplicate_rows(df, ["k", "c"]).first()[0] == 4
    assert keys.duplicate_rows(df.where("k = 2"), ["k", "c"]).first()[0] == 0


CODE_MAP = "branch_id bigint, source_code string, target_code string, src_file string, src_row bigint"


def test_code_map_is_unique_after_normalising(spark, rows):
    raw = spark.createDataFrame(
        [
            (92, "92.1", "jen-pvp", "f", 0),
            (92, "a ", "first", "f", 1),
            (92, " A", "second", "f", 2),
            (None, "b", "c", "f", 3),
            (92, "", "c", "f", 4),
        ],
        CODE_MAP,
    )
    code_map = keys.conform_code_map(raw)
    df = spark.createDataFrame(
        [(92, "92.1", "92.1"), (92, "a", "A"), (91, "a", "A"), (None, "a", "A")],
        "branch_id bigint, code string, code_norm string",
    )
    assert rows(keys.apply_code_map(df, code_map)) == [
        (91, "a", "A"), (92, "JEN-PVP", "JEN-PVP"), (92, "SECOND", "SECOND"), (None, "a", "A"),
    ]


def test_override_looks_at_the_name_as_it_came(spark, rows):
    df = spark.createDataFrame(
        [(1, " Jenštejn ", "x"), (2, "Jeneč", None), (3, None, "y")],
        "branch_id bigint, branch_name string, area string",
    )
    rules = [("jenštejn", 92, "Jeneč", "Sklad"), ("jeneč", 5, "other", "z")]
    assert rows(keys.override_branch(df, rules)) == [
        (3, None, "y"), (5, "other", "z"), (92, "Jeneč", "Sklad"),
    ]


def test_clean_warehouse(spark, rows):
    df = spark.createDataFrame(
        [("A", 1.0), ("", 1.0), ("B", 0.0), ("C", None), ("D", -1.0)],
        "code_norm string, capacity_physical double",
    )
    assert rows(keys.clean_warehouse(df), "code_norm") == [("A",), ("D",)]


def test_fill_branch_from_catalogue_takes_the_first_match(spark, rows):
    df = spark.createDataFrame(
        [(None, " CHODOV "), (7, "chodov"), (None, "nowhere"), (None, None)],
        "branch_id bigint, branch_name string",
    )
    stock = spark.createDataFrame(
        [(2, 20, "Chodov"), (1, 10, "chodov"), (0, None, "chodov")],
        "n bigint, branch_id bigint, branch_name string",
    )
    catalogue = keys.name_catalogue(stock, ["n"])
    assert rows(keys.fill_branch_from_catalogue(df, catalogue)) == [
        (10, " CHODOV "), (7, "chodov"), (None, "nowhere"), (None, None),
    ]


def test_fill_branch_name_only_where_blank(spark, rows):
    branches = spark.createDataFrame([(1, " One "), (2, None)], "branch_id bigint, branch_name string")
    df = spark.createDataFrame(
        [(1, ""), (1, "own"), (2, " "), (3, None), (None, "")], "branch_id bigint, branch_name string"
    )
    assert rows(keys.fill_branch_name(df, branches)) == [
        (1, "One"), (1, "own"), (2, ""), (3, ""), (None, ""),
    ]


# --- ordered fill -----------------------------------------------------------------------


def brute_fill(values):
    out, last = [], None
    for v in values:
        last = v if v is not None else last
        out.append(last)
    first = next((v for v in values if v is not None), None)
    return [first if v is None else v for v in out]


@pytest.mark.parametrize("block", [1, 3, 1 << 18])
def test_fill_within_group_equals_brute_force(spark, block):
    rng = random.Random(block)
    data = []
    for group, size in (("hot", 200), ("b", 7), ("empty", 5), (None, 9), ("one", 1)):
        share = 0.0 if group == "empty" else 0.15
        for i in range(size):
            value = rng.randrange(99) if rng.random() < share else None
            data.append((group, f"f{i * 3 // max(size, 1)}", rng.randrange(10**6) * 1000 + i, value))
    df = spark.createDataFrame(data, "g string, f string, n bigint, v int").repartition(5)
    got = ordered.fill_within_group(df, ["g"], "v", ["f", "n"], block_rows=block * 10**6)
    found = {(r.g, r.f, r.n): r.v for r in got.collect()}
    assert len(found) == len(data)
    for group in {d[0] for d in data}:
        part = sorted((d for d in data if d[0] == group), key=lambda d: (d[1], d[2]))
        for d, expected in zip(part, brute_fill([d[3] for d in part])):
            assert found[d[:3]] == expected


# --- areas ------------------------------------------------------------------------------


def test_mode_prefers_the_first_of_equals_and_skips_blanks(spark, rows):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a "), (1, " "), (1, None), (2, "z"), (2, "z"), (2, "y"), (3, None)],
        "branch_id bigint, area string",
    )
    votes = areas.area_votes(df, "branch_id")
    assert rows(areas.elect(votes, "branch_id")) == [(1, "a"), (2, "z")]
    assert rows(areas.conflicts(votes, "branch_id")) == [(1, 2, "a, b"), (2, 2, "y, z")]


def test_area_sources_count_in_order(spark, rows):
    branches = spark.createDataFrame(
        [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E")], "branch_id bigint, branch_name string"
    )
    by_number = spark.createDataFrame([(1, "num")], "branch_id bigint, area string")
    by_name = spark.createDataFrame([(" b ", "name"), ("a", "no")], "branch_name string, area string")
    area_map = spark.createDataFrame(
        [
            (3, None, "old", "f", 0),
            (3, None, " map ", "f", 1),
            (2, None, "no", "f", 2),
            (None, "d", "map by name", "f", 3),
            (None, "c", "no", "f", 4),
        ],
        "branch_id bigint, branch_name string, area string, src_file string, src_row bigint",
    )
    out = areas.assign_area(branches, by_number, by_name, area_map, "Neurčeno")
    assert rows(out, "branch_id", "area") == [
        (1, "num"), (2, "name"), (3, "map"), (4, "map by name"), (5, "Neurčeno"),
    ]


# --- flags and location map ---------------------------------------------------------------


PLACES = "location_id bigint, branch_id bigint, branch_name string, code_norm string"


def test_flag_by_number_by_code_alone_and_by_name(spark):
    places = spark.createDataFrame(
        [
            (1, 1, "One", "A"),  # by number
            (2, 2, "Two", "A"),  # same code, other branch: not
            (3, None, "Two", "W"),  # by code alone, even without a branch
            (4, 9, " CHODOV", "N"),  # by name, though the number differs
            (5, 9, None, "N"),  # no name to match
            (6, 1, "One", ""),  # a blank code is never named by number or code
            (7, 2, "Two", "W"),  # by code alone although a name is given
        ],
        PLACES,
    )
    realloc = spark.createDataFrame(
        [
            ("A", 1, ""), ("A", 1, ""), ("W", None, "One"), ("N", 8, "chodov "), ("", None, ""),
            ("", 1, ""),
        ],
        "code_norm string, branch_id bigint, branch_name string",
    )
    out = flags.flag_realloc(places, realloc)
    assert {r.location_id for r in out.where("is_realloc").collect()} == {1, 3, 4, 7}
    assert out.count() == 7 and out.where("is_realloc is null").count() == 0


def test_location_map_takes_the_smallest_id(spark, rows):
    places = spark.createDataFrame(
        [(5, 1, "x", "A"), (3, 1, "y", "A"), (1, None, "z", "A"), (7, 2, "w", "A")], PLACES
    )
    assert rows(flags.location_map(places)) == [(1, "A", 3), (2, "A", 7)]
    assert rows(flags.location_map(places, ["branch_name"])) == [(1, "A", 3, "y"), (2, "A", 7, "w")]


def test_join_null_safe_keeps_left_keys(spark, rows):
    a = spark.createDataFrame([(1, None, "l"), (None, "c", "m")], KEYED)
    b = spark.createDataFrame([(1, None, "r")], "k bigint, c string, w string")
    assert rows(keys.join_null_safe(a, b, ["k", "c"], "left"), "v", "w") == [("l", "r"), ("m", None)]
    assert rows(keys.semi_filter(a, b, "k"), "v") == [("l",)]
    assert keys.join_null_safe(a, b, ["k", "c"], "left_anti").select(F.col("v")).first()[0] == "m"
