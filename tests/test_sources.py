from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from shelfspan.config import SourceNames
from shelfspan.operators.conform import conform_capacity
from shelfspan.sources import listing, parquet, text


def write(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode(encoding))
    return str(path)


# --- delimited text -----------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1250", "latin-1"])
def test_capacity_csv_in_every_encoding(spark, tmp_path, rows, encoding):
    # A header and a value with letters the encoding has beyond ASCII.
    header, name = ("číslo knihovny", "Žižkov") if encoding != "latin-1" else ("cislo knihovny", "Zürich\x81")
    body = f"{header};Lokace;KAPACITA_OCH;Kapacita;Stav;Oblast\n1.0; a1 ;;10,5;x;{name}\n2;B;beletrie;7;3; \n"
    path = write(tmp_path / "kapacita.csv", body, encoding)
    expected = {"utf-8-sig": "utf-8"}.get(encoding, encoding)
    assert text.detect_encoding(spark, path) == expected
    df = text.read_capacity_csv(spark, path)
    assert {"branch_id", "code", "category", "capacity_physical", "stock_on_shelf", "area"} <= set(df.columns)
    assert rows(df, "branch_id", "code", "area")[0] == ("1.0", " a1 ", name)


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    lines = "\n".join(f"{i};v{i}" for i in range(5000))
    path = write(tmp_path / "many.csv", "a;b\n" + lines + "\n")
    size = os.path.getsize(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 7)
    try:
        df = text.read_csv(spark, path, ";")
        assert df.rdd.getNumPartitions() > 3
        got = [int(r.a) for r in df.orderBy("src_file", "src_row").select("a").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(5000))


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter_is_sniffed(spark, tmp_path, sep):
    path = write(tmp_path / "map.csv", sep.join(["a", "b", "c"]) + "\n" + sep.join("123") + "\n")
    assert text.read_csv_auto(spark, path).columns[:3] == ["a", "b", "c"]


def test_area_map(spark, tmp_path, rows):
    path = write(
        tmp_path / "oblast_map.csv",
        "pobocka_cislo,oblast,pobocka_nazev\n1, Jih ,A\n35,Jihozápad,\nx,Sklad,Depo\n",
    )
    assert rows(text.read_area_map(spark, path), "branch_id", "branch_name", "area") == [
        (1, "A", "Jih"), (35, None, "Jihozápad"), (None, "Depo", "Sklad"),
    ]
    assert text.read_area_map(spark, None).count() == 0
    other = write(tmp_path / "other.csv", "x,y\n1,2\n")
    assert text.read_area_map(spark, other).isEmpty()


def test_code_map(spark, tmp_path, rows):
    path = write(
        tmp_path / "code.csv",
        "pobocka_cislo;lokace_short_zdroj;lokace_short_cil\n92;92.1;jen-pvp\n92;92.2;\n;;\n92; 92.1 ;JEN-PV\n",
    )
    code_map = text.read_code_map(spark, path)
    assert rows(code_map, "branch_id", "source_norm", "target_norm") == [(92, "92.1", "JEN-PV")]
    bad = write(tmp_path / "bad.csv", "pobocka_cislo,zdroj\n1,2\n")
    assert text.read_code_map(spark, bad).isEmpty()
    assert text.read_code_map(spark, None).isEmpty()


def test_parts_keep_their_name_and_lack_columns(spark, tmp_path, rows):
    folder = tmp_path / "kapacita"
    write(folder / "Chodov jih.csv", "KAPACITA_CISLOKNIH;KAPACITA_LOKACE_SHORT;KAPACITA_PLAN\n89;a;1\n;b;2\n")
    write(folder / "Žižkov+100%.csv", "Lokace;Kapacita;Region\nc;3;Jih\n", "cp1250")
    write(folder / "Opatov.csv", "KAPACITA_CISLOKNIH;KAPACITA_LOKACE_SHORT;KAPACITA_PLAN\n5;d;4\n")
    spark.createDataFrame([("e", 5.0)], "lokace string, mista double").coalesce(1).write.parquet(
        str(tmp_path / "one")
    )
    part = next((tmp_path / "one").glob("part-*.parquet"))
    part.rename(folder / "Depo.parquet")
    df = text.read_parts(spark, str(folder))
    assert rows(df, "branch_name", "branch_id", "code", F.col("capacity_physical").cast("double"), "area") == [
        ("Chodov jih", "89", "a", 1.0, None),
        ("Chodov jih", None, "b", 2.0, None),
        ("Depo", None, "e", 5.0, None),
        ("Opatov", "5", "d", 4.0, None),
        ("Žižkov+100%", None, "c", 3.0, "Jih"),
    ]


def test_parts_differ_in_spelling_and_types(spark, tmp_path, rows):
    folder = tmp_path / "parts"
    parts = {
        "north": ([("89", "a", 1.5), ("x", "b", 2.0)], "kapacita_cisloknih string, kapacita_lokace_short string, kapacita_plan double"),
        "south": ([(7, "c", "3"), (8, "d", "none")], "cislo_knihovny long, lokace_short string, kapacita_fyzicka string"),
        "west": ([(9.0, "e", 4)], "cislo_knihovny double, lokace string, kapacita int"),
    }
    write(folder / "east.csv", "Lokace;Kapacita\nf;bad\ng;5\n")
    for name, (data, schema) in parts.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.parquet")).rename(folder / f"{name}.parquet")
    df = conform_capacity(text.read_parts(spark, str(folder)))
    assert rows(df, "branch_name", "branch_id", "code", "capacity_physical") == sorted(
        [
            ("east", None, "f", None), ("east", None, "g", 5.0), ("north", 89, "a", 1.5), ("north", None, "b", 2.0),
            ("south", 7, "c", 3.0), ("south", 8, "d", None), ("west", 9, "e", 4.0),
        ],
        key=lambda t: [(v is None, str(v)) for v in t],
    )


def test_no_parts_is_an_error(spark, tmp_path):
    write(tmp_path / "p" / "readme.md", "x")
    with pytest.raises(FileNotFoundError):
        text.read_parts(spark, str(tmp_path / "p"))


def test_missing_words_and_quotes(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a;b;c\n"x;""y""";NA;"n/a"\n')
    row = text.read_csv(spark, path, ";").first()
    assert (row.a, row.b, row.c) == ('x;"y"', None, None)


# --- stock export -------------------------------------------------------------------------


EXPORT = """eSQL prompt
select 1, 2, 3, 4, 5, 6
================
  12 , 1, Chodov , jen-a , 1 234 , 2026-01-01 , more
13,<null>,<NULL>,b,n/a,2026-01-01
14,null,null,c,-5,2026-01-02
15,,,d,,2026-01-02
16,x1,Name,e,7.5,2026-01-02
17,1,too short,e,7
CONSTANT 1,2
18,1,constant,e,7,2026-01-02
99999999999999999999,1,n,e,7,2026-01-02
Records: 5,
"""


def test_stock_export(spark, tmp_path, rows):
    path = write(tmp_path / "x.csv", EXPORT)
    got = rows(
        text.parse_stock_export(spark, path),
        "location_id", "branch_id", "branch_name", "code", "stock_total", "as_of",
    )
    assert got == [
        (12, 1, "Chodov", "jen-a", 1234, "2026-01-01"),
        (13, None, "", "b", 0, "2026-01-01"),
        (14, None, "", "c", -5, "2026-01-02"),
        (15, None, "", "d", 0, "2026-01-02"),
        (16, None, "Name", "e", 0, "2026-01-02"),
    ]
    rejected = text.rejected_lines(text.read_export_lines(spark, path))
    assert [r.value[:2] for r in rejected.collect()] == ["17", "99"]


def test_export_bytes_that_are_no_utf8_are_replaced(spark, tmp_path):
    path = write(tmp_path / "x.csv", "1,2,Žižkov,a,3,2026\n", "cp1250")
    assert text.parse_stock_export(spark, path).first().branch_name == "�i�kov"


def test_export_without_records_is_an_error(spark, tmp_path):
    path = write(tmp_path / "x.csv", "select 1\n")
    with pytest.raises(ValueError, match="no stock records"):
        text.parse_stock_export(spark, path)


# --- Parquet ------------------------------------------------------------------------------


PHYSICAL = (
    "`Pobočka č.` string, `Pobočka` string, `Oblast` string, "
    "`Lokace - systémové označení (Koniáš)` string, `Typ` string, "
    "`Kapacita svazky` string, `Kapacita - současný stav` double"
)


def test_physical_with_and_without_marking(spark, tmp_path):
    path = str(tmp_path / "k.parquet")
    data = [("92.0", " A ", " Jih ", " a1\t", " ", "x", float("nan"))]
    spark.createDataFrame(data, PHYSICAL).write.parquet(path)
    row = parquet.read_physical(spark, path).first()
    assert (row.branch_id, row.branch_name, row.area, row.code, row.code_norm) == (92, "A", "Jih", "a1", "A1")
    assert (row.category, row.type, row.marking) == (None, None, None)
    assert (row.capacity_physical, row.stock_on_shelf) == (None, None)

    marked = str(tmp_path / "m.parquet")
    spark.createDataFrame([(*data[0], " m ")], PHYSICAL + ", `Oznaceni` string").write.parquet(marked)
    assert parquet.read_physical(spark, marked).first().marking == "m"


def test_physical_needs_its_columns_but_warehouse_does_not(spark, tmp_path):
    path = str(tmp_path / "k.parquet")
    spark.createDataFrame([(1, "t")], "`Pobočka č.` int, `Typ` string").write.parquet(path)
    with pytest.raises(ValueError, match="lacks columns"):
        parquet.read_physical(spark, path)
    row = parquet.read_warehouse(spark, path).first()
    assert (row.branch_id, row.category, row.type, row.code_norm, row.area) == (1, "t", "t", "", None)


def test_stock(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    spark.createDataFrame(
        [("7", 1, " N ", "a", None, "2026-01-01"), ("8", 1, None, None, 12.9, None)],
        "LOKACE_KEY string, KNODDEL_cisloknih int, KNODDEL_nazev string, LOKACE_SHORT string, "
        "`POČET (kj)` double, Datum string",
    ).coalesce(1).write.parquet(path)
    a, b = parquet.read_stock(spark, path).orderBy("location_id").collect()
    assert (a.location_id, a.branch_name, a.stock_total, a.as_of) == (7, "N", 0, "2026-01-01")
    assert (b.location_id, b.code_norm, b.stock_total, b.as_of) == (8, "", 12, None)
    assert (a.src_row, b.src_row) == (0, 1)


def test_realloc_headers_in_any_case(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    spark.createDataFrame(
        [(1.0, "a", "", "12", "d")],
        "Kapacita_CisloKnih double, KAPACITA_LOKACE_SHORT string, KAPACITA_OCH string, "
        "KAPACITA_PLAN string, KAPACITA_DESKRIPTOR string",
    ).write.parquet(path)
    row = parquet.read_realloc(spark, path).first()
    assert (row.branch_id, row.code_norm, row.category, row.descriptor) == (1, "A", None, "d")
    assert (row.capacity_realloc, row.branch_name) == (12.0, "")


# --- listing ------------------------------------------------------------------------------


def folder_of(spark, path):
    spark.range(1).write.parquet(str(path))


def test_parquet_bundle_wins_and_last_name_counts(spark, tmp_path):
    for name in (
        "Pobočky.parquet",
        "Capacity 1.parquet",
        "Capacity 2.parquet",
        "Skutečný stav - realokace.parquet",
        "Skutecny stav.parquet",
        "Sklady + 100%.parquet",
        "Stavy poboček.parquet",
        "other.parquet",
    ):
        folder_of(spark, tmp_path / name)
    write(tmp_path / "data_raw" / "oblast_map.csv", "pobocka_cislo,oblast\n1,a\n")
    write(tmp_path / "data_raw" / "kapacita.csv", "a\n")
    found = listing.resolve_sources(spark, str(tmp_path))
    assert found.mode == "parquet"
    assert {k: os.path.basename(v) for k, v in found.paths.items()} == {
        "branches": "Pobočky.parquet",
        "physical": "Capacity 2.parquet",
        "realloc": "Skutečný stav - realokace.parquet",
        "stock": "Skutecny stav.parquet",
        "warehouse": "Sklady + 100%.parquet",
        "area_map": "oblast_map.csv",
    }
    assert spark.read.parquet(found.paths["warehouse"]).count() == 1


def test_incomplete_bundle_falls_back_to_text(spark, tmp_path):
    folder_of(spark, tmp_path / "Pobočky.parquet")
    raw = tmp_path / "data_raw"
    write(raw / "lokace-neprazdne.csv", "1,1,n,c,1,d\n")
    write(raw / "kapacita.csv", "a;b\n")
    found = listing.resolve_sources(spark, str(tmp_path))
    assert (found.mode, os.path.basename(found.paths["stock"])) == ("csv", "lokace-neprazdne.csv")
    assert found.paths["capacity"].endswith("kapacita.csv")
    # The full export goes before the spare one, folders of parts before the file.
    write(raw / "lokace-vsechny.csv", "1,1,n,c,1,d\n")
    write(raw / "kapacita" / "Chodov.csv", "a;b\n")
    found = listing.resolve_sources(spark, str(tmp_path))
    assert os.path.basename(found.paths["stock"]) == "lokace-vsechny.csv"
    assert os.path.basename(found.paths["capacity"]) == "kapacita"
    write(raw / "capacity_parts" / "Chodov.csv", "a;b\n")
    found = listing.resolve_sources(spark, str(tmp_path))
    assert os.path.basename(found.paths["capacity"]) == "capacity_parts"
    other = write(tmp_path / "other.csv", "a;b\n")
    assert listing.resolve_sources(spark, str(tmp_path), capacity=other).paths["capacity"] == other
    assert listing.resolve_sources(spark, str(tmp_path), capacity="/absent.csv") == found


def test_names_are_a_setting(spark, tmp_path):
    for name in ("Sites.parquet", "Room.parquet", "On hand.parquet"):
        folder_of(spark, tmp_path / name)
    names = SourceNames.from_json('{"physical_word": "room", "branches_prefix": "sites", "stock_words": ["on hand"]}')
    found = listing.resolve_sources(spark, str(tmp_path), names=names)
    assert {k: os.path.basename(v) for k, v in found.paths.items()} == {
        "branches": "Sites.parquet", "physical": "Room.parquet", "stock": "On hand.parquet",
    }
    with pytest.raises(TypeError):
        SourceNames.from_json('{"unknown": "x"}')


def test_nothing_to_read_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="stock and capacity"):
        listing.resolve_sources(spark, str(tmp_path / "absent"))


def test_manifest_notices_changes(spark, tmp_path):
    path = write(tmp_path / "a.csv", "1")
    write(tmp_path / "b" / "c.csv", "2")
    paths = [path, str(tmp_path / "b")]
    before = listing.input_manifest(spark, paths)
    kept = spark.createDataFrame(before.collect(), before.schema)
    assert kept.first().files == 2 and listing.unchanged(listing.input_manifest(spark, paths), kept)
    time.sleep(0.05)
    write(tmp_path / "a.csv", "3")
    assert not listing.unchanged(listing.input_manifest(spark, paths), kept)
