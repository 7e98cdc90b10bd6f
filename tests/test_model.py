"""Whole builds from folders of files, and the rules at the edges of the model."""

from __future__ import annotations

import dataclasses
import shutil

import pytest
from pyspark.sql import functions as F

from shelfspan import schema
from shelfspan.__main__ import run
from shelfspan.config import ModelConfig
from shelfspan.plans import facts, quality
from shelfspan.plans.model import Model, ModelInputs, build_model
from shelfspan.sources import sinks
from shelfspan.sources.listing import resolve_sources

CAPACITY_HEAD = (
    "`Pobočka č.` double, `Pobočka` string, `Oblast` string, "
    "`Lokace - systémové označení (Koniáš)` string, `Typ` string, `Označení` string, "
    "`Kapacita svazky` double, `Kapacita - současný stav` double"
)
STOCK_HEAD = (
    "LOKACE_KEY bigint, KNODDEL_cisloknih double, KNODDEL_nazev string, LOKACE_SHORT string, "
    "`POČET (kj)` double, Datum string"
)
REALLOC_HEAD = (
    "KAPACITA_CISLOKNIH double, KAPACITA_LOKACE_SHORT string, KAPACITA_OCH string, "
    "KAPACITA_PLAN double, KAPACITA_DESKRIPTOR string"
)


def save(spark, folder, name, data, head):
    spark.createDataFrame(data, head).coalesce(1).write.parquet(str(folder / name))


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    """A complete set of Parquet files with a warehouse file and both maps."""
    root = tmp_path_factory.mktemp("bundle")
    save(
        spark, root, "Pobočky.parquet",
        [(1.0, " Střed "), (2.0, "Jih"), (92.0, "Jeneč"), (3.0, "Nová"), (2.0, "Jih again"), (None, "x")],
        "`Pobočka č.` double, `Pobočka` string",
    )
    save(
        spark, root, "Capacity.parquet",
        [
            (1.0, "Střed", " Jih ", "a-1", "x", "m1", 100.0, 80.0),
            (1.0, "Střed", "Jih", "A-1 ", "x", "m2", 20.0, None),
            (1.0, "Střed", "Sever", "A-1", None, None, 5.0, 1.0),
            (1.0, "Střed", "Jih", "A-2", "x", None, None, None),
            (2.0, "Jih", None, "B-1", "x", None, 50.0, 40.0),
            (2.0, "Jih", None, "B-1", "y", None, 30.0, 20.0),
            (92.0, "Jeneč", "Sklad", "92.1", "x", None, 1000.0, 900.0),
            (2.0, "Jih", None, "ORPHAN", "x", None, 7.0, 7.0),
            (5.0, "Pryč", "Jinde", "E-1", "x", None, 10.0, 9.5),
        ],
        CAPACITY_HEAD,
    )
    save(
        spark, root, "Sklady.parquet",
        [
            (92.0, "Jeneč", "Sklad", "JEN-PVP", "x", None, 1.0, None),  # known after mapping
            (0.0, " JENŠTEJN", None, "92.1", "z", None, 300.0, None),  # renumbered, then mapped
            (None, "jenštejn", None, "JEN-NEW", None, None, 40.0, None),
            (1.0, "Střed", None, "", "x", None, 9.0, None),
            (1.0, "Střed", None, "A-9", "x", None, 0.0, None),
        ],
        CAPACITY_HEAD,
    )
    save(
        spark, root, "Skutečný stav.parquet",
        [
            (10, 1.0, "Střed", " a-1", 130.0, "2026-01-01"),
            (11, 1.0, "Střed", "A-2", 0.0, "2026-01-02"),
            (20, 2.0, "Jih", "B-1", 75.0, "2026-01-03"),
            (21, 2.0, "Jih", "B-1", 5.0, "2026-01-03"),  # same key, larger id
            (90, 92.0, "Jeneč", "JEN-PVP", 900.0, "2026-01-04"),
            (91, 92.0, "Jeneč", "JEN-NEW", None, "2026-01-04"),
            (30, 3.0, "Nová", "C-1", 10.0, "2026-01-05"),
            (50, 5.0, "Pryč", "E-1", 9.5, "2026-01-05"),  # branch not in the catalogue
            (60, None, None, "F-1", 3.0, "2026-01-05"),
        ],
        STOCK_HEAD,
    )
    save(
        spark, root, "Skutečný stav - realokace.parquet",
        [
            (2.0, "b-1", "x", 60.0, "d1"),
            (2.0, "B-1", "w", 11.0, "d2"),
            (92.0, "JEN-PVP", "x", 1.0, "d1"),
            (92.0, "JEN-PVP", "q", 5.0, None),
            (1.0, "A-1", "none", None, None),  # flags the location, plan without numbers
            (7.0, "NOWHERE", "x", 1.0, None),
        ],
        REALLOC_HEAD,
    )
    raw = root / "data_raw"
    raw.mkdir()
    (raw / "lokace_map_prepocet.csv").write_text(
        "pobocka_cislo,lokace_short_zdroj,lokace_short_cil\n92,92.1,jen-pvp\n", encoding="utf-8"
    )
    (raw / "oblast_map.csv").write_text(
        "pobocka_cislo,oblast,pobocka_nazev\n1,Sklad,\n2,Jihozápad,\n,Mapa,nová\n", encoding="utf-8"
    )
    return root


@pytest.fixture(scope="module")
def model(spark, bundle):
    return build_model(spark, resolve_sources(spark, str(bundle)))


def table(df, *columns):
    return {tuple(r)[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_branches_get_their_area_from_the_first_source_that_knows(model):
    assert table(model.branches, "branch_id", "branch_name", "area") == {
        1: ("Střed", "Jih"),  # most frequent in the capacity file, the map does not override
        2: ("Jih", "Jihozápad"),  # from the map by number; the first of two rows counts
        3: ("Nová", "Mapa"),  # from the map by name
        92: ("Jeneč", "Sklad"),
    }


def test_warehouse_rows_only_add_new_keys(model):
    rows = model.inputs.physical.where("branch_id = 92").select("code_norm", "category", "capacity_physical")
    assert {tuple(r) for r in rows.collect()} == {
        ("JEN-PVP", "x", 1000.0), ("JEN-PVP", "z", 300.0), ("JEN-NEW", None, 40.0),
    }
    assert tuple(model.checks()["warehouse_merge"].first()) == (3, 2, 1)


def test_facts_belong_to_the_smallest_id(model, rows):
    got = rows(model.fact_physical, "location_id", "code_norm", "category", "capacity_physical", "stock_on_shelf")
    assert got == sorted(
        [
            (10, "A-1", "x", 120.0, 80.0), (10, "A-1", None, 5.0, 1.0), (11, "A-2", "x", 0.0, 0.0),
            (20, "B-1", "x", 50.0, 40.0), (20, "B-1", "y", 30.0, 20.0),
            (90, "JEN-PVP", "x", 1000.0, 900.0), (90, "JEN-PVP", "z", 300.0, 0.0),
            (91, "JEN-NEW", None, 40.0, 0.0), (None, "ORPHAN", "x", 7.0, 7.0),
            (50, "E-1", "x", 10.0, 9.5),
        ],
        key=lambda t: [(v is None, str(v)) for v in t],
    )


def test_flags(model):
    flagged = model.locations.where("is_realloc").select("location_id").collect()
    assert {r.location_id for r in flagged} == {10, 20, 21, 90}


def test_effective_capacity_follows_the_rules(model, rows):
    got = rows(model.effective_capacity_full, "location_id", "category", "capacity_physical", "capacity_realloc", "capacity_effective")
    assert got == sorted(
        [
            (10, "x", 120.0, None, None),  # flagged, no plan for the category
            (10, None, 5.0, None, None),
            (10, "none", None, 0.0, 0.0),
            (11, "x", 0.0, None, 0.0),
            (20, "x", 50.0, 60.0, 60.0),
            (20, "y", 30.0, None, None),
            (20, "w", None, 11.0, 11.0),  # planned only
            (90, "x", 1000.0, 1.0, 1000.0),  # storage keeps its physical capacity
            (90, "z", 300.0, None, 300.0),
            (90, "q", None, 5.0, 5.0),  # planned only, also in storage
            (91, None, 40.0, None, 40.0),
            (None, "x", 7.0, None, 7.0),  # no location, stays in the fact
            (50, "x", 10.0, None, 10.0),
        ],
        key=lambda t: [(v is None, str(v)) for v in t],
    )
    physical = model.effective_capacity.count()
    assert physical == 10


def test_location_metrics_equal_the_sums_of_effective_rows(model):
    sums = model.effective_capacity_full.groupBy("location_id").agg(
        F.sum("capacity_effective"), F.sum("capacity_physical"), F.sum("capacity_realloc")
    )
    expected = {r[0]: tuple(r)[1:] for r in sums.where("location_id is not null").collect()}
    got = table(
        model.metrics_location, "location_id", "capacity_total", "capacity_physical_sum", "capacity_realloc_sum"
    )
    assert len(got) == 9
    for location, figures in got.items():
        assert figures == expected.get(location, (None, None, None))


def test_enriched(model):
    got = table(
        model.metrics_location_enriched, "location_id", "area", "free", "fill_pct", "diff", "overloaded", "at_risk"
    )
    assert got[20] == ("Jihozápad", -4.0, 75 * 1.0 / 71 * 100.0, 4.0, True, True)
    assert got[21] == ("Jihozápad", None, None, None, None, None)
    assert got[10] == ("Jih", -130.0, None, 130.0, None, None)  # capacity is zero
    # The count of 9.5 is cut to a whole number; branch 5 has no catalogue row.
    assert got[50] == (None, 1.0, 90.0, -1.0, False, False)
    assert got[60] == (None, None, None, None, None, None)


def test_rollups_agree(model):
    measures = ["locations", "covered_locations", "stock_total", "capacity_total", "covered_stock"]
    whole = model.metrics_network.select(*measures).first()
    for rollup in (model.metrics_area, model.metrics_branch):
        assert rollup.agg(*[F.sum(m) for m in measures]).first() == whole
        bad = rollup.where("fill_pct is not null and fill_pct != covered_stock * 100.0 / capacity_total")
        assert bad.isEmpty()
    levels = model.metrics_grouping_sets
    for level, rollup, key in (("area", model.metrics_area, "area"), ("branch", model.metrics_branch, "branch_id")):
        part = levels.where(F.col("level") == level)
        assert table(part, key, *measures, "fill_pct") == table(rollup, key, *measures, "fill_pct")
    network = levels.where("level = 'network'").select(*measures, "fill_pct").first()
    assert network == model.metrics_network.select(*measures, "fill_pct").first()
    covered, without = whole.covered_locations, model.checks()["no_effective"].first()[0]
    assert covered + without == whole.locations


def test_stock_per_category_carries_its_own_date(model, rows):
    got = rows(model.fact_stock.where("category is not null"), "location_id", "as_of", "category", "stock")
    assert (20, "2026-01-03", "y", 20.0) in got and (None, None, "x", 7.0) in got
    assert len(got) == 8
    assert model.fact_stock.where("category is null").count() == 9


def test_lookups(model, rows):
    assert rows(model.lookup_realloc.where("location_id = 90"), "descriptor", "category") == [
        ("", "q"), ("d1", "x"),
    ]
    assert rows(model.lookup_physical.where("location_id = 10"), "marking", "type") == [
        ("", ""), ("m1", "x"), ("m2", "x"),
    ]


def test_checks(model):
    checks = model.checks()
    counted = {n: df.agg(F.count("*")) if n in ("area_conflicts", "plan_diff") else df for n, df in checks.items()}
    found = {name: tuple(df.first()) for name, df in counted.items()}
    assert found == {
        "source_overlap": (7, 4, 3, 4, 1),
        "warehouse_merge": (3, 2, 1),
        "area_conflicts": (1,),
        "unknown_areas": (1, "Mapa"),
        "duplicate_ids": (0,),
        "duplicate_keys": (2,),
        "no_physical": (3,),
        "orphan_capacity": (1,),
        "no_effective": (3,),
        "zero_stock": (2,),
        "coverage": (9, 6),
        "plan_diff": (2,),
        "no_branch": (1,),
        "duplicate_branches": (1,),
        "unreadable_branches": (0,),
    }
    # The report counts several checks in one go and comes to the same numbers.
    report = {}
    for r in model.dq_report.collect():
        report.setdefault(r.check, {})[r.measure] = r.value
    for name, df in checks.items():
        if name in ("area_conflicts", "plan_diff"):
            assert tuple(report[name].values()) == found[name]
        else:
            row = df.first().asDict()
            assert report[name] == {k: v for k, v in row.items() if k != "areas"}
    assert set(report) == set(checks)
    stock, realloc, shared, only_stock, only_realloc = found["source_overlap"]
    assert shared + only_stock == stock and shared + only_realloc == realloc


def test_materialized_and_lazy_models_agree(spark, model, rows):
    lazy = Model(model.inputs, model.config)
    for name in ("metrics_area", "fact_realloc", "metrics_location_category"):
        assert rows(getattr(lazy, name)) == rows(getattr(model, name))


def test_sums_of_nothing_can_stay_null(model):
    strict = Model(model.inputs, dataclasses.replace(model.config, all_null_sum="null"))
    got = table(strict.metrics_location, "location_id", "capacity_total", "capacity_realloc_sum")
    assert got[11] == (None, None) and got[10] == (None, None)
    with pytest.raises(ValueError):
        ModelConfig(all_null_sum="other")


def test_single_facts_equal_the_cells(model, rows):
    ids = model.location_ids
    assert rows(facts.fact_physical(model.inputs.physical, ids).select(*model.fact_physical.columns)) == rows(model.fact_physical)
    assert rows(facts.fact_realloc(model.inputs.realloc, ids).select(*model.fact_realloc.columns)) == rows(model.fact_realloc)


# --- duplicates the sources should not have ---------------------------------------------------


def test_location_listed_twice_counts_as_the_grouping_says(spark):
    stock = spark.createDataFrame(
        [(1, 1, "n", "A", "A", 5, "d"), (1, 1, "n", "A", "A", 5, "d"), (2, 1, "n", "B", "B", 5, "d")],
        "location_id bigint, branch_id bigint, branch_name string, code string, code_norm string, "
        "stock_total bigint, as_of string",
    )
    branches = spark.createDataFrame([(1, "n", "x")], schema.BRANCHES)
    physical = spark.createDataFrame(
        [(1, "A", None, 10.0, None)],
        "branch_id bigint, code_norm string, category string, capacity_physical double, stock_on_shelf double",
    )
    inputs = ModelInputs(stock, branches, physical, schema.empty(spark, schema.REALLOC))
    got = sorted(tuple(r) for r in Model(inputs).metrics_location.select("location_id", "capacity_total").collect())
    assert got == [(1, 20.0), (2, None)]
    assert quality.duplicate_ids(Model(inputs).locations).first()[0] == 2


def test_storage_area_is_a_setting(spark, model):
    other = dataclasses.replace(model.config, storage_area="Jihozápad")
    full = Model(model.inputs, other).effective_capacity_full
    assert full.where("location_id = 20 and category = 'x'").first().capacity_effective == 50.0
    assert full.where("location_id = 90 and category = 'x'").first().capacity_effective == 1.0


# --- exports --------------------------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_exports(spark, bundle, model, tmp_path, fmt):
    out = str(tmp_path / "out")
    sinks.export(model, out, fmt)
    for name, attribute in sinks.EXPORTS.items():
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        back = reader.format(fmt).load(f"{out}/{name}")
        assert back.columns == getattr(model, attribute).columns
        assert back.count() == getattr(model, attribute).count()


def test_report_and_views(spark, model, tmp_path):
    sinks.write_dq(model.dq_report, str(tmp_path))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/lines").collect()]
    assert "coverage / covered_locations: 6" in lines and len(lines) == model.dq_report.count()
    names = sinks.register(model, "t_")
    assert spark.sql("select count(*) from t_metrics_area").first()[0] == model.metrics_area.count()
    for name in names:
        spark.catalog.dropTempView(name)


def test_batch_run_skips_unchanged_inputs(spark, bundle, tmp_path):
    out = str(tmp_path / "out")
    assert run(spark, str(bundle), out)
    assert not run(spark, str(bundle), out)
    assert run(spark, str(bundle), out, "csv") and not run(spark, str(bundle), out, "csv")
    assert run(spark, str(bundle), out) and run(spark, str(bundle), out, config=ModelConfig(risk_ratio=0.5))
    shutil.rmtree(f"{out}/exports/metrics_area")
    assert run(spark, str(bundle), out)
    assert spark.read.parquet(f"{out}/exports/metrics_network").first().locations == 9


def test_bundle_without_optional_files(spark, bundle, tmp_path):
    for name in ("Pobočky", "Capacity", "Skutečný stav"):
        spark.read.parquet(str(bundle / f"{name}.parquet")).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = build_model(spark, resolve_sources(spark, str(tmp_path)))
    assert found.locations.where("is_realloc").isEmpty() and found.lookup_realloc.isEmpty()
    assert found.metrics_network.first().capacity_total == 120 + 5 + 80 + 10 + 0
    assert table(found.branches, "branch_id", "area")[3] == ("Neurčeno",)
    assert "warehouse_merge" not in found.checks()


# --- text files -------------------------------------------------------------------------------------


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "data_raw"
    folder.mkdir()
    (folder / "lokace-vsechny-nazev.csv").write_text(
        "select x\n1, 1, Chodov, a, 10, 2026\n2, 1, Chodov, b, 2 0, 2026\n"
        "3, 2, Opatov, a, 5, 2026\n4, <null>, <null>, w, 1, 2026\n5, 2, Opatov, w, 1, 2026\n"
        "6, 1, Second name, c, 1, 2026\n7, 1, short\n",
        encoding="utf-8",
    )
    (folder / "realokace.csv").write_text(
        "lokace_short,pobocka_cislo,pobocka_nazev,och,kapacita_realokace\nW,,,,\na,,opatov ,x,7\n",
        encoding="utf-8",
    )
    (folder / "oblast_map.csv").write_text(
        "pobocka_cislo;oblast;pobocka_nazev\n1;Jih;\n;Sever;OPATOV\n", encoding="utf-8"
    )
    return folder


def test_build_from_one_capacity_csv(spark, tmp_path, raw):
    (raw / "kapacita.csv").write_text(
        "číslo knihovny;Lokace;OCH;Kapacita;Stav;Oblast\n1;A;x;10;8;Sklad\n;a;x;99;;\n2;a;;4;1;\n2.5;a;;4;1;\n",
        encoding="cp1250",
    )
    found = build_model(spark, resolve_sources(spark, str(tmp_path)))
    # A row without a number in a single file stays without: there is no part to take it from.
    assert found.inputs.physical.where("branch_id is null").count() == 2
    assert table(found.branches, "branch_id", "branch_name", "area") == {
        1: ("Chodov", "Sklad"), 2: ("Opatov", "Sever"),
    }
    # A row without a number names its code in every branch, even when it gives a name.
    flagged = found.locations.where("is_realloc").select("location_id").collect()
    assert {r.location_id for r in flagged} == {1, 3, 4, 5}
    losses = {(r.check, r.value) for r in found.dq_report.where("measure = 'rows'").collect()}
    assert {("duplicate_branches", 1), ("rejected_lines", 1), ("unreadable_branches", 1)} <= losses
    got = table(found.metrics_location, "location_id", "stock_total", "capacity_total")
    # A plan without a number reaches no cell, and what is flagged counts its plan only,
    # except in storage, which location 1 belongs to.
    assert got == {1: (10, 10.0), 2: (20, None), 3: (5, None), 4: (1, None), 5: (1, None), 6: (1, None)}


def test_build_from_parts(spark, tmp_path, raw):
    folder = raw / "kapacita"
    folder.mkdir()
    (folder / "Chodov.csv").write_text(
        "KAPACITA_CISLOKNIH;KAPACITA_LOKACE_SHORT;KAPACITA_PLAN\n;a;1\n1;b;2\n;b;3\n", encoding="utf-8"
    )
    # No number anywhere in the part: it is found by the part's name.
    (folder / "opatov.csv").write_text("Lokace;Plan;Kraj\na;4;Kraj Z\n", encoding="utf-8")
    found = build_model(spark, resolve_sources(spark, str(tmp_path)))
    got = table(found.metrics_location, "location_id", "area", "capacity_physical_sum")
    assert got[1] == ("Jih", 1.0) and got[2] == ("Jih", 5.0) and got[3] == ("Kraj Z", 4.0)


def test_capacity_without_any_branch_is_an_error(spark, tmp_path, raw):
    (raw / "kapacita.csv").write_text("Lokace;Kapacita\na;1\n", encoding="utf-8")
    with pytest.raises(ValueError, match="branch_id"):
        build_model(spark, resolve_sources(spark, str(tmp_path)))
