from __future__ import annotations

import pytest

from shelfspan.config import FilterSpec
from shelfspan.fixed_values import BLANK_OPTION
from shelfspan.plans import explore

LOCATIONS = (
    "location_id bigint, area string, branch_name string, code string, is_realloc boolean, "
    "stock_total bigint, capacity_physical_sum double, capacity_realloc_sum double, "
    "fill_pct double, overloaded boolean, at_risk boolean"
)


@pytest.fixture
def locations(spark):
    return spark.createDataFrame(
        [
            (1, "N", "One", "A", False, 10, 20.0, None, 50.0, False, False),
            (2, "N", "", "B", False, 30, 20.0, None, 150.0, True, True),
            (3, "S", "Two", "C", True, 5, None, 7.0, 71.0, False, False),
            (4, None, "Two", "D", True, 1, None, None, None, None, None),
            (5, "S", "Two", "E", None, 9, 9.0, 1.0, 100.0, False, True),
        ],
        LOCATIONS,
    )


def ids(df):
    return sorted(r.location_id for r in df.collect())


def test_filters(locations):
    def found(**selection):
        return ids(explore.filter_locations(locations, FilterSpec(**selection)))

    assert found() == [1, 2, 3, 4, 5]
    assert found(areas=("N",)) == [1, 2] and found(areas=("N", "S"), codes=("A", "E")) == [1, 5]
    assert found(branches=(BLANK_OPTION,)) == [2]
    assert found(is_realloc=True) == [3, 4] and found(is_realloc=False) == [1, 2]
    # A selection of a column the rows do not have restricts nothing.
    assert found(categories=("x",)) == [1, 2, 3, 4, 5]


def test_source_attributes_restrict_their_own_kind_only(spark, locations):
    physical = spark.createDataFrame(
        [(1, "m", ""), (2, "", "t"), (3, "m", "t")], "location_id bigint, marking string, type string"
    )
    realloc = spark.createDataFrame(
        [(3, "d", "c"), (1, "d", "c")], "location_id bigint, descriptor string, category string"
    )

    def found(lookups=(physical, realloc), **selection):
        return ids(explore.filter_source_dims(locations, *lookups, FilterSpec(**selection)))

    assert found() == [1, 2, 3, 4]
    assert found(markings=("m",)) == [1, 3, 4]
    assert found(markings=(BLANK_OPTION,), types=("t",)) == [2, 3, 4]
    assert found(descriptors=("d",)) == [1, 2, 3]
    assert found(markings=("none",), realloc_categories=("c",)) == [3]
    nothing = (physical.limit(0), realloc.limit(0))
    assert found(nothing, types=("t",)) == [3, 4]


def test_categories_follow_the_selected_locations(spark, locations):
    categories = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x")], "location_id bigint, category string")
    some = locations.where("area = 'S'")
    assert ids(explore.restrict_categories(categories, some)) == [3]
    assert ids(explore.restrict_categories(categories, locations.where("false"))) == []


def test_facets(locations):
    options = [r.option for r in explore.facet_options(locations, "branch_name").collect()]
    assert options == sorted([BLANK_OPTION, "One", "Two"])
    assert [r.option for r in explore.facet_options(locations, "area").collect()] == ["N", "S"]


def test_key_figures(locations):
    row = explore.kpi(locations).first()
    assert row.asDict() == {
        "capacity_physical": 49.0, "capacity_realloc": 8.0, "stock": 55,
        "fill_pct": 49 / 49.0 * 100.0, "remaining": -6.0, "locations": 5,
    }
    empty = explore.kpi(locations.where("false"))
    assert tuple(empty.first()) == (0.0, 0.0, 0, None, 0.0, 0)
    assert tuple(explore.present_kpi(empty).first()) == ("0", "0", "0", "—", "0", "0")
    series = explore.kpi_series(locations, {"stock": "Stav"}).collect()
    assert {tuple(r) for r in series} == {("capacity_physical", 49.0), ("Stav", 55.0), ("capacity_realloc", 8.0)}


def test_rankings_put_the_unknown_last(locations):
    ranked = explore.top_k(locations, "fill_pct", 5, "location_id").collect()
    assert [r.location_id for r in ranked] == [2, 5, 3, 1, 4]
    assert ids(explore.overloaded_top(locations)) == [2]
    assert [r.location_id for r in explore.least_used(locations, 2).collect()] == [1, 3]
    plan = explore.overloaded_top(locations)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_details_and_display(locations):
    assert ids(explore.branch_detail(locations, "Two")) == [3, 4, 5]
    assert ids(explore.category_detail(locations, "A")) == [1]
    shown = explore.present_locations(locations).where("location_id in (2, 4, 5)").orderBy("location_id")
    assert [(r["Realokační lokace"], r["Přetížená"], r["Riziková"]) for r in shown.collect()] == [
        ("Ne", "Ano", "Ano"), ("Ano", "—", "—"), ("—", "Ne", "Ano"),
    ]
    share = {r.is_realloc: r.locations for r in explore.realloc_share(locations).collect()}
    assert share == {True: 2, False: 2, None: 1}
