"""Whole plans: fallbacks, ends far from water, runs without a route, scores and ties."""

import pytest
from pyspark.sql import functions as F

from icewake.operators import grid, planner
from icewake.operators.planning import Profile

ONE = (Profile("plain"),)


def _request(name="r", start=(0.0, 0.0), end=(0.0, 5.0), layers=True, thick=1.0):
    return (name, *start, *end, layers, 1.0, 1.0, 0.0, 0.0, 10.0, 0.1, thick, 1.0)


def _strip(spark, rows):
    """Cells in one row: (j, is_land, sic, thick)."""
    made = [(0, j, 0.0, float(j), land, sic, thick) for j, land, sic, thick in rows]
    return spark.createDataFrame(made, "i long, j long, lat double, lon double, is_land boolean, sic double, thick double")


def test_layers_of_another_shape_or_none_fall_back(spark):
    cells = grid.grid_cells(spark, grid.GridAxes(2, 3, 70.0, 80.0, 0.0, 2.0))
    layer = cells.select("i", "j", F.lit(0.25).alias("value"))
    mask = cells.select("i", "j", (F.col("j") == 0).alias("is_land"))
    why = lambda *a: planner.placed_layers(cells, *a)[1]
    assert why(mask, {"sic": layer, "wave": layer}) == ""
    assert why(mask, {"sic": None, "wave": layer}) == "no_ice_layer"
    assert why(mask, {"sic": None, "wave": None}) == "no_layers"
    assert why(mask, {"sic": layer.filter("j < 2"), "wave": layer}) == "shape_mismatch"
    assert why(None, {"sic": layer, "wave": layer}) == "no_mask"
    assert why(mask, {"sic": layer.withColumn("value", F.lit(float("nan")))}) == "no_layers"
    rows, _ = planner.placed_layers(cells, mask.filter("j = 0"), {"sic": layer.union(layer)})
    assert rows.count() == 6 and rows.filter("is_land").count() == 2


def test_ice_too_thick_bars_layers_but_not_the_belt(spark):
    cells = _strip(spark, [(j, False, 0.0 if j < 5 else None, 3.0 if j == 2 else None) for j in range(6)])
    asked = planner.request_table(spark, [_request("real"), _request("belt", layers=False), _request("strong", thick=9.0)])
    plans, steps = planner.plan(cells, asked, profiles=ONE, size=4)
    got = {r["request"]: r for r in plans.collect()}
    assert (got["real"]["reachable"], got["real"]["search"], got["real"]["distance_km"], got["real"]["fuel"]) == (False, "no_path", None, 0.0)
    assert (got["belt"]["source"], got["belt"]["steps"], got["belt"]["total_cost"], got["belt"]["search_cost"]) == ("belt", 6, 6.0, 5.0)
    assert got["strong"]["reachable"] and got["strong"]["distance_km"] == pytest.approx(5 * 111.19493, abs=1e-3)
    assert got["strong"]["fuel"] == pytest.approx(0.1 * got["strong"]["distance_km"]) and got["strong"]["co2"] == pytest.approx(3.114 * got["strong"]["fuel"])
    assert steps.filter("seq >= 0").count() == 12


def test_ends_on_land_move_to_water_and_places_without_one_stay(spark):
    cells = _strip(spark, [(j, j < 2 or j > 3, 0.0, None) for j in range(6)])
    asked = planner.request_table(spark, [_request("far", end=(0.0, 170.0)), _request("lost", start=(None, 1.0))])
    got = {r["request"]: r for r in planner.plan(cells, asked, profiles=ONE, size=4)[0].collect()}
    assert (got["far"]["steps"], got["far"]["on_land"], got["far"]["reachable"]) == (2, 0, True)
    assert (got["lost"]["reachable"], got["lost"]["search"]) == (False, "no_ocean_start")


def test_scores_and_ties(spark):
    made = [("a", "x", 0, 10.0, 4.0, 0.0), ("a", "y", 1, 20.0, 0.0, 0.0), ("a", "z", 2, None, 0.0, 0.0), ("b", "y", 1, 5.0, 1.0, 1.0), ("b", "x", 0, 5.0, 1.0, 1.0 + 1e-12)]
    rows = spark.createDataFrame(made, "request string, mode string, place int, leg_km double, model_risk double, model_uncertainty double").withColumns({
        "steps": F.when(F.col("leg_km").isNotNull(), 2), "speed_kn": F.lit(0.0), "fuel_per_km": F.lit(1.0),
        **{c: F.lit(0.0) for c in planner.COMPONENTS if not c.startswith("model")}, **{c: F.lit(0.0) for c in ("total_cost", "search_cost", "mean_uncertainty")}, **{c: F.lit("") for c in ("source", "reason", "search")}, "on_land": F.lit(0),
    })
    got = {(r["request"], r["mode"]): r for r in planner.scored(rows, (0.5, 0.25, 0.25)).collect()}
    assert got["a", "x"]["score"] == pytest.approx(0.25 * 0.5 + 0.5) and got["a", "y"]["score"] == pytest.approx(0.25) and got["a", "z"]["score"] == 0.0
    assert {k for k, r in got.items() if r["recommended"]} == {("a", "z"), ("b", "x")}
    assert got["b", "x"]["score"] == 0.0 and got["a", "x"]["hours"] == 0.0


def test_no_requests_and_no_cells(spark):
    cells = _strip(spark, [(0, False, 0.0, None)])
    assert planner.plan(cells, planner.request_table(spark, []), profiles=ONE)[0].count() == 0
    got = planner.plan(cells.limit(0), planner.request_table(spark, [_request()]), profiles=ONE)[0].collect()
    assert [(r["reachable"], r["search"]) for r in got] == [(False, "no_ocean_start")]
