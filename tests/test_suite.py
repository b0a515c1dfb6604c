"""Scenario suites against published and derived route costs, and layers and reports against SQL."""

import pytest
from pyspark.sql import functions as F

from icewake import registry
from icewake.operators import cost, grid, suite
from icewake.registry_suite import scenarios

SF = "/root/testdata/sf0.001"


def test_cases_have_the_known_costs(spark):
    rows = {(r["scenario_id"], r["mode"]): r for r in registry.queries()["g05_cases"](spark, SF).collect()}
    assert len(rows) == 12 and all(r["reachable"] and r["reason"] == "" for r in rows.values())
    known = {"barents_to_chukchi": (54.656854,) * 3, "kara_short": (42.656854, 50.656854, 66.656854), "southern_route": (32.313708,) * 3, "west_to_east_demo": (103.112698, 121.112698, 157.112698)}
    for name, costs in known.items():
        for penalty, want in zip((2, 4, 8), costs):
            assert rows[name, f"penalty {penalty}"]["search_cost"] == pytest.approx(want, abs=1e-6)
    demo = rows["barents_to_chukchi", "penalty 4"]
    assert (demo["total_cost"], demo["steps"]) == (54.0, 54) and demo["distance_km"] == pytest.approx(4326.700952896922)


def test_runs_without_a_route_stay(spark):
    cells = grid.demo_grid(spark)
    walled = cost.demo_cost(cells).withColumn("cost", F.when(F.col("j") != 30, F.col("cost"))).withColumn("run_id", F.lit("walled"))
    rows = suite.suite_table(suite.suite(scenarios(spark), walled, cells, grid.DEMO), ["ice_risk"]).collect()
    assert {r["scenario_id"] for r in rows if r["reachable"]} == set() or len(rows) == 4
    lost = next(r for r in rows if r["scenario_id"] == "west_to_east_demo")
    assert (lost["reachable"], lost["reason"], lost["steps"], lost["total_cost"]) == (False, "no_path", 0, 0.0)


def test_layer_steps_and_lines(spark):
    cells = spark.createDataFrame([(0, 0, 1, 50.0), (0, 0, 2, 80.0), (0, 1, 2, None)], "i long, j long, time int, ICE double")
    at = lambda step: {(r["i"], r["j"]): r["value"] for r in suite.layer(cells, ["sic", "ice"], step).collect()}
    assert at(0) == {(0, 0): 0.5} and at(7) == {(0, 0): 0.8, (0, 1): None}
    with pytest.raises(IndexError):
        suite.layer(cells, ["ice"], 2, strict=True)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, '{"coordinates": [[1, 2]]}'), (4, '{"features": []}')], "k int, text string")
    assert [tuple(r) for r in suite.line_points(texts, "k", "text").collect()] == [(3, 0, 2.0, 1.0)]
    assert [r["line"] for r in suite.report_lines(spark.createDataFrame([("a", None)], "s string, x double"), ["s", "x"]).collect()] == ["| a |  |"]
