import math
import random

import pytest

from icewake import registry
from icewake.operators import alignment, calibration, checks, fleet, grid, inventory, profiles, search
from icewake.operators import points as tracking
from icewake.plans import domain_tables


def test_fit_finds_the_exponents_that_made_the_data(spark):
    rows = [(k, (k * 37 % 101) / 100, (k * 29 % 71) / 10) for k in range(1, 400)]
    made = spark.createDataFrame([(k, s, w, 2 - 0.5 * s**1.5 - 0.1 * w**0.5) for k, s, w in rows], "id long, sic double, wave double, y double")
    best = calibration.refined_exponents(made, [1.0, 1.4, 2.0], [0.4, 1.0], 0.1).first()
    assert (best["p"], best["q"]) == (1.5, 0.5) and best["rmse"] < 1e-6
    fit = calibration.held_out_fit(made, 1.5, 0.5, made["id"] % 5 == 0).first()
    assert fit["b0"] == pytest.approx(2) and fit["b1"] == pytest.approx(-0.5) and fit["b2"] == pytest.approx(-0.1) and fit["holdout_r2"] == pytest.approx(1)


def test_fit_without_rows_or_spread(spark):
    none = spark.createDataFrame([], "id long, sic double, wave double, y double")
    assert calibration.refined_exponents(none, [1.0], [1.0], 0.1).count() == 0
    flat = spark.createDataFrame([(k, 0.5, 1.0, 1.0) for k in range(5)], none.schema)
    assert calibration.exponent_errors(flat, [1.0], [1.0]).first()["rmse"] is None


def test_area_under_curve_counts_ties_half(spark):
    draw = random.Random(5)
    rows = [(draw.choice([0.0, 0.2, 0.2005, 0.5, 1.0]), draw.randint(0, 1)) for _ in range(120)]
    wins = [(a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y]
    got = calibration.ranking_quality(spark.createDataFrame(rows, "score double, label int")).first()
    assert got["auc"] == pytest.approx(sum(wins) / len(wins)) and math.isfinite(got["log_loss"])
    one_class = spark.createDataFrame([(0.5, 1)], "score double, label int")
    assert calibration.ranking_quality(one_class).first()["auc"] is None


def test_nearest_cells_against_all_cells(spark):
    draw = random.Random(3)
    cells = [(k // 20, k % 20, draw.uniform(60, 80), draw.uniform(-40, 40)) for k in range(200)] + [(99, 99, 70.0, 0.0), (98, 98, 70.0, 0.0)]
    points = [(k, draw.uniform(50, 90), draw.uniform(-170, 170)) for k in range(150)] + [(900, 70.0, 0.0), (901, None, 1.0)]
    got = {r["point_id"]: (r["i"], r["j"]) for r in alignment.nearest_cells(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(cells, "i long, j long, lat double, lon double")).collect()}
    want = {k: min(((c[2] - a) * (c[2] - a) + (c[3] - b) * (c[3] - b), c[0], c[1]) for c in cells)[1:] for k, a, b in points if a is not None}
    assert got == want and got[900] == (98, 98)
    nothing = spark.createDataFrame([], "i long, j long, lat double, lon double")
    assert alignment.nearest_cells(spark.createDataFrame(points, "point_id long, lat double, lon double"), nothing).count() == 0


def test_otsu_says_why_there_is_no_threshold(spark):
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "x double")
    assert checks.otsu(frame([0.1] * 8), "x").first().asDict() == {"reason": "flat_field", "threshold": None}
    assert checks.otsu(frame([0.1, 0.2, None, float("nan")]), "x").first()["reason"] == "too_many_nan"
    assert checks.otsu(frame([]), "x").first()["reason"] == "too_many_nan"
    two = checks.otsu(frame([0.0] * 20 + [0.1] * 5 + [0.9] * 5 + [1.0] * 20), "x").first()
    assert two["reason"] == "ok" and 0.1 - 0.5 / 256 <= two["threshold"] < 0.9  # the middle of the bin that holds 0.1


def test_interpolation_holds_the_ends(spark):
    knots = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0), ("b", 5.0, 7.0)], "route_id string, s double, v double")
    targets = spark.createDataFrame([("a", -1.0, 0), ("a", 5.0, 1), ("a", 10.0, 2), ("a", 99.0, 3), ("b", 1.0, 4), ("c", 1.0, 5)], "route_id string, s double, id long")
    got = {r["id"]: r["v"] for r in profiles.interpolated(knots, targets, ["v"]).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 3: 3.0, 4: 7.0, 5: None}


def test_clean_plan_stops_at_the_limit(spark):
    files = spark.createDataFrame([("a", "202301", "risk", 5), ("b", "202301", "block", 4), ("c", "202302", "block", 3), ("d", "202312", "block", 9), ("e", None, "block", 2)], "path string, ym string, type string, size long")
    rank = files["type"] == "risk"
    gone = lambda limit, **k: {r["path"] for r in inventory.clean_plan(files, rank.cast("int"), 1, limit, **k).collect()}
    assert gone(None) == {"a", "b", "c", "e"}
    assert gone(20) == {"e", "b"} and gone(23) == set() and gone(22) == {"e"}
    assert gone(None, types=("risk",)) == {"a"} and gone(None, protected=("202301",)) == {"c", "e"}


def test_lookups_and_buckets(spark):
    kinds = spark.createDataFrame([("handysize", 13.0), ("panamax", 14.0)], "vessel string, speed double")
    rows = spark.createDataFrame([(1, "handysize"), (2, "sloop"), (3, None)], "id int, vessel string")
    assert {r["id"]: r["vessel"] for r in fleet.with_dimension(rows, kinds, "vessel", "panamax").collect()} == {1: "handysize", 2: "panamax", 3: "panamax"}
    at = spark.createDataFrame([(69.0, 60.0, 12, "cargo"), (69.0, 60.0, 12, "?"), (10.0, 10.0, 7, "cargo")], "lat double, lon double, m int, v string")
    assert [r[0] for r in at.select(fleet.context_bucket(at["lat"], at["lon"], at["m"], at["v"])).collect()] == ["NSR_DJF_cargo", "NSR_DJF", "global"]
    with pytest.raises(ValueError):
        fleet.every_pair(rows, rows, most=2)


def test_aligned_is_zero_outside(spark):
    source = domain_tables.F.lit(1.0)
    values = grid.demo_grid(spark).select("i", "j", source.alias("value"))
    target = spark.createDataFrame([(0, 0, 70.0, 50.0), (0, 1, 60.0, 50.0), (0, 2, 70.0, -20.0)], "i long, j long, lat double, lon double")
    assert sorted(tuple(r) for r in alignment.aligned(values, grid.DEMO, target).collect()) == [(0, 0, 1.0), (0, 1, 0.0), (0, 2, 0.0)]


def test_all_points_visit_cells(spark, monkeypatch):
    axes = grid.DEMO
    at = lambda i, j: (65 + i * 15 / 39, j * 160 / 79)
    # ids that 7 does not divide, cells east of 140 degrees, one on land (j >= 70), one without a position
    places = {1: (0, 0), 2: (0, 0), 7: (3, 4), 9: (39, 69), 10: (5, 75)}
    rows = [(k, *at(*c)) for k, c in places.items()] + [(11, None, 1.0)]
    points = spark.createDataFrame(rows, "point_id long, lat double, lon double")
    monkeypatch.setattr(domain_tables, "points", lambda *_: points)
    visited = {tuple(r) for r in registry.queries()["r10_visited_cells"](spark, "").select("i", "j").collect()}
    assert visited == {(0, 0), (3, 4), (39, 69)}
    unvisited = [tuple(r) for r in registry.queries()["r16_unvisited_cells"](spark, "").collect()]
    assert len(unvisited) == axes.ny * 70 - 3 and not visited & set(unvisited)


def test_complete_points_far_cells_and_bounded_search(spark):
    rows = [(1, 1, "t", 70.0, 0.0, 5.0), (2, 1, "t", 70.0, 0.0, -1.0), (3, 1, "t", 70.0, 0.0, None), (4, None, "t", 70.0, 0.0, 5.0), (5, 1, None, 70.0, 0.0, 5.0), (6, 1, "t", 91.0, 0.0, 5.0), (7, 1, "t", 10.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "point_id long, mmsi long, ts string, lat double, lon double, sog double")
    assert {r["point_id"] for r in tracking.complete(frame).collect()} == {1, 7}
    far = spark.createDataFrame([(1, 70.0, 160.0), (2, -60.0, -170.0)], "point_id long, lat double, lon double")
    cells = spark.createDataFrame([(0, 0, 70.0, 0.0, False), (0, 79, 70.0, 160.0, True)], "i long, j long, lat double, lon double, is_land boolean")
    assert {tuple(r) for r in alignment.nearest_ocean_anywhere(far, cells).collect()} == {(1, 0, 0), (2, 0, 0)}
    fields = spark.createDataFrame([(run, i, j, 1.0) for run in "ab" for i in range(5) for j in range(5)], "run_id string, i long, j long, cost double")
    runs = spark.createDataFrame([("a", 0, 0, 4, 4, 2), ("b", 0, 0, 4, 4, None)], "run_id string, start_i long, start_j long, goal_i long, goal_j long, most long")
    found = search.search_routes(fields, runs).collect()
    assert [(r["seq"], r["reason"]) for r in found if r["run_id"] == "a"] == [(-1, "max_expansions_reached")]
    assert sum(r["run_id"] == "b" for r in found) == 5


def test_hot_stretch_does_not_hang_on_the_order_of_a_sum(spark):
    from icewake.operators import planning

    routes = {"a": [3.4, 3.9, 4.0, 2.2, 1.7, 1.3], "b": [3.4, 3.8, 4.0, 3.2, 3.9, 1.2], "c": [3.8, 3.6, 3.9, 2.6, 3.9, 1.3]}  # a step of each is on the bound
    steps = spark.createDataFrame([(r, k + 1, x, x) for r, values in routes.items() for k, x in enumerate(values)], "route_id string, seq long, u double, v double")
    got = {r["route_id"]: (r["first_hot"], r["last_hot"]) for r in planning.hot_stretch(steps, ["u", "v"], 0.61).collect()}
    assert got == {"a": (2, 4), "b": (3, 4), "c": (3, 4)}
