"""Missing values, planning over profiles, training tables and loose records."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from icewake import registry
from icewake.operators import checks, density, encounters, grid, planning, records, training

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def layer(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")


def column(frame, name):
    return [r[name] for r in frame.orderBy("k").collect()]


def test_layers_with_nan_and_infinities(spark):
    odd = layer(spark, 1.0, INF, NAN, 4.0, None, -INF)
    assert column(density.normalised(odd, "x", "y"), "y") == [0.25, 0.0, 0.0, 1.0, 0.0, 0.0]
    got = column(density.min_max(layer(spark, 1.0, NAN, 4.0, None), "x", "y"), "y")
    assert got[0] == 0 and math.isnan(got[1]) and got[2:] == [1.0, None]
    assert column(density.from_percent(layer(spark, 50.0, INF, NAN), "x", "y"), "y") == [0.5, None, None]
    assert column(density.quantile_scaled(layer(spark, 0.0, 1.0, NAN, INF), "x", "y", 0.0, 1.0), "y") == [0.0, 1.0, None, None]
    facts = density.statistics(odd, "x").first()
    assert (facts["n"], facts["finite_ratio"], facts["low"], facts["high"], facts["mean"]) == (6, pytest.approx(1 / 3), 1.0, 4.0, 2.5)
    assert column(checks.rescaled_if_large(layer(spark, 2.0, 4.0, INF), "x"), "x")[:2] == [0.5, 1.0]
    assert column(checks.mostly_missing(layer(spark, INF, NAN, 3.0), "x", 0.5), "x") == [None, None, None]


def test_nearest_ocean_equals_brute_force(spark):
    cells = grid.demo_grid(spark)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(np.random.default_rng(0).uniform((64, -2), (81, 165), (60, 2)))] + [(99, None, 1.0)]
    got = {r["point_id"]: (r["i"], r["j"]) for r in grid.nearest_ocean(spark.createDataFrame(rows, "point_id int, lat double, lon double"), cells, grid.DEMO, 10).collect()}
    ocean = [r for r in cells.collect() if not r["is_land"]]
    for k, lat, lon in rows[:-1]:
        i0, j0 = round((min(max(lat, 65), 80) - 65) / (15 / 39)), round(min(max(lon, 0), 160) / (160 / 79))
        near = [((r["lat"] - lat) ** 2 + (r["lon"] - lon) ** 2, r["i"], r["j"]) for r in ocean if abs(r["i"] - i0) <= 10 and abs(r["j"] - j0) <= 10]
        assert got.get(k) == (min(near)[1:] if near else None)
    assert 99 not in got


def test_beta_risk_is_ordered_and_near_the_samples(spark):
    rows = spark.createDataFrame([(m, 0.1 * m * (1 - m)) for m in (0.2, 0.5, 0.8)] + [(0.3, None), (0.0, 0.0)], "m double, v double")
    rng = np.random.default_rng(1)
    for r in training.beta_risk(rows, "m", "v").collect():
        assert r["risk_mean"] - 1e-9 <= r["risk_q"] <= r["risk_cvar"] + 1e-9
        if r["v"]:
            n = r["m"] * (1 - r["m"]) / r["v"] - 1
            x = np.sort(rng.beta(r["m"] * n, (1 - r["m"]) * n, 200_000))
            assert r["risk_q"] == pytest.approx(np.quantile(x, 0.9), abs=0.01) and r["risk_cvar"] == pytest.approx(x[180_000:].mean(), abs=0.01)
        else:
            assert r["risk_q"] == r["risk_cvar"] == r["m"]


def test_json_layouts():
    heads = {"﻿ [1]": "list", '{"a": 1}\n{"a": 2}\n': "jsonl", '{"a": {': "dict", '{"data": []}': "dict", "": "unknown", "x,y": "unknown"}
    assert {h: records.json_layout(h) for h in heads} == heads


def test_records_without_what_they_need_go(spark):
    raw = spark.createDataFrame([("1", "1700000000123", "45.0", "120.0"), ("2", "2024-01-02T03:04:05Z", "10", "20"), ("3", "1700000000", "95", "10"), ("4", None, "0", "0"), ("x", "1700000000", "0", "0")], "MMSI string, Timestamp string, Latitude string, LON string")
    got = {(r["mmsi"], r["ts"], r["lat"], r["lon"]) for r in records.normalised_records(raw, {"MMSI": "mmsi", "Timestamp": "ts", "Latitude": "lat"} | {"Longitude": "lon"}).collect()}
    assert got == {(1, 1700000000, 45.0, 120.0), (2, 1704164645, 10.0, 20.0)}
    assert records.normalised_records(raw.drop("MMSI"), {"Timestamp": "ts"}).count() == 0


def test_two_ships_that_meet_make_risk(spark):
    rows = [(1, "2024-12-01 00:00:00", 70.0, 10.0, 10.0, 90.0), (2, "2024-12-01 00:00:00", 70.0, 10.1, 10.0, 270.0)]
    p = spark.createDataFrame(rows, "mmsi long, ts string, lat double, lon double, sog double, cog double").selectExpr("mmsi", "to_timestamp(ts) as ts", "lat", "lon", "sog", "cog")
    met = encounters.interaction(encounters.pairs(p), 5.0, 0.5).collect()
    assert len(met) == 1 and met[0]["risk"] == pytest.approx(1.0) and met[0]["pairs"] == 1


def test_profiles_plan_the_demonstration_voyage(spark):
    runs = {r["run_id"]: r for r in registry.queries()["g04_profile_plans"](spark, SF).collect()}
    assert set(runs) == {"efficient", "safe", "robust"} and all(r["reachable"] and r["steps"] >= 50 for r in runs.values())
    assert runs["efficient"]["distance_km"] <= runs["robust"]["distance_km"]


def test_training_draw_and_resamples(spark):
    ocean = spark.range(400).selectExpr("id div 20 as i", "id % 20 as j")
    drawn = training.sampled_cells(ocean.filter("i = 0"), ocean)
    assert {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()} == {1: 20, 0: 100}
    assert drawn.groupBy("i", "j").count().filter("count > 1").count() == 0


def test_traffic_component_without_density_adds_nothing(spark):
    f = spark.createDataFrame([(1.0, 0.5), (2.0, None), (3.0, NAN)], "cost double, d double")
    assert [r["cost"] for r in planning.with_traffic_component(f, "d", 2.0).orderBy("cost").collect()] == [2.0, 2.0, 3.0]
    assert [r["cost"] for r in planning.with_traffic_component(f, "d", 0.0).orderBy("cost").collect()] == [1.0, 2.0, 3.0]


def test_beta_risk_takes_time_in_proportion_to_its_grid(spark):
    from time import perf_counter

    rows = spark.range(300).select((F.col("id") % 97 / 100 + 0.01).alias("m")).withColumn("v", 0.1 * F.col("m") * (1 - F.col("m"))).coalesce(1)
    took = []
    for steps in (20, 200, 3200):
        start = perf_counter()
        training.beta_risk(rows, "m", "v", steps=steps).write.format("noop").mode("overwrite").save()
        took.append(perf_counter() - start)
    assert took[2] < 8 * took[1] + 2
