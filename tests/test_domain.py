import json
import math

import duckdb
import pytest

from icewake import registry
from icewake.operators import cost, density, grid, modes, points, routes, search
from icewake.sources import ais

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("events", "orders"):
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).fetchdf()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    a, b = (f[columns].astype(str).sort_values(columns).reset_index(drop=True) for f in (ours, theirs))
    assert a.equals(b)


def test_demo_voyage_costs_what_is_published(spark):
    cells = cost.demo_cost(grid.demo_grid(spark)).selectExpr("'demo' as run_id", "i", "j", "cost")
    steps = registry.demo_route(spark, cells).toPandas().sort_values("seq")
    assert len(steps) == 54 and steps.step_cost.sum() == 54.0
    frame = spark.createDataFrame(steps[["run_id", "seq", "lat", "lon"]].rename(columns={"run_id": "route_id"}))
    assert routes.lengths(frame).first()["length_km"] == pytest.approx(4326.700952896922, rel=1e-9)


def test_search_reasons_and_detours():
    open_sea = {(i, j): 1.0 for i in range(5) for j in range(5)}
    wall = {c: v for c, v in open_sea.items() if c[1] != 2 or c[0] == 4}
    path, why = search.least_cost_path(wall, (0, 0), (0, 4))
    assert why == "" and (4, 2) in path
    assert search.least_cost_path(open_sea, (9, 9), (0, 0))[1] == "start_blocked"
    assert search.least_cost_path(open_sea, (0, 0), (9, 9))[1] == "goal_blocked"
    shut = {c: v for c, v in open_sea.items() if c[1] != 2}
    assert search.least_cost_path(shut, (0, 0), (0, 4))[1] == "no_path"
    assert search.least_cost_path(open_sea, (0, 0), (4, 4), most=2)[1] == "max_expansions_reached"
    assert len(search.least_cost_path(open_sea, (0, 0), (4, 4), diagonal=False)[0]) == 9


def test_empty_tables_stay_empty(spark):
    none = spark.createDataFrame([], "point_id long, mmsi long, ts timestamp_ntz, sog double, lat double, lon double")
    assert density.rasterise(none, grid.DEMO).count() == 0
    assert points.valid(none).count() == 0
    results = spark.createDataFrame([], "run_id long, scenario_id long, mode string, reachable boolean, distance_km double, total_cost double, risk double")
    assert modes.compare(results).count() == 0 and modes.pareto_front(results).count() == 0


def test_missing_layers_and_ice_class(spark):
    rows = [(0, 0, False, None, None, None), (0, 1, False, 0.5, 6.0, 1.5), (0, 2, True, 0.5, 1.0, 0.1)]
    cells = spark.createDataFrame(rows, "i long, j long, is_land boolean, sic double, wave double, thick double")
    out = {r["j"]: r for r in cost.vessel_cost(cells, 0.7, 0.9).collect()}
    assert out[0]["cost"] == 1.0 and out[1]["cost"] is None and out[1]["blocked"] and out[2]["cost"] is None
    assert out[1]["wave_risk"] == pytest.approx(1.0) and out[1]["ice_risk"] == pytest.approx(4 * 0.5**1.5)


def test_thinning_keeps_both_ends(spark):
    steps = spark.createDataFrame([("a", k, 70.0, k * 0.1) for k in range(11)] + [("b", 0, 1.0, 1.0)], "route_id string, seq int, lat double, lon double")
    kept = [r["seq"] for r in routes.thinned(steps, 12.0).filter("route_id = 'a'").orderBy("seq").collect()]
    assert kept[0] == 0 and kept[-1] == 10 and len(kept) < 11
    assert routes.thinned(steps, 12.0).filter("route_id = 'b'").count() == 1


def test_sources_read_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MMSI,Latitude,Longitude,timestamp,sog\n1,75.5,20.0,2024-01-15T10:50:00Z,9.5\n2,x,20.0,2024-01-15T10:50:00Z,\n")
    rows = ais.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert len(rows) == 1 and rows[0]["mmsi"] == 1 and rows[0]["lat"] == 75.5 and rows[0]["ts"] is not None
    record = {"mmsi": 3, "LAT": 76.0, "lng": "21", "time": "2024-01-15 11:00:00"}
    (tmp_path / "b.json").write_text(json.dumps([{"code": "0", "data": [record, record]}, record]))
    assert ais.read_json_records(spark, str(tmp_path / "b.json")).filter("lat = 76 and lon = 21 and mmsi = 3").count() == 3
    feature = {"properties": {"mmsi": 4, "timestamp": "2024-01-15T11:00:00"}, "geometry": {"coordinates": [22.5, 77.5]}}
    (tmp_path / "c.jsonl").write_text(json.dumps(feature) + "\n{bad\n")
    good, bad = ais.read_json_lines(spark, str(tmp_path / "c.jsonl"))
    assert [(r["lat"], r["lon"]) for r in good.collect()] == [(77.5, 22.5)] and bad.first()["bad_lines"] == 1


def test_streamed_density_equals_batch(spark, tmp_path):
    from icewake.plans import domain_tables
    from icewake.streaming.density import windowed_density

    batch = domain_tables.points(spark, SF).select("ts", "lat", "lon")
    batch.write.parquet(str(tmp_path / "in"))
    stream = windowed_density(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), grid.DEMO)
    query = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("streamed").selectExpr("sum(n) as n").first()["n"] == batch.count()
    assert math.isfinite(batch.count())
