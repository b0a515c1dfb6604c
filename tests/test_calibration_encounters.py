"""Fits, order statistics, draws and encounters against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from icewake.operators import density, encounters, logistic, points, selection, training


def newton(x, y, w, ridge=1.0):
    b, held = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (w * m * (1 - m))) @ x + held, x.T @ (w * (y - m)) - held @ b)
    return b


def area(z, y, w):
    z, total = np.round(z, 9), 0.0
    for k in np.flatnonzero(y):
        total += w[k] * (w[(y == 0) & (z < z[k])].sum() + w[(y == 0) & (z == z[k])].sum() / 2)
    return total / (w[y == 1].sum() * w[y == 0].sum())


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(4)
    n = 900
    sic, wave, lat, extra = np.round(rng.uniform(-0.1, 1.1, n), 2), np.round(rng.uniform(0, 11, n), 1), np.round(rng.uniform(60, 85, n), 1), np.round(rng.normal(size=n), 2)
    chance = 1 / (1 + np.exp(-(-2 + 3 * np.clip(sic, 0, 1) ** 2 + 0.2 * np.clip(wave, 0, 10) + 0.5 * extra)))
    return sic, wave, lat, extra, (rng.uniform(size=n) < chance).astype(int)


def frame(spark, sample):
    rows = [(k, *map(float, x), int(y)) for k, (*x, y) in enumerate(zip(*sample, strict=True))]
    odd = [(9001, None, 1.0, 70.0, 0.0, 1), (9002, 0.5, float("nan"), 70.0, 0.0, 1), (9003, 0.5, 1.0, 70.0, 0.0, None), (9004, 0.5, 1.0, 70.0, 0.0, 2), (9005, 0.5, 1.0, 70.0, None, 0)]
    return spark.createDataFrame(rows + odd, "id long, sic double, wave double, lat double, extra double, label int")


def test_fits_equal_numpy_and_blocks_leave_out_their_rows(spark, sample):
    sic, wave, lat, extra, y = sample
    got = {(r["p"], r["q"]): r for r in logistic.calibrate(frame(spark, sample), [(1.0, 1.0), (2.0, 0.7)], blocks=4, others=("extra",)).collect()}
    ends = np.quantile(lat, np.linspace(0, 1, 5))
    for p, q in got:
        x = np.stack([np.ones(len(y)), np.clip(sic, 0, 1) ** p, np.clip(wave, 0, 10) ** q, extra], axis=1)
        one, r = np.ones(len(y)), got[p, q]
        b = newton(x, y, one)
        assert np.allclose([r[f"b{k}"] for k in range(4)], b, atol=1e-6)
        assert math.isclose(r["auc"], area(x @ b, y, one), abs_tol=1e-9)
        z = x @ b
        assert math.isclose(r["log_loss"], float(np.mean(np.log1p(np.exp(z)) - y * z)), abs_tol=1e-9)
        scores = []
        for k in range(4):
            inside = (lat >= ends[k]) & (lat <= ends[k + 1])
            scores.append(area((x @ newton(x, y, 1.0 - inside))[inside], y[inside], one[inside]))
        assert math.isclose(r["cv_auc_mean"], np.mean(scores), abs_tol=1e-7) and math.isclose(r["cv_auc_std"], np.std(scores), abs_tol=1e-7)
        assert (r["n"], r["n_positive"]) == (900, int(y.sum()))


def test_fits_of_separable_flat_and_missing_samples(spark):
    flat = spark.createDataFrame([(k, 0.5, 2.0, 70.0, k % 2) for k in range(20)], "id long, sic double, wave double, lat double, label int")
    r = logistic.calibrate(flat, [(1.0, 1.0)]).first()
    assert r["auc"] == 0.5 and abs(r["log_loss"] - math.log(2)) < 1e-9
    split = flat.withColumn("sic", F.col("label") * 1.0)
    assert logistic.calibrate(split, [(1.0, 1.0)]).first()["auc"] == 1.0
    assert logistic.calibrate(flat.filter("label = 1"), [(1.0, 1.0)]).first()["auc"] is None
    assert logistic.calibrate(flat.filter("false"), [(1.0, 1.0)], blocks=3).count() == 0
    with pytest.raises(ValueError):
        logistic.fit(logistic.weighted(flat, (), [F.lit(1.0)], [F.lit(1.0)]), [(1.0, 1.0)] * 100_001)


def test_intervals_hold_the_true_exponent(spark):
    rng = np.random.default_rng(6)
    n = 4000
    sic, wave = rng.uniform(0, 1, n), rng.uniform(0, 6, n)
    y = rng.uniform(size=n) < 1 / (1 + np.exp(-(-3 + 8 * sic**2 + 0.3 * wave)))
    rows = spark.createDataFrame([(k, float(a), float(b), int(c)) for k, (a, b, c) in enumerate(zip(sic, wave, y, strict=True))], "id long, sic double, wave double, label int")
    r = logistic.intervals(rows, "id", 2.0, 1.0, draws=8, reach=2, step=0.4)
    r = r.first()
    assert r["draws"] == 8 and r["p_low"] <= 2.0 <= r["p_high"] and 0.5 <= r["q_low"] <= r["q_high"] <= 3.0
    weights = rows.select(*(logistic.resampling_weight("id", k).alias(f"w{k}") for k in range(3))).agg(*(f(f"w{k}").alias(f"{n}{k}") for k in range(3) for n, f in (("m", F.avg), ("v", F.var_pop)))).first()
    assert all(abs(x - 1) < 0.12 for x in weights)


def test_quantiles_equal_numpy_on_odd_columns(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 8)
    monkeypatch.setattr(selection, "FEW", 4)
    rng = np.random.default_rng(1)
    shares = [0.0, 0.013, 0.5, 0.777, 1.0]
    for values in ([3.0] * 500, rng.normal(size=700), np.r_[rng.normal(size=300), [5.0] * 400], 10.0 ** rng.uniform(-200, 200, 200), [1.0], np.r_[-1e308, 1e308, np.zeros(50)], np.r_[np.arange(40), 1e15 + np.arange(40)]):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double")
        assert np.allclose(selection.quantiles(rows, "x", shares), np.quantile(values, shares), rtol=1e-12, atol=0)
    assert selection.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_passes_are_few_and_count_ranges_only(spark):
    rows = spark.range(300_000).select((F.xxhash64("id") % 100_003).alias("x"))
    want = sorted(r["x"] for r in rows.collect())
    assert selection.values_at(rows, F.col("x"), lambda n: [0, 5, n // 3, n - 1]) == {0: {k: want[k] for k in (0, 5, 100_000, 299_999)}}


def test_draws_repeat_at_any_partitioning(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("label"), F.lit("x").alias("_g"))
    drawn = lambda f: {r["id"] for r in points.sampled(f, "id", 40, "label").collect()}
    one = drawn(rows)
    assert one == drawn(rows.repartition(13)) == drawn(rows.coalesce(1)) and len(one) == 120
    assert {r["id"] for r in points.drawn(rows, "id", 7).collect()} == {r["id"] for r in points.drawn(rows.repartition(5), "id", 7).collect()}
    assert points.drawn(rows.filter("false"), "id", 7).count() == 0 and points.drawn(rows, "id", 0).count() == 0
    ocean = spark.range(3000).select((F.col("id") / 60).cast("long").alias("i"), (F.col("id") % 60).alias("j"))
    picked = training.sampled_cells(ocean.filter("i = 2"), ocean).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in picked} == {1: 60, 0: 180}
    assert training.sampled_cells(ocean.filter("i > 1"), ocean).filter("label = 0").count() == 120
    twice = ocean.union(ocean)
    assert selection.smallest(twice, ["i", "j"], lambda n: 9).count() == 9


def test_scaled_by_quantiles_keeps_missing_values(spark):
    cells = spark.createDataFrame([(0, float(k)) for k in range(101)] + [(1, None), (2, float("nan"))], "i long, x double")
    got = {(r["i"], r["x"]): r["y"] for r in density.quantile_scaled(cells, "x", "y").collect() if r["i"] == 0 or r["x"] is None}
    assert got[0, 0.0] == 0.0 and got[0, 50.0] == 0.5 and got[0, 100.0] == 1.0 and got[1, None] is None
    assert density.quantile_scaled(cells.filter("i = 1"), "x", "y").first()["y"] is None


def encounters_by_brute_force(rows, reach):
    out, rows = set(), sorted(rows)
    for n, (slot, a, lat1, lon1) in enumerate(rows):
        for slot2, b, lat2, lon2 in rows[n + 1 :]:
            if slot == slot2 and a != b:
                east = ((lon2 - lon1 + 540) % 360 - 180) * 111.32 * math.cos(math.radians((lat1 + lat2) / 2))
                if math.hypot(east, (lat2 - lat1) * 110.574) <= reach:
                    out.add((slot, min(a, b), max(a, b)))
    return out


def test_encounters_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(encounters, "BLOCK", 16)
    rng = np.random.default_rng(9)
    places = [(float(rng.uniform(-89.9, 89.9)), float(rng.uniform(-180, 180))) for _ in range(250)]
    places += [(70 + float(rng.normal()) * 0.2, 20 + float(rng.normal()) * 0.3) for _ in range(150)]  # a hot tile
    places += [(75 + float(rng.normal()) * 0.2, (180 + float(rng.normal()) * 0.5 + 180) % 360 - 180) for _ in range(60)]  # the date line
    places += [(89.5 + float(rng.uniform(0, 0.5)), float(rng.uniform(-180, 180))) for _ in range(40)]  # the pole
    places += [(70.0, 20.0), (70.0, 20.0), (90.0, 5.0), (-90.0, 7.0), (60.0, 180.0), (60.0, -180.0)]
    rows = [(k % 2, k, lat, lon) for k, (lat, lon) in enumerate(places)]
    stamped = [(m, f"2024-01-01 0{s}:05:00", lat, lon, 10.0, None) for s, m, lat, lon in rows] + [(0, "2024-01-01 00:59:00", 0.0, 0.0, 1.0, 1.0), (None, "2024-01-01 00:05:00", 70.0, 20.0, 1.0, 1.0), (7000, "2024-01-01 00:05:00", None, 20.0, 1.0, 1.0)]
    frame = spark.createDataFrame(stamped, "mmsi long, ts string, lat double, lon double, sog double, cog double").withColumn("ts", F.col("ts").cast("timestamp"))
    first = frame.filter("ts = '2024-01-01 00:05:00'").select(F.floor(F.unix_timestamp("ts") / 3600)).first()[0]
    for reach in (5.0, 60.0, 300.0):
        got = [(r["slot"] - first, r["a"], r["b"]) for r in encounters.pairs(frame, reach, 60, 2.0).collect()]
        want = encounters_by_brute_force(rows, reach)
        assert len(got) == len(set(got)) and set(got) == want and want
    with pytest.raises(ValueError):
        encounters.pairs(frame, tile_deg=0.7)


def test_two_ships_on_opposite_courses_come_close(spark):
    rows = [(1, "2024-12-01 00:00:00", 70.0, 10.0, 10.0, 90.0), (2, "2024-12-01 00:00:00", 70.0, 10.1, 10.0, 270.0)]
    frame = spark.createDataFrame(rows, "mmsi long, ts string, lat double, lon double, sog double, cog double").withColumn("ts", F.col("ts").cast("timestamp"))
    r = encounters.pairs(frame, 10.0).first()
    km = 0.1 * 111.32 * math.cos(math.radians(70))
    assert math.isclose(r["km"], km, rel_tol=1e-9) and abs(r["closest_km"]) < 1e-6 and math.isclose(r["hours"], km / 37.04, rel_tol=1e-6)
    assert encounters.interaction(encounters.pairs(frame, 10.0), 5.0, 0.5).first()["worst"] > 0.999
    assert encounters.pairs(frame.filter("false")).count() == 0


def test_encounters_take_speeds_apart_once_a_vessel(spark):
    frame = spark.createDataFrame([(1, "2024-12-01 00:00:00", 70.0, 10.0, 10.0, 90.0)], "mmsi long, ts string, lat double, lon double, sog double, cog double").selectExpr("mmsi", "to_timestamp(ts) as ts", "lat", "lon", "sog", "cog")
    plan = encounters.pairs(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "SIN(" in plan and "SIN(" not in plan.split("Join")[0]


@pytest.mark.parametrize(("few", "chunks"), [(1024, (64, 128)), (3, (4, 8))])
def test_interaction_of_all_equals_that_of_pairs(spark, monkeypatch, few, chunks):
    monkeypatch.setattr(encounters, "PACK", 45)
    monkeypatch.setattr(encounters, "FEW_CELLS", few)
    monkeypatch.setattr(encounters, "CHUNKS", chunks)
    rng = np.random.default_rng(12)
    places = [(float(rng.uniform(-89.9, 89.9)), float(rng.uniform(-180, 180))) for _ in range(200)]
    places += [(70 + float(rng.normal()) * 0.2, 20 + float(rng.normal()) * 0.3) for _ in range(150)]  # a crowd
    places += [(75 + float(rng.normal()) * 0.2, (180 + float(rng.normal()) * 0.5 + 180) % 360 - 180) for _ in range(60)]  # the date line
    places += [(89.5 + float(rng.uniform(0, 0.5)), float(rng.uniform(-180, 180))) for _ in range(40)] + [(-88.0, float(x)) for x in range(-170, 180, 20)]  # the poles
    places += [(70.0, 20.0), (70.0, 20.0), (60.0, 180.0), (60.0, -180.0), (0.1, 0.1), (-0.1, -0.1)]
    stamped = [(k, f"2024-01-01 0{k % 2}:05:00", lat, lon, float(k % 7), float(k * 37 % 360)) for k, (lat, lon) in enumerate(places)]
    frame = spark.createDataFrame(stamped, "mmsi long, ts string, lat double, lon double, sog double, cog double").withColumn("ts", F.col("ts").cast("timestamp"))
    for reach, near, cell in ((60.0, 20.0, 0.5), (300.0, 300.0, 4.0), (900.0, 1000.0, 7.0)):
        rows = lambda d: {(r["ci"], r["cj"]): (r["risk"], r["worst"], r["pairs"]) for r in d.collect()}
        got, want = rows(encounters.interaction_of_all(frame, reach, 60, near, cell)), rows(encounters.interaction(encounters.pairs(frame, reach, 60, 2.0), near, cell))
        assert got.keys() == want.keys() and want
        assert all(got[k][2] == want[k][2] and np.allclose(got[k][:2], want[k][:2], rtol=0, atol=1e-9) for k in want)
    assert encounters.interaction_of_all(frame.filter("false"), 60.0, 60, 20.0, 0.5).count() == 0


def _most_rows(spark, work):
    """The most rows that an operator of the queries of ``work`` hands on."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    work()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs, most = store.executionsList(), 0
    for k in range(seen, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(n) for n in range(nodes.size())):
            for metric in (node.metrics().apply(n) for n in range(node.metrics().size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_pairs_of_a41_are_no_rows(spark, tmp_path):
    from icewake import registry

    events = spark.range(3000).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "id % 19 * 1e0 AS value", "'' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = []
    most = _most_rows(spark, lambda: found.extend(registry.queries()["a41_encounters"](spark, str(tmp_path)).collect()))
    assert sum(r["pairs"] for r in found) > 100_000 and 3000 <= most < 10_000
