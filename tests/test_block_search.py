"""Search over blocks against the search in one group, and against plain relaxation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from icewake.operators import block_search, search


def route_cost(rows):
    rows = sorted(rows, key=lambda r: r["seq"])
    return sum(np.hypot(b["i"] - a["i"], b["j"] - a["j"]) * b["step_cost"] for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("size", [5, 64])
def test_blocks_find_the_costs_of_the_search_in_one_group(spark, size):
    rng = np.random.default_rng(3)
    fields, runs = [], []
    for name, wall in (("open", 0.0), ("maze", 0.35), ("ridge", 0.1)):
        cost = 1 + 9 * rng.random((17, 23)) ** 3
        cost[rng.random(cost.shape) < wall] = np.inf
        if name == "ridge":
            cost[:, 11] = np.inf
            cost[16, 11] = 1.0  # the only way through
        cost[0, 0] = cost[16, 22] = 1.0
        fields += [(name, i, j, float(cost[i, j]) if np.isfinite(cost[i, j]) else None) for i in range(17) for j in range(23)]
        runs.append((name, 0, 0, 16, 22))
    fields += [("shut", 0, 0, 1.0), ("shut", 0, 5, 1.0), ("land", 0, 0, 1.0), ("self", 3, 3, 2.0), ("odd", 0, 0, 1.0), ("odd", 0, 1, float("nan")), ("odd", 0, 2, 1.0)]
    runs += [("shut", 0, 0, 0, 5), ("land", 0, 0, 4, 4), ("self", 3, 3, 3, 3), ("none", 0, 0, 1, 1), ("unsnapped", None, None, 1, 1), ("odd", 0, 0, 0, 2)]
    frame = spark.createDataFrame(fields, "run_id string, i long, j long, cost double")
    asked = spark.createDataFrame(runs, "run_id string, start_i long, start_j long, goal_i long, goal_j long")
    got = block_search.search_blocks(frame, asked, size).collect()
    want = search.search_routes(frame.filter("not isnan(cost)"), asked).collect()
    for name in {r[0] for r in runs}:
        own, other = ([r for r in rows if r["run_id"] == name] for rows in (got, want))
        assert {r["reason"] for r in own} == {r["reason"] for r in other}, name
        if own[0]["seq"] >= 0:
            assert route_cost(own) == pytest.approx(route_cost(other), rel=1e-12) == pytest.approx(own[0]["distance"], rel=1e-12)
            cells = [(r["i"], r["j"]) for r in sorted(own, key=lambda r: r["seq"])]
            assert cells[0] == runs[[r[0] for r in runs].index(name)][1:3] and all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(cells, cells[1:], strict=False))
            assert [r["seq"] for r in sorted(own, key=lambda r: r["seq"])] == list(range(len(own)))


def test_no_runs_and_a_grid_of_many_blocks(spark):
    cells = spark.range(60 * 200).select(F.lit("r").alias("run_id"), F.expr("id div 200").alias("i"), (F.col("id") % 200).alias("j"), F.lit(1.0).alias("cost"))
    cells = cells.filter("j % 20 <> 10 or (i = case when j % 40 = 10 then 0 else 59 end)")  # walls with gaps at alternate ends
    run = spark.createDataFrame([("r", 30, 0, 30, 199)], "run_id string, start_i long, start_j long, goal_i long, goal_j long")
    got = block_search.search_blocks(cells, run, 32).collect()
    want = search.search_routes(cells, run).collect()
    assert route_cost(got) == pytest.approx(route_cost(want), rel=1e-12) and len(got) > 500
    assert block_search.search_blocks(cells, run.filter("false"), 32).count() == 0


def test_nearest_cells_equal_brute_force_near_and_far(spark, monkeypatch):
    from icewake.operators import alignment

    monkeypatch.setattr(alignment, "FEW", 3)
    rng = np.random.default_rng(12)
    spots = [(float(a), float(b)) for a, b in zip(rng.uniform(65, 80, 300), rng.uniform(0, 160, 300), strict=True)]
    spots += [(72.0 + float(x) * 1e-4, 40.0 + float(y) * 1e-4) for x, y in rng.integers(0, 9, (200, 2))]  # crowded, with repeated places
    spots += [(-60.0, -170.0), (-60.0, -170.0)]
    cells = [(k // 20, k % 20, *s) for k, s in enumerate(spots)] + [(99, 0, None, 1.0), (99, 1, float("nan"), 1.0)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-89, 89, 150), rng.uniform(-180, 180, 150), strict=True))]
    points += [(1000 + k, 72.0 + float(x) * 1e-4, 40.0) for k, x in enumerate(rng.uniform(-1, 10, 40))] + [(2000, 72.0, 40.0)]
    asked = spark.createDataFrame([*points, (3000, None, 1.0), (3001, float("nan"), 1.0)], "point_id long, lat double, lon double")
    grid = spark.createDataFrame(cells, "i long, j long, lat double, lon double")
    got = {r["point_id"]: (r["i"], r["j"]) for r in alignment.nearest_cells(asked, grid).collect()}
    want = {p: min(((c[2] - lat) * (c[2] - lat) + (c[3] - lon) * (c[3] - lon), c[0], c[1]) for c in cells[:-2])[1:] for p, lat, lon in points}
    assert got == want
    assert alignment.nearest_cells(asked, grid.filter("i = 99")).count() == 0
    one = alignment.nearest_cells(asked, grid.filter("i = 0 and j = 0"))
    assert one.count() == len(points) and one.select("i", "j").distinct().count() == 1


def _shuffled_bytes(spark, work):
    """Bytes that the stages of ``work`` write for shuffles."""
    store = spark._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (seen.apply(k) for k in range(seen.size()))}
    read = lambda: store.stageList(None, False, False, spark._jvm.scala.Array.emptyDoubleArray(), None)
    seen = read()
    before = stages()
    work()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    seen = read()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("index", [0, 1 << 16])
def test_nearest_cells_by_chunks_and_by_one_index_equal_brute_force(spark, monkeypatch, index):
    from icewake.operators import alignment

    monkeypatch.setattr(alignment, "INDEX", index or 50)  # 50: chunks of a few partitions
    monkeypatch.setattr(alignment, "CHUNK", 16)
    monkeypatch.setattr(alignment, "PART", 64)
    rng = np.random.default_rng(5)
    spots = [(float(a), float(b)) for a, b in zip(rng.uniform(65, 80, 250), rng.uniform(0, 160, 250), strict=True)]
    spots += [(70.0 + x, 20.0 + y) for x in range(6) for y in range(6)]  # ties
    spots += [(70.0, 20.0), (1e200, -1e200), (-60.0, 175.0)]
    cells = [(k // 7, k % 7, *s) for k, s in enumerate(spots)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-89, 89, 200), rng.uniform(-180, 180, 200), strict=True))]
    points += [(1000 + k, 70.0 + k % 12 / 2, 20.0 + k // 12 / 2) for k in range(144)] + [(5000 + k, 72.0, 40.0) for k in range(200)]
    asked = spark.createDataFrame(points, "point_id long, lat double, lon double").repartition(3)
    got = {r["point_id"]: (r["i"], r["j"]) for r in alignment.nearest_cells(asked, spark.createDataFrame(cells, "i long, j long, lat double, lon double")).collect()}
    assert got == {p: min(((c[2] - lat) * (c[2] - lat) + (c[3] - lon) * (c[3] - lon), c[0], c[1]) for c in cells)[1:] for p, lat, lon in points}


def test_points_are_not_shuffled_for_a_small_grid(spark):
    from icewake.operators import alignment

    cells = spark.range(900).select(F.expr("id div 30").alias("i"), (F.col("id") % 30).alias("j"), (F.expr("id div 30") * 0.5).alias("lat"), (F.col("id") % 30 * 5.0).alias("lon"))
    sizes = []
    for n in (2000, 40000):
        points = spark.range(n).select(F.col("id").alias("point_id"), (F.col("id") * 7919 % 17001 / 1000).alias("lat"), (F.col("id") * 104729 % 164001 / 1000).alias("lon"))
        sizes.append(_shuffled_bytes(spark, lambda points=points: alignment.nearest_cells(points, cells).write.format("noop").mode("overwrite").save()))
    assert sizes[1] < 2 * sizes[0] + 10000


def test_a_python_worker_holds_few_blocks_at_once(spark, monkeypatch):
    seen, step = [], block_search._step
    monkeypatch.setattr(block_search, "_step", lambda heard, size: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or step(heard, size))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    cells = spark.range(900).select(F.lit("r").alias("run_id"), F.expr("id div 30").alias("i"), (F.col("id") % 30).alias("j"), F.lit(1.0).alias("cost"))
    run = spark.createDataFrame([("r", 0, 0, 29, 29)], "run_id string, start_i long, start_j long, goal_i long, goal_j long")
    assert block_search.search_blocks(cells, run, 8).count() == 30
    assert seen and all(int(n) <= 64 for n in seen)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
