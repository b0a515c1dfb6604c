"""Least-cost search over grids of any size: blocks of cells exchange the distances of their borders.

A run's grid is cut into square blocks, a row each.  In a round, every block that has heard of nearer border cells
around it finds exact distances inside, by relaxing all its cells at once until nothing changes, and tells its neighbours
which of its border cells came nearer.  What cannot beat the goal's distance so far is not told.  Rounds
end when nobody has news; then distances are exact, and routes are walked back from the goal, a block at a time.
All runs go on together and every round is one job over the blocks, written to the shared folder.

Entering a cell costs its value times the step length, as in ``search``.  Cells without a finite positive cost are not
passable.  Of steps that are equally good the first in row order is taken back from the goal.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..sources.scratch import Written

BATCH = 64  # blocks that a Python worker is given at once
_STEPS = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj]
_NEWS = "array<struct<bi:long,bj:long,i:long,j:long,d:double>>"
_STATE = f"run_id string, bi long, bj long, cost binary, dist binary, news {_NEWS}"
_ARROW_NEWS = pa.list_(pa.struct([("bi", pa.int64()), ("bj", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())]))


def relaxed(dist: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Distances inside a frame of known ones: each cell's least neighbour plus its own step, until nothing changes."""
    n = len(dist) - 2
    inner = cost[1:-1, 1:-1]
    steps = [(di, dj, np.hypot(di, dj) * inner) for di, dj in _STEPS]
    dist = dist.copy()
    while True:
        best = dist[1:-1, 1:-1].copy()
        for di, dj, step in steps:
            np.minimum(best, dist[1 + di : 1 + di + n, 1 + dj : 1 + dj + n] + step, out=best)
        if (best == dist[1:-1, 1:-1]).all():
            return dist
        dist[1:-1, 1:-1] = best


def _frame(cell: bytes, size: int) -> np.ndarray:
    return np.frombuffer(cell, dtype="<f8").reshape(size + 2, size + 2)


def _blocks(cells: DataFrame, size: int) -> DataFrame:
    """A row for each block that has cells: their costs in a frame one cell wider, distances unknown."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    grouped = cells.groupBy("run_id", at("i").alias("bi"), at("j").alias("bj")).agg(F.collect_list(F.struct("i", "j", "cost")).alias("cells"))  # size ** 2 at most

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = np.full((size + 2, size + 2), np.inf).tobytes()
        for b in batches:
            costs = []
            for k, (bi, bj) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                i, j, cost = (x.to_numpy(zero_copy_only=False) for x in b.column(3).slice(k, 1).flatten().flatten())
                frame = np.full((size + 2, size + 2), np.inf)
                frame[i - bi * size + 1, j - bj * size + 1] = cost
                costs.append(frame.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(costs, pa.binary()), pa.array([unknown] * len(costs), pa.binary()), pa.array([[]] * len(costs), _ARROW_NEWS)], names=["run_id", "bi", "bj", "cost", "dist", "news"])

    return grouped.mapInArrow(frames, _STATE)


def _step(heard: DataFrame, size: int) -> DataFrame:
    """Blocks after a round; ``heard`` are blocks with their inbox, the goal's cell and its distance so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, dists, news = b.to_pylist(), [], []
            for r in rows:
                told = []
                if r["inbox"]:
                    bi, bj, old, cost = r["bi"], r["bj"], _frame(r["dist"], size), _frame(r["cost"], size)
                    dist = old.copy()
                    for x in r["inbox"]:
                        k = x["i"] - bi * size + 1, x["j"] - bj * size + 1
                        dist[k] = min(dist[k], x["d"])
                    dist = relaxed(dist, cost)
                    bound = np.inf if r["best"] is None else r["best"]
                    edge = np.zeros(dist.shape, dtype=bool)
                    edge[[1, -2], 1:-1] = edge[1:-1, [1, -2]] = True
                    for a, c in zip(*np.nonzero(edge & (dist < old)), strict=True):
                        i, j, d = bi * size + int(a) - 1, bj * size + int(c) - 1, float(dist[a, c])
                        if d + np.hypot(i - r["goal_i"], j - r["goal_j"]) * r["least"] <= bound * (1 + 1e-12):
                            told += [{"bi": n, "bj": m, "i": i, "j": j, "d": d} for n, m in {((i + di) // size, (j + dj) // size) for di, dj in _STEPS} - {(bi, bj)}]
                    r["dist"] = dist.tobytes()
                dists.append(r["dist"])
                news.append(told)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("run_id", "bi", "bj", "cost")), pa.array(dists, pa.binary()), pa.array(news, _ARROW_NEWS)], names=["run_id", "bi", "bj", "cost", "dist", "news"])

    return heard.mapInArrow(run, _STATE)


def _goal_distances(states: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """run_id and the distance of its goal, if that is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [_frame(r["dist"], size)[r["goal_i"] - r["bi"] * size + 1, r["goal_j"] - r["bj"] * size + 1] for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.float64())], names=["run_id", "best"])

    own = states.join(runs.select("run_id", "goal_i", "goal_j", F.floor(F.col("goal_i") / size).alias("bi"), F.floor(F.col("goal_j") / size).alias("bj")), ["run_id", "bi", "bj"])
    return own.select("run_id", "bi", "bj", "goal_i", "goal_j", "dist").mapInArrow(run, "run_id string, best double").filter("best < double('inf')")


def _settled(cells: DataFrame, runs: DataFrame, size: int) -> Written:
    """Blocks whose distances from the start of their run are exact, as far as they matter for its goal."""
    runs = runs.join(cells.groupBy("run_id").agg(F.min("cost").alias("least")), "run_id")
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    state = Written(_blocks(cells, size), "blocks")
    inbox = runs.select("run_id", at("start_i").alias("bi"), at("start_j").alias("bj"), F.array(F.struct(F.col("start_i").alias("i"), F.col("start_j").alias("j"), F.lit(0.0).alias("d"))).alias("inbox"))
    while True:
        best = _goal_distances(state.table, runs, size)
        goals = runs.select("run_id", "goal_i", "goal_j", "least").join(best, "run_id", "left")
        heard = state.table.join(inbox, ["run_id", "bi", "bj"], "left").join(goals, "run_id")
        after = Written(_step(heard.select("run_id", "bi", "bj", "cost", "dist", "inbox", "goal_i", "goal_j", "least", "best"), size), "blocks")
        state.drop()
        state = after
        told = state.table.select("run_id", F.explode("news").alias("x")).select("run_id", "x.*")
        if told.isEmpty():
            return state
        inbox = told.groupBy("run_id", "bi", "bj").agg(F.collect_list(F.struct("i", "j", "d")).alias("inbox"))  # border cells of eight neighbours


def _walked(at: DataFrame, size: int) -> DataFrame:
    """Cells from (i, j) back to the start or out of the block, and the cell before them."""
    walk = "run_id string, cells array<struct<i:long,j:long,cost:double>>, i long, j long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                dist, cost, cells = _frame(r["dist"], size), _frame(r["cost"], size), []
                a, c = r["i"] - r["bi"] * size + 1, r["j"] - r["bj"] * size + 1
                while 1 <= a <= size and 1 <= c <= size:
                    i, j = r["bi"] * size + a - 1, r["bj"] * size + c - 1
                    cells.append({"i": i, "j": j, "cost": float(cost[a, c])})
                    if (i, j) == (r["start_i"], r["start_j"]):
                        break
                    a, c = next((a + di, c + dj) for di, dj in _STEPS if dist[a + di, c + dj] + np.hypot(di, dj) * cost[a, c] == dist[a, c])
                done = (i, j) == (r["start_i"], r["start_j"])
                out.append({"run_id": r["run_id"], "cells": cells, "i": None if done else r["bi"] * size + a - 1, "j": None if done else r["bj"] * size + c - 1})
            kind = pa.schema([("run_id", pa.string()), ("cells", pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64()), ("cost", pa.float64())]))), ("i", pa.int64()), ("j", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return at.select("run_id", "bi", "bj", "i", "j", "start_i", "start_j", "cost", "dist").mapInArrow(run, walk)


@contextmanager
def few_blocks(spark: SparkSession) -> Iterator[None]:
    """Python workers hold ``BATCH`` blocks at once, however many a task has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def search_blocks(fields: DataFrame, runs: DataFrame, size: int = 64) -> DataFrame:
    """Routes of ``runs`` (run_id, start_i, start_j, goal_i, goal_j) over ``fields`` (run_id, i, j, cost), as ``search_routes`` has them.

    run_id, seq, i, j, step_cost, distance, reason: a row per step, ``distance`` is that of the goal; a run without a route is one row
    with seq -1 and why.
    """
    runs = runs.select(F.col("run_id").cast("string"), *(F.col(c).cast("long") for c in ("start_i", "start_j", "goal_i", "goal_j")))
    cells = fields.select(F.col("run_id").cast("string"), F.col("i").cast("long"), F.col("j").cast("long"), finite("cost").alias("cost")).filter("cost > 0")
    passable = Written(cells, "cells")
    ends = [passable.table.select("run_id", F.col("i").alias(f"{e}_i"), F.col("j").alias(f"{e}_j"), F.lit(True).alias(f"{e}_open")) for e in ("start", "goal")]
    known = reduce(lambda r, e: r.join(e, e.columns[:3], "left"), ends, runs)
    why = F.when(F.col("start_i").isNull(), "no_ocean_start").when(F.col("goal_i").isNull(), "no_ocean_goal").when(F.col("start_open").isNull(), "start_blocked").when(F.col("goal_open").isNull(), "goal_blocked")
    judged = Written(known.withColumn("why", why), "runs")  # a row a run
    able = judged.table.filter("why is null").drop("why")
    with few_blocks(fields.sparkSession):
        state = _settled(passable.table, able, size)
    passable.drop()
    parts, hop = [], 0
    with few_blocks(fields.sparkSession):
        best = Written(_goal_distances(state.table, able, size), "goals")
        at = best.table.join(able, "run_id").select("run_id", F.col("goal_i").alias("i"), F.col("goal_j").alias("j"))
        while not at.isEmpty():
            placed = at.withColumns({"bi": F.floor(F.col("i") / size).cast("long"), "bj": F.floor(F.col("j") / size).cast("long")}).join(able.select("run_id", "start_i", "start_j"), "run_id")
            part = Written(_walked(placed.join(state.table.select("run_id", "bi", "bj", "cost", "dist"), ["run_id", "bi", "bj"]), size), "walk")
            parts.append(part.table.select("run_id", F.lit(hop).alias("hop"), F.posexplode("cells").alias("k", "x")))
            at, hop = part.table.filter("i is not null").select("run_id", "i", "j"), hop + 1
    failed = judged.table.join(best.table, "run_id", "left").filter("best is null").select("run_id", F.lit(-1).alias("seq"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("step_cost"), F.lit(None).cast("double").alias("distance"), F.coalesce("why", F.lit("no_path")).alias("reason"))
    if not parts:
        return failed
    steps = reduce(DataFrame.union, parts)
    order = Window.partitionBy("run_id").orderBy(F.desc("hop"), F.desc("k"))  # the cells of one route
    found = steps.withColumn("seq", F.row_number().over(order) - 1).join(best.table, "run_id")
    return found.select("run_id", "seq", "x.i", "x.j", F.col("x.cost").alias("step_cost"), F.col("best").alias("distance"), F.lit("").alias("reason")).unionByName(failed)
