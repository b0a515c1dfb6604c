"""Least-cost routes over the cells of a grid.

A route search is sequential, so one run (one cost field, start and goal) is one group of
``applyInPandas``; runs spread over the cluster.  A group holds only the passable cells of its run, and
a grid bounds those, whatever the number of runs or points.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
ROUTE = "run_id string, seq int, i long, j long, step_cost double, reason string"


def least_cost_path(cost: dict[tuple[int, int], float], start: tuple[int, int], goal: tuple[int, int], diagonal: bool = True, most: int | None = None) -> tuple[list[tuple[int, int]], str]:
    """Cells of the cheapest path and an empty reason, or no cells and why.

    Entering a cell costs its value times the step length; the straight-line index distance is a lower
    bound as values are 1 or more.  Of equal bounds the cell first in row order is looked at first.
    """
    if start not in cost:
        return [], "start_blocked"
    if goal not in cost:
        return [], "goal_blocked"
    steps = [(di, dj, math.hypot(di, dj)) for di, dj in _STEPS if diagonal or not (di and dj)]
    paid, came, settled = {start: 0.0}, {start: start}, set()
    waiting, looked = [(0.0, start)], 0
    while waiting:
        _, cell = heapq.heappop(waiting)
        if cell in settled:
            continue
        looked += 1
        if most is not None and looked > most:
            return [], "max_expansions_reached"
        if cell == goal:
            path = [cell]
            while path[-1] != start:
                path.append(came[path[-1]])
            return path[::-1], ""
        settled.add(cell)
        for di, dj, length in steps:
            near = (cell[0] + di, cell[1] + dj)
            value = cost.get(near)
            if value is None or near in settled:
                continue
            total = paid[cell] + length * value
            if total < paid.get(near, math.inf):
                paid[near], came[near] = total, cell
                heapq.heappush(waiting, (total + math.hypot(near[0] - goal[0], near[1] - goal[1]), near))
    return [], "no_path"


def _search(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[0]
    cells = group[group["cost"].notna() & np.isfinite(group["cost"])]
    cost = dict(zip(zip(cells["i"].tolist(), cells["j"].tolist()), cells["cost"].tolist()))
    if pd.isna(first["start_i"]) or pd.isna(first["goal_i"]):
        path, why = [], "no_ocean_start" if pd.isna(first["start_i"]) else "no_ocean_goal"
    else:
        path, why = least_cost_path(cost, (int(first["start_i"]), int(first["start_j"])), (int(first["goal_i"]), int(first["goal_j"])), most=None if pd.isna(first["most"]) else int(first["most"]))
    if not path:
        return pd.DataFrame([(first["run_id"], -1, None, None, None, why)], columns=[c.split()[0] for c in ROUTE.split(", ")])
    return pd.DataFrame({"run_id": first["run_id"], "seq": range(len(path)), "i": [c[0] for c in path], "j": [c[1] for c in path], "step_cost": [cost[c] for c in path], "reason": ""})


def search_routes(fields: DataFrame, runs: DataFrame) -> DataFrame:
    """Routes of ``runs`` (run_id, start_i, start_j, goal_i, goal_j) over ``fields`` (run_id, i, j, cost).

    A row per step; a run without a route is one row with seq -1 and the reason.  A run that gives ``most``
    looks at no more cells than that.
    """
    cells = fields.filter("cost is not null").select("run_id", "i", "j", "cost")
    runs = runs if "most" in runs.columns else runs.withColumn("most", F.lit(None).cast("long"))
    both = runs.join(cells, "run_id", "left").select("run_id", "i", "j", "cost", "start_i", "start_j", "goal_i", "goal_j", "most")
    return both.groupBy("run_id").applyInPandas(_search, ROUTE)


def path_changes(routes: DataFrame, baseline: str) -> DataFrame:
    """Whether each run's cells differ from those of the baseline run."""
    paths = routes.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "i", "j"))), lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"))).alias("path"))
    base = paths.filter(F.col("run_id") == baseline).select(F.col("path").alias("base"))  # one row
    return paths.crossJoin(F.broadcast(base)).select("run_id", (F.to_json("path") != F.to_json("base")).alias("path_changed"))
