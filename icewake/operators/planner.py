"""Whole plans: a request becomes a route for each profile, with its costs, emissions, scores and the recommended one.

Requests and profiles are parameter lists; cells may be many.  The cost of a run comes from the layers, or from latitude where the
layers cannot carry it, and the rows say which and why.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.geo import clip, haversine_km
from ..functions.numbers import finite
from ..sources.scratch import Written
from . import block_search, routes
from .alignment import nearest_ocean_anywhere
from .fleet import every_pair
from .planning import PROFILES, Profile
from .selection import quantiles

REQUEST = """request string, start_lat double, start_lon double, end_lat double, end_lon double, use_layers boolean, wave_penalty double, w_model double,
w_corridor double, w_congestion double, design_speed_kn double, base_fuel_per_km double, max_ice_m double, ice_margin double"""
LAYERS = ("sic", "wave", "thick", "risk", "uncertainty", "density")
COMPONENTS = ("base_distance", "ice_risk", "wave_risk", "model_risk", "model_uncertainty", "ice_class_soft", "ais_corridor", "ais_congestion")
ICE_PENALTY = 4.0  # before a profile's factor
PLACES = 9  # decimals to which measures are scored, so that the order of a sum does not decide between equal ones


def layer_reason(cells: DataFrame) -> str:
    """Why cost cannot come from the layers: '' (it can), no_ice_layer or no_layers; one aggregated row tells (C20)."""
    at = {c: finite(c) if c in cells.columns else F.lit(None).cast("double") for c in ("sic", "wave")}
    seen = cells.agg(*(F.count(c).alias(n) for n, c in at.items())).first()
    return "" if seen["sic"] else "no_ice_layer" if seen["wave"] else "no_layers"


def placed_layers(cells: DataFrame, mask: DataFrame | None, layers: dict[str, DataFrame | None]) -> tuple[DataFrame, str]:
    """``cells`` (i, j, lat, lon) with is_land and a column for each layer, and why the layers are no use (C20): '' if they are.

    ``mask`` has i, j, is_land, a layer i, j, value; None is one that there is not.  Layers of another shape than the grid
    are not laid upon it (shape_mismatch) and stay NULL.  Without a mask, or where it has no cell, all is ocean (no_mask).  A cell that a layer
    lacks is NULL; where a layer has a cell twice the smallest value counts.  An empty grid has the shape of no layer.
    """
    shape = lambda f: tuple(f.agg(F.max("i") + 1, F.max("j") + 1).first())  # noqa: E731  one row
    whole = shape(cells)
    given = {n: x for n, x in layers.items() if x is not None}
    fits = all(shape(x) == whole for n, x in given.items() if n in ("sic", "wave"))
    rows = cells.select("i", "j", "lat", "lon")
    if mask is not None:
        rows = rows.join(mask.groupBy("i", "j").agg(F.max("is_land").alias("is_land")), ["i", "j"], "left")
    rows = rows.withColumn("is_land", F.coalesce("is_land" if mask is not None else F.lit(False), F.lit(False)))
    for name in layers:
        if name in given and fits:
            rows = rows.join(given[name].groupBy("i", "j").agg(F.min(finite("value")).alias(name)), ["i", "j"], "left")
        else:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    reason = "no_mask" if mask is None else "shape_mismatch" if not fits else layer_reason(rows)
    return rows, reason


def run_list(requests: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """Every request under every profile, with the weights that result; ``place`` is the profile's place in the list."""
    rows = [(p.key, k, p.ice, p.wave, p.risk, p.uncertainty) for k, p in enumerate(profiles)]
    modes = requests.sparkSession.createDataFrame(rows, "mode string, place int, f_ice double, f_wave double, f_risk double, f_unc double")
    zero = F.lit(0.0)
    part = lambda c: F.coalesce(finite(c), zero)
    return every_pair(requests, modes).select(
        F.concat_ws("/", "request", "mode").alias("run_id"), "request", "mode", "place", F.coalesce("use_layers", F.lit(False)).alias("use_layers"), "start_lat", "start_lon", "end_lat", "end_lon",
        (ICE_PENALTY * F.col("f_ice")).alias("ice_penalty"), (part("wave_penalty") * F.col("f_wave")).alias("wave_weight"), (part("w_model") * F.col("f_risk")).alias("model_weight"),
        F.when(part("w_model") > 0, F.col("f_unc")).otherwise(0.0).alias("uncertainty_weight"), part("w_corridor").alias("corridor_weight"), part("w_congestion").alias("congestion_weight"),
        part("design_speed_kn").alias("speed_kn"), part("base_fuel_per_km").alias("fuel_per_km"), risk.usable_thickness(part("max_ice_m"), part("ice_margin")).alias("limit_m"),
    )


def run_fields(cells: DataFrame, runs: DataFrame, reason: str | None = None) -> DataFrame:
    """Cost and components of every cell for every run of ``run_list`` (G04); ``source`` and ``reason`` tell where they come from.

    A layer that is missing adds nothing.  A run that wants layers which cannot carry a cost (``reason``, by default that of
    ``layer_reason``) has the cost of the latitude belt, as one that wants none; it knows no waves, model or ice class.  Land, and under
    layers ice too thick for the vessel, has no cost.
    """
    layers = [(finite(c) if c in cells.columns else F.lit(None).cast("double")).alias(c) for c in LAYERS]
    known = cells.select("i", "j", "lat", "lon", F.coalesce("is_land", F.lit(False)).alias("is_land"), *layers)
    reason = layer_reason(known) if reason is None else reason
    crowded = quantiles(known.filter("not is_land"), "density", [0.9])[0]
    zero, dense = F.lit(0.0), F.coalesce("density", F.lit(0.0))
    traffic = crowded is not None
    asked = runs.select("run_id", "use_layers", "ice_penalty", "wave_weight", "model_weight", "uncertainty_weight", "corridor_weight", "congestion_weight", "limit_m")
    real = F.col("use_layers") & F.lit(reason == "")
    only = lambda x: F.when(real, F.coalesce(x, zero)).otherwise(0.0)
    rows = every_pair(known, asked).withColumns({
        "base_distance": F.when(~F.col("is_land"), 1.0),
        "ice_risk": F.col("ice_penalty") * F.when(real, F.coalesce(risk.ice_risk(F.col("sic"), 1.0), zero)).otherwise(risk.demo_ice_risk(F.col("lat"), F.col("is_land"), 1.0)),
        "wave_risk": only(F.col("wave_weight") * risk.wave_risk(F.col("wave"))),
        "model_risk": only(F.col("model_weight") * F.col("risk")),
        "model_uncertainty": only(F.col("uncertainty_weight") * clip(F.col("uncertainty"), 0.0, 1.0)),
        "ice_class_soft": only(risk.soft_ice(F.col("thick"), F.col("limit_m"))),
        "ais_corridor": F.col("corridor_weight") * risk.corridor(dense, 1.0) if traffic else zero,
        "ais_congestion": F.col("congestion_weight") * risk.congestion(dense, F.lit(crowded), 1.0) if traffic else zero,
        "source": F.when(real, "layers").otherwise("belt"),
        "reason": F.when(F.col("use_layers"), F.lit(reason)).otherwise(""),
    })
    shut = F.col("is_land") | (real & risk.hard_ice(F.col("thick"), F.col("limit_m")))
    cost = F.when(~shut, reduce(lambda a, b: a + b, (F.col(c) for c in COMPONENTS)))
    return rows.select("run_id", "i", "j", "lat", "lon", "is_land", "uncertainty", *COMPONENTS, "source", "reason", cost.alias("cost"))


def with_ends(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """Runs with the ocean cells nearest to both ends, however far; NULL without a position or an ocean."""
    once = runs.dropDuplicates(["request"])
    points = reduce(DataFrame.union, (once.select(F.struct("request", F.lit(e).alias("end")).alias("point_id"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for e in ("start", "end")))
    at = nearest_ocean_anywhere(points, cells).select("point_id.request", "point_id.end", "i", "j")
    of = lambda end, to: [F.max(F.when(F.col("end") == end, F.col(c))).alias(f"{to}_{c}") for c in ("i", "j")]
    return runs.join(at.groupBy("request").agg(*of("start", "start"), *of("end", "goal")), "request", "left")


def plan(cells: DataFrame, requests: DataFrame, weights: tuple[float, float, float] = (0.33, 0.33, 0.34), profiles: tuple[Profile, ...] = PROFILES, reason: str | None = None, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """Plans of ``requests`` (columns REQUEST, one row each): a table with a row for each request and profile, and the steps of all routes.

    ``weights`` are those of model risk, uncertainty and fuel in the score; each measure lies between the extremes of its request, 0
    where they are alike.  The lowest score is recommended, the earlier profile on a tie.  A run without a route stays, with
    reachable false, why in ``search``, zeros for what it would have met and no length; scoring counts it as zero.  Without requests there are no rows.
    """
    runs = Written(run_list(requests, profiles), "runs")
    fields = Written(run_fields(cells, runs.table, reason), "run_fields")
    ends = with_ends(runs.table, cells)
    found = block_search.search_blocks(fields.table.select("run_id", "i", "j", "cost"), ends.select("run_id", "start_i", "start_j", "goal_i", "goal_j"), size)
    steps = Written(found.withColumnRenamed("reason", "search").join(fields.table, ["run_id", "i", "j"], "left"), "route_steps")
    told = fields.table.groupBy("run_id").agg(F.first("source").alias("source"), F.first("reason").alias("reason"))
    rows = scored(runs.table.join(told, "run_id", "left").join(measures(steps.table), "run_id", "left"), weights)
    out = Written(rows, "plans")
    runs.drop()
    fields.drop()
    return out.table, steps.table


def measures(steps: DataFrame) -> DataFrame:
    """One row a run: what its route met, in sums over all its steps, and its length."""
    w = Window.partitionBy("run_id").orderBy(F.desc("seq"))  # sums go from the goal to the start, as in the SQL: totals at half a digit are rounded by it
    leg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    zero, u = F.lit(0.0), clip(finite("uncertainty"), 0.0, 1.0)
    sums = [F.coalesce(F.sum(c), zero).alias(c) for c in COMPONENTS]
    return steps.withColumn("leg", leg).groupBy("run_id").agg(
        F.max("search").alias("search"), F.count("i").alias("steps"), F.count_if("is_land").alias("on_land"), F.coalesce(F.sum("step_cost"), zero).alias("total_cost"), F.max("distance").alias("search_cost"),
        F.sum("leg").alias("leg_km"), F.avg(u).alias("mean_uncertainty"), *sums,
    )


def scored(rows: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """Runs with length, hours, fuel, CO2, their place between the extremes of the request, score and recommendation."""
    reachable = F.coalesce(F.col("steps"), F.lit(0)) > 0
    km = F.when(reachable, F.coalesce("leg_km", F.lit(0.0)))
    rows = rows.withColumns({"reachable": reachable, "distance_km": km}).withColumns({
        "hours": F.coalesce(F.when(F.col("speed_kn") > 0, F.col("distance_km") / (F.col("speed_kn") * routes.KM_PER_NM)), F.lit(0.0)),
        "fuel": F.coalesce(F.col("distance_km") * F.col("fuel_per_km"), F.lit(0.0)),
    }).withColumn("co2", F.col("fuel") * routes.CO2_PER_FUEL)
    own = Window.partitionBy("request")  # the profiles of one request
    for name, c in (("norm_distance", "distance_km"), ("norm_fuel", "fuel"), ("norm_risk", "model_risk"), ("norm_uncertainty", "model_uncertainty")):
        x = F.round(F.coalesce(F.col(c), F.lit(0.0)), PLACES)
        low, high = F.min(x).over(own), F.max(x).over(own)
        rows = rows.withColumn(name, F.when(high > low, (x - low) / (high - low)).otherwise(0.0))
    score = weights[2] * F.col("norm_fuel") + weights[0] * F.col("norm_risk") + weights[1] * F.col("norm_uncertainty")
    rows = rows.withColumn("score", F.round(score, PLACES))
    first = F.row_number().over(own.orderBy("score", "place")) == 1
    named = ["request", "mode", "source", "reason", "reachable", "search", "steps", "on_land", "distance_km", "total_cost", "search_cost", *COMPONENTS, "mean_uncertainty", "hours", "fuel", "co2"]
    return rows.withColumn("recommended", first).select(*named, "norm_distance", "norm_fuel", "norm_risk", "norm_uncertainty", "score", "recommended")


def request_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Requests from a configuration list, in the order of REQUEST."""
    return spark.createDataFrame(rows, REQUEST)
