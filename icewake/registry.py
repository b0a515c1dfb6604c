"""Names of all queries over the domain operators, with their SQL.

A key starts with the id of the operator in the inventory.  Doubles that went through powers, logarithms,
trigonometry, percentiles or sums are rounded to six places in both texts, and only there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, risk
from .operators import cost, density, grid, modes, points, routes, search, selection
from .plans import domain_tables as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HAVERSINE = "2 * {r}e0 * atan2(sqrt(x), sqrt(1 - least(x, 1e0)))"
_LEG = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _r(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _over_cells(name: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """A query of expressions over every cell; they are made when it runs, as columns need a session."""
    _QUERIES[name] = lambda spark, d: t.cells(spark, d).select("i", "j", *(c.alias(k) for k, c in columns().items()))
    _SQL[name] = f"WITH {t.CELLS} SELECT i, j, {sql} FROM cells"


class _Layers:
    def __getitem__(self, name: str) -> Column:
        return F.col(name)


_C = _Layers()
_CLIP = "CASE WHEN {x} IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END"


def _clip(x: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return _CLIP.format(x=x, lo=lo, hi=hi)


_over_cells(
    "c02_demo_ice",
    "CASE WHEN NOT is_land AND lat >= 75 THEN 4e0 ELSE 0e0 END AS ice_risk, CASE WHEN NOT is_land THEN 1e0 END AS base_distance",
    lambda: {"ice_risk": risk.demo_ice_risk(_C["lat"], _C["is_land"]), "base_distance": F.when(~_C["is_land"], 1.0)},
)
_over_cells(
    "c03_ice_risk",
    f"round(4e0 * pow({_clip('sic')}, 15e-1), 6) AS ice_risk",
    lambda: {"ice_risk": F.round(risk.ice_risk(_C["sic"]), 6)},
)
_over_cells(
    "c04_wave_risk",
    f"round(1e0 * pow({_clip('wave', hi='10e0')} / 6e0, 2e0), 6) AS wave_risk",
    lambda: {"wave_risk": F.round(risk.wave_risk(_C["wave"]), 6)},
)
_over_cells(
    "c06_ice_class",
    "round(CASE WHEN thick > 114e-2 * 7e-1 AND thick <= 114e-2 THEN 3e0 * pow((thick - 114e-2 * 7e-1) / (114e-2 - 114e-2 * 7e-1), 2) ELSE 0e0 END, 6) AS soft, coalesce(thick > 114e-2, false) AS blocked",
    lambda: {"soft": F.round(risk.soft_ice(_C["thick"], risk.usable_thickness(F.lit(1.2), F.lit(0.95))), 6), "blocked": risk.hard_ice(_C["thick"], risk.usable_thickness(F.lit(1.2), F.lit(0.95)))},
)
_over_cells(
    "c17_uncertainty",
    f"2e0 * {_clip('wave / 5e0')} AS cost",
    lambda: {"cost": risk.uncertainty_cost(_C["wave"] / 5.0, 2.0)},
)
_over_cells(
    "c18_features",
    f"{_clip('sic')} AS f_sic, {_clip('wave / 1e1')} AS f_wave, {_clip('thick / 2e0')} AS f_thickness, {_clip('(lat - 60e0) / 25e0')} AS f_lat, {_clip('(lon + 180e0) / 360e0')} AS f_lon",
    lambda: {**risk.model_features(_C["lat"], _C["lon"], _C["sic"], _C["wave"], _C["thick"])},
)
_over_cells(
    "c23_fuel",
    "(1e-1 + 2e-2 * wave * wave) * (1 + 5e-1 * sic) AS fuel",
    lambda: {"fuel": risk.fuel_per_nm(_C["wave"], _C["sic"])},
)
_over_cells(
    "c26_piecewise",
    f"round(CASE WHEN sic IS NULL OR sic >= 75e-2 THEN 1e0 WHEN sic < 1e-1 THEN 0e0 ELSE {_clip('6e-1 * pow((sic - 1e-1) / (75e-2 - 1e-1), 15e-1)')} END, 6) AS cost",
    lambda: {"cost": F.round(risk.piecewise_ice(_C["sic"]), 6)},
)
_over_cells(
    "c29_blend",
    f"{_clip('coalesce(6e-1 * density + (1 - 6e-1) * sic, density)')} AS risk",
    lambda: {"risk": risk.risk_ice_blend(_C["density"], _C["sic"], 0.6)},
)
_over_cells(
    "c30_escort",
    f"{_clip('sic * (1 - 3e-1 * density)')} AS risk",
    lambda: {"risk": risk.escort_discount(_C["sic"], _C["density"], 0.3)},
)
_over_cells(
    "c32_corridor_discount",
    "CASE WHEN sic IS NULL THEN 0e0 ELSE greatest(0e0, sic * (1 - 4e-1 * density)) END AS cost",
    lambda: {"cost": risk.corridor_discount(_C["sic"], _C["density"], 0.4)},
)
_over_cells(
    "c33_live_blend",
    "3e-1 * wave + 7e-1 * density AS blended",
    lambda: {"blended": risk.live_blend(_C["wave"], _C["density"], 0.3)},
)
def _dirichlet_columns() -> dict[str, Column]:
    p, u = risk.dirichlet(_C["wave"], _C["density"], _C["lat"] / 40.0)
    return {f"p{k}": F.round(x, 6) for k, x in enumerate(p)} | {"u": F.round(u, 6)}


_over_cells(
    "m01_dirichlet",
    "round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2, round(3e0 / (a + b + c), 6) AS u FROM (SELECT i, j, ln(1 + exp(wave)) + 1 AS a, ln(1 + exp(density)) + 1 AS b, ln(1 + exp(lat / 40e0)) + 1 AS c FROM cells) cells --",
    lambda: _dirichlet_columns(),
)
_over_cells(
    "a45_step_fuel",
    "round(wave * (1 + 12e-1 * sic * sic + 2e-1 * thick) * (1 + 12e-2 * greatest(0e0, wave - 1)), 6) AS fuel",
    lambda: {"fuel": F.round(risk.step_fuel(_C["wave"], _C["sic"], _C["thick"], _C["wave"]), 6)},
)
_over_cells(
    "f04_safe_label",
    "CASE WHEN density > 1e-1 AND sic < 3e-1 AND (thick IS NULL OR thick < 1) AND wave < 4 THEN 1 ELSE 0 END::INTEGER AS label",
    lambda: {"label": risk.safe_label(_C["sic"], _C["wave"], _C["thick"], _C["density"])},
)
_over_cells(
    "p10_lon_wrap",
    "CASE WHEN (lon * 3 + 180e0) % 360e0 < 0 THEN (lon * 3 + 180e0) % 360e0 + 360e0 ELSE (lon * 3 + 180e0) % 360e0 END - 180e0 AS lon",
    lambda: {"lon": geo.wrap_longitude(_C["lon"] * 3)},
)


@_query("p09_bbox_wrap", f"WITH {t.CELLS} SELECT i, j, lat, lon FROM cells WHERE lat BETWEEN 70 AND 80 AND (lon >= 150 OR lon <= -150)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.cells(spark, d).filter(geo.in_box(F.col("lat"), F.col("lon"), 70, 80, 150, -150)).select("i", "j", "lat", "lon")


@_query("s15_demo_grid", "SELECT id // 80 AS i, id % 80 AS j, 65 + (id // 80) * (15e0 / 39) AS lat, 0 + (id % 80) * (160e0 / 79) AS lon, id % 80 >= 70 AS is_land FROM (SELECT unnest(range(3200)) AS id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return grid.demo_grid(spark)


@_query("a11_land_share", f"WITH {t.CELLS} SELECT round(avg(is_land::INT), 6) AS land_fraction, round(1 - avg(is_land::INT), 6) AS ocean_fraction FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = grid.land_share(t.cells(spark, d))
    return s.select(_r("land_fraction", "land_fraction"), _r("ocean_fraction", "ocean_fraction"))


_AT = "greatest(0, least(39, ceil((lat - 65e0) / (15e0 / 39) - 5e-1)))::BIGINT AS i, greatest(0, least(79, ceil((lon - 0e0) / (160e0 / 79) - 5e-1)))::BIGINT AS j"


@_query("r01_nearest_cell", f"WITH {t.POINTS} SELECT point_id, {_AT} FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.points_to_cells(t.points(spark, d), grid.DEMO).select("point_id", "i", "j")


@_query("r09_axis_ceiling", f"WITH {t.POINTS} SELECT point_id, {_AT.replace(' - 5e-1', '')} FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    return grid.sample_ahead(t.points(spark, d), grid.DEMO).select("point_id", "i", "j")


_RASTER = f"{t.POINTS}, n AS (SELECT i, j, count(*) AS n FROM (SELECT {_AT} FROM points) GROUP BY i, j), g AS (SELECT id // 80 AS i, id % 80 AS j, 65 + (id // 80) * (15e0 / 39) AS lat, id % 80 >= 70 AS is_land FROM (SELECT unnest(range(3200)) AS id)), r AS (SELECT g.*, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (i, j))"


@_query("a01_rasterise", f"WITH {_RASTER} SELECT i, j, n FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.on_grid(density.rasterise(t.points(spark, d), grid.DEMO), grid.demo_grid(spark)).select("i", "j", "n")


def _demo_density(spark: SparkSession, d: str) -> DataFrame:
    counts = density.on_grid(density.rasterise(t.points(spark, d), grid.DEMO), grid.demo_grid(spark))
    return density.normalised(counts, "n", "density")


_DENSITY = f"{_RASTER}, c9 AS (SELECT r.*, n / m.m::DOUBLE AS density FROM r, (SELECT max(n) AS m FROM r) m)"


@_query("c09_density_norm", f"WITH {_DENSITY} SELECT i, j, density FROM c9")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _demo_density(spark, d).select("i", "j", "density")


@_query(
    "c11_demo_cost",
    f"""WITH {_DENSITY}, p AS (SELECT quantile_cont(density, 0.9) AS p90 FROM c9 WHERE NOT is_land)
SELECT i, j, round(CASE WHEN NOT is_land THEN 1e0 END + CASE WHEN NOT is_land AND lat >= 75 THEN 4e0 ELSE 0e0 END + 2e0 * greatest(0e0, least(1e0, 1 - sqrt(density)))
 + 1e0 * (greatest(0e0, density - p90) / greatest(1e-6, 1 - p90)) * (greatest(0e0, density - p90) / greatest(1e-6, 1 - p90)), 6) AS cost FROM c9, p""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return cost.demo_cost(_demo_density(spark, d), weights=cost.TrafficWeights(2.0, 1.0)).select("i", "j", _r("cost", "cost"))


@_query(
    "c05_vessel_cost",
    f"""WITH {t.CELLS}, l AS (SELECT *, 5e-1 * 9e-1 AS l FROM cells) SELECT i, j, is_land OR coalesce(thick > l, false) AS blocked,
 round(CASE WHEN NOT (is_land OR coalesce(thick > l, false)) THEN 1e0 + coalesce(4e0 * pow({_clip('sic')}, 15e-1), 0e0) + pow({_clip('wave', hi='10e0')} / 6e0, 2e0)
 + coalesce(CASE WHEN thick > l * 7e-1 AND thick <= l THEN 3e0 * pow((thick - l * 7e-1) / (l - l * 7e-1), 2) ELSE 0e0 END, 0e0) END, 6) AS cost FROM l""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return cost.vessel_cost(t.cells(spark, d), 0.5, 0.9).select("i", "j", "blocked", _r("cost", "cost"))


@_query("c24_min_max", f"WITH {t.CELLS} SELECT i, j, round((wave - lo) / (hi - lo), 6) AS x FROM cells, (SELECT min(wave) AS lo, max(wave) AS hi FROM cells)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.min_max(t.cells(spark, d), "wave", "x").select("i", "j", _r("x", "x"))


@_query("c27_from_percent", f"WITH {t.CELLS} SELECT i, j, {_clip('CASE WHEN hi > 15e-1 THEN wave / 1e2 ELSE wave END')} AS x FROM cells, (SELECT max(wave) AS hi FROM cells)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.from_percent(t.cells(spark, d), "wave", "x").select("i", "j", "x")


@_query("c28_quantile_scaled", f"WITH {t.CELLS} SELECT i, j, round({_clip('(traffic - lo) / (hi - lo)')}, 6) AS x FROM cells, (SELECT quantile_cont(traffic, 0.05) AS lo, quantile_cont(traffic, 0.95) AS hi FROM cells)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.quantile_scaled(t.cells(spark, d), "traffic", "x").select("i", "j", _r("x", "x"))


@_query("c31_log_congestion", f"WITH {t.CELLS}, x AS (SELECT i, j, ln(1 + traffic) AS x FROM cells) SELECT i, j, round((x - lo) / (hi - lo + 1e-6), 6) AS x FROM x, (SELECT min(x) AS lo, max(x) AS hi FROM x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.log_congestion(t.cells(spark, d), "traffic", "x").select("i", "j", _r("x", "x"))


@_query("a24_layer_stats", f"WITH {t.CELLS} SELECT count(*) AS n, round(count(sic)::DOUBLE / count(*), 6) AS finite_ratio, min(sic) AS low, max(sic) AS high, round(avg(sic), 6) AS mean, {', '.join(f'round(quantile_cont(sic, {q}), 6) AS q{int(100 * q):02d}' for q in (0.01, 0.05, 0.5, 0.95, 0.99))} FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = density.statistics(t.cells(spark, d), "sic")
    return s.select("n", _r("finite_ratio", "finite_ratio"), "low", "high", _r("mean", "mean"), *(_r(c, c) for c in s.columns if c[0] == "q"))


@_query("c22_signature", f"WITH {t.CELLS} SELECT printf('%dx%d_%.4f_%.4f_%.4f_%.4f', max(i) + 1, max(j) + 1, min(lat), max(lat), min(lon), max(lon)) AS signature FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.signature(t.cells(spark, d))


@_query("f01_traffic_labels", f"WITH {t.CELLS} SELECT i, j, CASE WHEN density > 5e-1 THEN 1 ELSE 0 END::INTEGER AS label FROM cells WHERE NOT is_land AND (density > 5e-1 OR density = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.traffic_labels(t.cells(spark, d), "density", 0.5).select("i", "j", "label")


@_query("r11_stride", f"WITH {t.CELLS} SELECT i, j, wave FROM cells WHERE i % 3 = 0 AND j % 3 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return grid.stride(t.cells(spark, d), 3).select("i", "j", "wave")


@_query(
    "r05_index_resample",
    f"""WITH {_RASTER}, a AS (SELECT id // 60 AS i, id % 60 AS j FROM (SELECT unnest(range(1500)) AS id)),
b AS (SELECT i, j, round_even(i * (39e0 / 24), 0)::BIGINT AS si, round_even(j * (79e0 / 59), 0)::BIGINT AS sj FROM a)
SELECT b.i, b.j, r.n AS value FROM b JOIN r ON b.si = r.i AND b.sj = r.j""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    source = density.on_grid(density.rasterise(t.points(spark, d), grid.DEMO), grid.demo_grid(spark)).select("i", "j", F.col("n").alias("value"))
    return grid.index_resample(source, (40, 80), (25, 60))


@_query(
    "r07_nearest_ocean",
    f"""WITH {t.POINTS}, g AS (SELECT id // 80 AS i, id % 80 AS j, 65 + (id // 80) * (15e0 / 39) AS clat, 0 + (id % 80) * (160e0 / 79) AS clon FROM (SELECT unnest(range(3200)) AS id) WHERE id % 80 < 70),
o AS (SELECT point_id, lat, lon, {_AT.replace(' AS i', ' AS i0').replace(' AS j', ' AS j0')} FROM points),
m AS (SELECT point_id, i, j, row_number() OVER (PARTITION BY point_id ORDER BY pow(clat - lat, 2) + pow(clon - lon, 2), i, j) AS r FROM o JOIN g ON abs(i - i0) <= 10 AND abs(j - j0) <= 10)
SELECT point_id, i, j FROM m WHERE r = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return grid.nearest_ocean(t.points(spark, d).select("point_id", "lat", "lon"), grid.demo_grid(spark), grid.DEMO)


@_query("p01_time_window", f"WITH {t.POINTS} SELECT point_id, mmsi FROM points WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-05 12:00:00'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.in_time(t.points(spark, d), "2024-01-02 00:00:00", "2024-01-05 12:00:00").select("point_id", "mmsi")


@_query("s08_valid_points", f"WITH {t.POINTS} SELECT point_id, lat, lon, sog FROM points WHERE lat BETWEEN 60 AND 90 AND lon BETWEEN -180 AND 180 AND (sog IS NULL OR abs(sog) <= 60)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.valid(t.points(spark, d)).select("point_id", "lat", "lon", "sog")


@_query("p04_month", f"WITH {t.POINTS} SELECT point_id FROM points WHERE strftime(ts, '%Y%m') = '202401'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.in_month(t.points(spark, d), "202401").select("point_id")


@_query("a18_speed_ratio", f"WITH {t.POINTS}, u AS (SELECT mmsi, quantile_cont(sog, 0.8) AS u FROM points GROUP BY mmsi) SELECT point_id, round(greatest(5e-2, least(12e-1, sog / u)), 6) AS ratio, round(ln(greatest(5e-2, least(12e-1, sog / u))), 6) AS log_ratio FROM points JOIN u USING (mmsi)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.speed_ratio(t.points(spark, d)).select("point_id", _r("ratio", "ratio"), _r("log_ratio", "log_ratio"))


@_query(
    "a27_interval_label",
    f"""WITH {t.POINTS}, g AS (SELECT mmsi, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY mmsi ORDER BY ts, point_id))) / 1e6 AS gap FROM points),
m AS (SELECT mmsi, quantile_cont(gap, 0.5) AS m FROM g GROUP BY mmsi) SELECT mmsi, round(m, 7) AS median_s,
CASE WHEN m IS NULL THEN NULL WHEN m >= 25 * 86400 THEN 'monthly' WHEN m >= 20 * 3600 THEN 'D' WHEN m >= 5 * 3600 THEN '6H' WHEN m >= 9000 THEN '3H' ELSE 'H' END AS label FROM m""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.interval_label(t.points(spark, d)).select("mmsi", F.round("median_s", 7).alias("median_s"), "label")


@_query("s02_profile", f"WITH {t.POINTS} SELECT count(*) AS n, count(DISTINCT mmsi) AS vessels, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.profile(t.points(spark, d)).drop("ts_min", "ts_max")


@_query("a29_json_fields", "SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.json_fields(t.points(spark, d), "props").groupBy("field").agg(F.sum("n").alias("n"))


@_query("o03_class_sample", f"WITH {t.POINTS} SELECT point_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substr(md5('42:' || point_id), 1, 15))::BIGINT) AS r FROM points) WHERE r <= 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.sampled(t.points(spark, d), "point_id", 20, "event_type").select("point_id", "event_type")


_LEGS = f"""{t.STEPS}, q AS (SELECT *, lat AS lat2, lon AS lon2, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1 FROM steps WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
h AS (SELECT *, {_LEG} AS x FROM q), legs AS (SELECT *, coalesce({HAVERSINE.format(r='6371')}, 0e0) AS leg_km FROM h)"""


@_query("w01_running_distance", f"WITH {_LEGS} SELECT route_id, seq, round(sum(leg_km) OVER (PARTITION BY route_id ORDER BY seq), 6) AS distance_km FROM legs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.with_distance(t.steps(spark, d)).select("route_id", F.col("seq").cast("long"), _r("distance_km", "distance_km"))


@_query("w02_route_length", f"WITH {_LEGS} SELECT route_id, round(sum(leg_km), 6) AS length_km, count(*) AS points FROM legs GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.lengths(t.steps(spark, d)).select("route_id", _r("length_km", "length_km"), "points")


@_query("a12_emissions", f"WITH {_LEGS}, k AS (SELECT route_id, CASE WHEN count(*) >= 2 THEN sum(leg_km) ELSE 0e0 END AS km FROM legs GROUP BY route_id) SELECT route_id, round(km / (14e0 * 1852e-3), 6) AS hours, round(km * 35e-3, 6) AS fuel, round(km * 35e-3 * 3114e-3, 6) AS co2 FROM k")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = routes.emissions(routes.lengths(t.steps(spark, d)), F.lit(14.0), F.lit(0.035))
    return e.select("route_id", *(_r(c, c) for c in ("hours", "fuel", "co2")))


@_query("a06_components", f"WITH {t.STEPS}, l AS (UNPIVOT (SELECT route_id, ice_cost, wave_cost, ais_cost FROM steps) ON ice_cost, wave_cost, ais_cost INTO NAME component VALUE v), s AS (SELECT route_id, component, sum(v) AS total FROM l GROUP BY ALL) SELECT route_id, component, round(total, 6) AS total, round(CASE WHEN sum(total) OVER w > 0 THEN total / sum(total) OVER w ELSE 0e0 END, 9) AS fraction FROM s WINDOW w AS (PARTITION BY route_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = routes.cost_totals(t.steps(spark, d), ["ice_cost", "wave_cost", "ais_cost"])
    return c.select("route_id", "component", _r("total", "total"), F.round("fraction", 9).alias("fraction"))


@_query("a09_land_crossings", f"WITH {t.STEPS} SELECT route_id, sum(is_land::INT)::BIGINT AS on_land, sum((NOT is_land)::INT)::BIGINT AS on_ocean, coalesce(min(CASE WHEN is_land THEN seq END), -1) AS first_land FROM steps GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.land_crossings(t.steps(spark, d)).withColumn("first_land", F.coalesce("first_land", F.lit(-1)).cast("long"))


@_query("a10_density_along", f"WITH {t.STEPS}, p AS (SELECT quantile_cont(density, 0.2) AS lo, quantile_cont(density, 0.8) AS hi FROM steps) SELECT route_id, round(avg(density), 6) AS mean_density, max(density) AS max_density, round(avg(CASE WHEN density IS NOT NULL THEN (density > round(hi, 6))::INT END), 6) AS share_high, round(avg(CASE WHEN density IS NOT NULL THEN (density < round(lo, 6))::INT END), 6) AS share_low, sum((density IS NULL)::INT)::BIGINT AS missing FROM steps, p GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = t.steps(spark, d)
    low, high = (F.round(F.lit(q), 6) for q in selection.quantiles(s, "density", [0.2, 0.8]))
    a = routes.density_along(s, low, high)
    return a.select("route_id", _r("mean_density", "mean_density"), "max_density", _r("share_high", "share_high"), _r("share_low", "share_low"), "missing")


@_query("a14_uncertainty", f"WITH {t.STEPS} SELECT route_id, round(avg(uncertainty), 6) AS mean_uncertainty, round(avg(CASE WHEN uncertainty IS NOT NULL THEN (uncertainty > 5e-1)::INT END), 6) AS share_uncertain FROM steps GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.uncertainty_along(t.steps(spark, d)).select("route_id", _r("mean_uncertainty", "mean_uncertainty"), _r("share_uncertain", "share_uncertain"))


@_query("w13_smoothed", f"WITH {t.STEPS} SELECT route_id, seq, round(CASE WHEN count(*) OVER (PARTITION BY route_id) < 5 THEN ice_cost ELSE sum(ice_cost) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END, 6) AS smooth FROM steps")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.smoothed(t.steps(spark, d), "ice_cost", "smooth").select("route_id", F.col("seq").cast("long"), _r("smooth", "smooth"))


@_query("w14_hot_segment", f"WITH {t.STEPS} SELECT route_id, coalesce(min(CASE WHEN ice_cost > 2 AND wave_cost > 1 THEN seq END), -1) AS first_hot, coalesce(max(CASE WHEN ice_cost > 2 AND wave_cost > 1 THEN seq END), -1) AS last_hot FROM steps GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = t.steps(spark, d).withColumns({"ice": F.col("ice_cost") / 2, "wave": F.col("wave_cost")})
    return routes.hot_segment(s, ["ice", "wave"], 1.0).select("route_id", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("first_hot", "last_hot")))


@_query("a37_attribution", f"WITH {t.STEPS}, q AS (SELECT *, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(ice_cost) OVER w AS nxt FROM steps WINDOW w AS (PARTITION BY route_id ORDER BY seq)), h AS (SELECT *, {_LEG} AS x FROM q) SELECT route_id, round(coalesce(sum(2e0 * (ice_cost + nxt) / 2 * {HAVERSINE.format(r='6371')}), 0e0), 4) AS attributed FROM h GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.segment_attribution(t.steps(spark, d), "ice_cost", 2.0).select("route_id", F.round("attributed", 4).alias("attributed"))


@_query("w03_thinned")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.thinned(t.steps(spark, d), 500.0)


_SCORE = "CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-12 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0e0 END"
_SCORED = f"{t.RESULTS}, s AS (SELECT scenario_id, run_id, 5e-1 * {_SCORE.format(c='total_cost')} + 3e-1 * {_SCORE.format(c='risk')} + 2e-1 * {_SCORE.format(c='uncertainty')} AS score FROM results WINDOW w AS (PARTITION BY scenario_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = t.results(spark, d).withColumnRenamed("run_id", "route_id")
    return routes.scores(rows, {"total_cost": 0.5, "risk": 0.3, "uncertainty": 0.2}, "scenario_id")


@_query("w05_scores", f"WITH {_SCORED} SELECT scenario_id, run_id AS route_id, round(score, 6) AS score FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("scenario_id", "route_id", _r("score", "score"))


@_query("w06_recommended", f"WITH {_SCORED} SELECT scenario_id, arg_min(run_id, (score, run_id)) AS route_id, round(min(score), 6) AS score FROM s GROUP BY scenario_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return routes.recommended(_scored(spark, d), "scenario_id").select("scenario_id", "route_id", _r("score", "score"))


_FIRST = f"{t.RESULTS}, f AS (SELECT * FROM results WHERE reachable QUALIFY row_number() OVER (PARTITION BY scenario_id, mode ORDER BY run_id) = 1)"
_COMPARED = f"""{_FIRST}, c AS (SELECT a.scenario_id, a.mode, a.distance_km - b.distance_km AS delta_km, 1e2 * (a.distance_km - b.distance_km) / b.distance_km AS detour_pct,
 a.total_cost - b.total_cost AS delta_cost, CASE WHEN b.risk > 1e-6 THEN -1e2 * (a.risk - b.risk) / b.risk END AS risk_reduction_pct
 FROM f a JOIN f b ON a.scenario_id = b.scenario_id AND b.mode = 'efficient' AND b.distance_km >= 1e-6 WHERE a.mode <> 'efficient')"""


@_query("w07_first_results", f"WITH {_FIRST} SELECT scenario_id, mode, run_id FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return modes.first_results(t.results(spark, d)).select("scenario_id", "mode", "run_id")


@_query("a15_mode_comparison", f"WITH {_COMPARED} SELECT scenario_id, mode, delta_km, round(detour_pct, 6) AS detour_pct, round(delta_cost, 6) AS delta_cost, round(risk_reduction_pct, 6) + 0e0 AS risk_reduction_pct FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = modes.compare(t.results(spark, d))
    return c.select("scenario_id", "mode", "delta_km", *(_r(x, x) for x in ("detour_pct", "delta_cost", "risk_reduction_pct")))


@_query("a16_mode_summary", f"WITH {_COMPARED}, s AS (SELECT mode, count(*) AS scenarios, avg(risk_reduction_pct) AS mean_reduction, avg(detour_pct) AS mean_detour, count_if(risk_reduction_pct > 0)::BIGINT AS better, count_if(risk_reduction_pct > 0 AND detour_pct <= 5)::BIGINT AS better_cheaply FROM c GROUP BY mode) SELECT mode, scenarios, round(mean_reduction, 6) AS mean_reduction, round(mean_detour, 6) AS mean_detour, better, better_cheaply, CASE WHEN mean_reduction >= 75 THEN 'strong' WHEN mean_reduction >= 50 THEN 'clear' WHEN mean_reduction > 0 THEN 'slight' ELSE 'none' END AS verdict FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = modes.summary(modes.compare(t.results(spark, d)))
    return s.select("mode", "scenarios", _r("mean_reduction", "mean_reduction"), _r("mean_detour", "mean_detour"), "better", "better_cheaply", "verdict")


@_query("a57_headline", f"WITH {_FIRST} SELECT scenario_id, arg_min(mode, (distance_km, mode)) AS shortest, arg_min(mode, (risk, mode)) AS least_risk FROM f GROUP BY scenario_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return modes.headline(t.results(spark, d))


@_query("a58_scaled", f"WITH {t.RESULTS} SELECT run_id, round(distance_km / nullif(max(distance_km) OVER w, 0), 6) AS distance_km_share, round(risk / nullif(max(risk) OVER w, 0), 6) AS risk_share FROM results WINDOW w AS (PARTITION BY scenario_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return modes.scaled_to_most(t.results(spark, d), ["distance_km", "risk"]).select("run_id", _r("distance_km_share", "distance_km_share"), _r("risk_share", "risk_share"))


@_query("g09_pareto_front", f"WITH {t.RESULTS} SELECT a.scenario_id, a.run_id, a.distance_km, a.risk FROM results a WHERE NOT EXISTS (SELECT 1 FROM results b WHERE b.scenario_id = a.scenario_id AND b.distance_km <= a.distance_km AND b.risk <= a.risk AND (b.distance_km < a.distance_km OR b.risk < a.risk))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return modes.pareto_front(t.results(spark, d)).select("scenario_id", "run_id", "distance_km", "risk")


# fixed values: the demonstration voyage
START, GOAL = (69.0, 33.0), (70.5, 170.0)


def demo_route(spark: SparkSession, fields: DataFrame) -> DataFrame:
    """Steps of the demonstration voyage over cost fields (run_id, i, j, lat, lon, cost), with positions."""
    ends = spark.createDataFrame([("start", *START), ("goal", *GOAL)], "point_id string, lat double, lon double")
    snapped = {r["point_id"]: r for r in grid.nearest_ocean(ends, grid.demo_grid(spark), grid.DEMO).collect()}  # two rows
    a, b = snapped.get("start"), snapped.get("goal")
    at = lambda r, c: F.lit(r[c] if r else None).cast("long")
    runs = fields.select("run_id").distinct().select("run_id", at(a, "i").alias("start_i"), at(a, "j").alias("start_j"), at(b, "i").alias("goal_i"), at(b, "j").alias("goal_j"))
    found = search.search_routes(fields, runs)
    return found.join(F.broadcast(grid.demo_grid(spark).select("i", "j", "lat", "lon")), ["i", "j"], "left")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demonstration voyage under rising traffic weights: cost, length and how the route changes."""
    cells = _demo_density(spark, sf_dir)
    fields = None
    for weight in (0.0, 4.0, 8.0):
        f = cost.demo_cost(cells, weights=cost.TrafficWeights(corridor=weight)).select(F.lit(f"corridor {weight:g}").alias("run_id"), "i", "j", "cost")
        fields = f if fields is None else fields.union(f)
    steps = demo_route(spark, fields).persist()  # used three times; a few hundred rows
    totals = steps.groupBy("run_id").agg(F.round(F.sum("step_cost"), 6).alias("total_cost"), F.max("reason").alias("reason"))
    length = routes.lengths(steps.withColumnRenamed("run_id", "route_id")).select(F.col("route_id").alias("run_id"), _r("length_km", "length_km"), "points")
    return totals.join(length, "run_id").join(search.path_changes(steps, "corridor 0"), "run_id")


@_query("g01_least_cost_routes")
def _(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


def queries() -> dict[str, Query]:
    from . import registry_evaluation, registry_layers, registry_planner, registry_readers, registry_search, registry_suite, registry_training  # noqa: F401  they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
