"""Queries of fits, profiles, fleet, inventories, alignment and checks, with their SQL; see ``registry``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import risk
from .operators import alignment, calibration, checks, density, fleet, grid, inventory, points, profiles, routes
from .plans import domain_tables as t
from .registry import _LEG, _over_cells, _query, _r

_NM = f"6371000e0 / 1852 * 2 * atan2(sqrt(x), sqrt(1 - least(x, 1e0)))"
_C = lambda name: F.col(name)

# Samples of the fits: speed falls with ice and waves, plus what the id adds.
SAMPLES = f"{t.CELLS}, samples AS (SELECT i * {t.WIDTH} + j AS id, sic, wave, density, 1 - 3e-1 * sic * sic - 1e-2 * wave + 5e-2 * density AS y FROM cells WHERE sic IS NOT NULL)"
_PS, _QS = [0.5, 1.0, 1.5, 2.0, 2.5], [0.5, 1.0, 1.5, 2.0]
_FITTED = """e AS (SELECT p, q, pow(sic, p) AS x1, pow(wave, q) AS x2, y, id FROM samples, (SELECT unnest({ps}) AS p), (SELECT unnest({qs}) AS q)),
s AS (SELECT p, q, regr_count(y, x1) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, var_pop(y) AS syy, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM e {where} GROUP BY p, q),
f AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
r AS (SELECT p, q, my - b1 * m1 - b2 * m2 AS b0, b1, b2, sqrt(greatest(0e0, syy - b1 * s1y - b2 * s2y)) AS rmse FROM f)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    c = t.cells(spark, d).filter("sic is not null")
    y = 1 - 0.3 * F.col("sic") * F.col("sic") - 0.01 * F.col("wave") + 0.05 * F.col("density")
    return c.select((F.col("i") * t.WIDTH + F.col("j")).alias("id"), "sic", "wave", "density", y.alias("y"))


_FIT_ALL = _FITTED.format(ps=_PS, qs=_QS, where="")


@_query("a19_exponent_errors", f"WITH {SAMPLES}, {_FIT_ALL} SELECT p::DOUBLE AS p, q::DOUBLE AS q, round(rmse, 6) AS rmse FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration.exponent_errors(_samples(spark, d), _PS, _QS).select("p", "q", _r("rmse", "rmse"))


@_query("a20_best_exponents", f"WITH {SAMPLES}, {_FIT_ALL} SELECT p::DOUBLE AS p, q::DOUBLE AS q, round(rmse, 6) AS rmse FROM r ORDER BY round(rmse, 9), p, q LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration.best_exponents(_samples(spark, d), _PS, _QS).select("p", "q", _r("rmse", "rmse"))


_HELD = _FITTED.format(ps=[1.5], qs=[1.0], where="WHERE id % 5 <> 0")


@_query(
    "a21_held_out_fit",
    f"WITH {SAMPLES}, {_HELD} SELECT round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(sqrt(avg(pow(y - b0 - b1 * x1 - b2 * x2, 2))), 6) AS holdout_rmse, round(1 - avg(pow(y - b0 - b1 * x1 - b2 * x2, 2)) / var_pop(y), 6) AS holdout_r2 FROM e, r WHERE id % 5 = 0 GROUP BY b0, b1, b2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    f = calibration.held_out_fit(_samples(spark, d), 1.5, 1.0, F.col("id") % 5 == 0)
    return f.select(*(_r(c, c) for c in ("b0", "b1", "b2", "holdout_rmse", "holdout_r2")))


SCORED = f"{t.CELLS}, scored AS (SELECT greatest(0e0, least(1e0, density)) AS score, CASE WHEN (i * 31 + j * 17) % 1009 < 1009 * density THEN 1 ELSE 0 END AS label FROM cells)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    label = F.when((F.col("i") * 31 + F.col("j") * 17) % 1009 < 1009 * F.col("density"), 1).otherwise(0)
    return t.cells(spark, d).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("density"))).alias("score"), label.alias("label"))


@_query(
    "a22_ranking_quality",
    f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM scored)
SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1e0) / 2) / (sum(label) * sum(1 - label)::DOUBLE), 6) AS auc,
 round(avg(-CASE WHEN label = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, score))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END), 6) AS log_loss FROM k""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration.ranking_quality(_scored(spark, d)).select(_r("auc", "auc"), _r("log_loss", "log_loss"))


_BINS = f"WITH {SCORED}, b AS (SELECT least(9, floor(score * 10))::BIGINT AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS share, sum(pow(score - label, 2)) AS sq FROM scored GROUP BY ALL)"


@_query("a36_reliability", f"{_BINS} SELECT bin, n, round(mean_score, 6) AS mean_score, round(share, 6) AS share FROM b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration.reliability(_scored(spark, d)).select("bin", "n", _r("mean_score", "mean_score"), _r("share", "share"))


@_query("a36_calibration_error", f"{_BINS} SELECT round(sum(n * abs(mean_score - share)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration.calibration_error(_scored(spark, d)).select(_r("ece", "ece"), _r("brier", "brier"))


@_query("o05_split", f"WITH {t.POINTS} SELECT point_id, point_id % 5 = 0 AS held_out FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration.split_by_id(t.points(spark, d), "point_id").select("point_id", "held_out")


@_query("f08_exponent_features", f"WITH {SAMPLES} SELECT id, round(pow(sic, 15e-1), 6) AS x1, round(pow(wave, 1e0), 6) AS x2 FROM samples")
def _(spark: SparkSession, d: str) -> DataFrame:
    return calibration._with_exponents(_samples(spark, d), [1.5], [1.0]).select("id", _r("x1", "x1"), _r("x2", "x2"))


@_query(
    "f09_prepared",
    f"WITH {t.CELLS}, m AS (SELECT i, j, sic, traffic / 1e5 AS traffic, greatest(0e0, least(1e0, density)) AS density FROM cells) SELECT i, j, round(coalesce(sic, avg(sic) OVER (), 0), 6) AS sic, traffic, density FROM m",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = calibration.prepared_features(t.cells(spark, d), ["sic", "traffic", "density"], {"traffic": 1e5}, ["density"])
    return p.select("i", "j", _r("sic", "sic"), "traffic", "density")


@_query(
    "f10_standardised",
    f"WITH {t.CELLS}, l AS (SELECT i, j, sic, wave, (i + j) % 3 AS label FROM cells WHERE (i + j) % 3 IN (0, 1) AND sic IS NOT NULL) SELECT i, j, label, round((sic - avg(sic) OVER ()) / stddev_pop(sic) OVER (), 6) + 0e0 AS sic, round((wave - avg(wave) OVER ()) / stddev_pop(wave) OVER (), 6) + 0e0 AS wave FROM l",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = t.cells(spark, d).withColumn("label", (F.col("i") + F.col("j")) % 3)
    s = calibration.standardised(rows, ["sic", "wave"])
    return s.select("i", "j", "label", (F.round("sic", 6) + F.lit(0.0)).alias("sic"), (F.round("wave", 6) + F.lit(0.0)).alias("wave"))


@_query("a08_profile", f"WITH {t.STEPS}, q AS (SELECT *, lat AS lat2, lon AS lon2, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1 FROM steps WINDOW w AS (PARTITION BY route_id ORDER BY seq)), h AS (SELECT *, {_LEG} AS x FROM q) SELECT route_id, seq, round(sum(coalesce(6371 * 2 * atan2(sqrt(x), sqrt(1 - least(x, 1e0))), 0e0)) OVER (PARTITION BY route_id ORDER BY seq), 6) AS distance_km, coalesce(density, 0e0) AS density, coalesce(uncertainty, 0e0) AS uncertainty FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile(t.steps(spark, d), ["density", "uncertainty"]).select("route_id", F.col("seq").cast("long"), _r("distance_km", "distance_km"), "density", "uncertainty")


_BY_VESSEL = f"{t.STEPS}, track AS (SELECT mmsi AS route_id, row_number() OVER (PARTITION BY mmsi ORDER BY route_id, seq)::BIGINT AS seq, lat, lon, ice_cost FROM steps)"


def _track(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("mmsi").orderBy("route_id", "seq")
    return t.steps(spark, d).withColumn("n", F.row_number().over(w).cast("long")).select(F.col("mmsi").alias("route_id"), F.col("n").alias("seq"), "lat", "lon", "ice_cost")


@_query(
    "w08_profile_series",
    f"""WITH {_BY_VESSEL}, n AS (SELECT *, seq - 1 AS r, count(*) OVER (PARTITION BY route_id) AS n FROM track),
k AS (SELECT * FROM n WHERE n <= 20 OR r IN (SELECT unnest([x * (n - 1) // 19 for x in range(20)])))
SELECT route_id, seq, round(CASE WHEN max(ice_cost) OVER w > min(ice_cost) OVER w THEN (ice_cost - min(ice_cost) OVER w) / (max(ice_cost) OVER w - min(ice_cost) OVER w) ELSE 0e0 END, 6) AS value FROM k WINDOW w AS (PARTITION BY route_id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiles.series_scaled(profiles.thinned_evenly(_track(spark, d), 20), "ice_cost", "value").select("route_id", "seq", _r("value", "value"))


@_query(
    "w15_interpolated",
    f"""WITH {_BY_VESSEL}, k AS (SELECT route_id, seq * 10 AS s, ice_cost FROM track), g AS (SELECT route_id, seq AS id, seq * 7 + 1 AS s FROM track),
a AS (SELECT g.*, k.s AS s0, k.ice_cost AS v0 FROM g ASOF LEFT JOIN k ON g.route_id = k.route_id AND g.s >= k.s),
b AS (SELECT a.*, k.s AS s1, k.ice_cost AS v1 FROM a ASOF LEFT JOIN k ON a.route_id = k.route_id AND a.s <= k.s)
SELECT route_id, id, s, round(CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL OR s1 = s0 THEN v0 ELSE v0 + (s - s0)::DOUBLE / (s1 - s0) * (v1 - v0) END, 6) AS value FROM b""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    track = _track(spark, d)
    knots = track.select("route_id", (F.col("seq") * 10).alias("s"), F.col("ice_cost").alias("value"))
    targets = track.select("route_id", F.col("seq").alias("id"), (F.col("seq") * 7 + 1).alias("s"))
    return profiles.interpolated(knots, targets, ["value"]).select("route_id", "id", "s", _r("value", "value"))


@_query(
    "a47_centre_line",
    f"""WITH {t.STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM steps), g AS (SELECT DISTINCT mmsi, route_id, n, unnest(range(5)) AS point FROM n),
p AS (SELECT mmsi, route_id, point, (n - 1) * point / 4e0 + 1 AS pos FROM g),
v AS (SELECT p.mmsi, p.point, a.lat + (pos - floor(pos)) * (coalesce(b.lat, a.lat) - a.lat) AS lat, a.lon + (pos - floor(pos)) * (coalesce(b.lon, a.lon) - a.lon) AS lon
 FROM p JOIN steps a ON a.route_id = p.route_id AND a.seq = floor(pos) LEFT JOIN steps b ON b.route_id = p.route_id AND b.seq = floor(pos) + 1)
SELECT mmsi, point, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, count(*) AS n FROM v GROUP BY mmsi, point""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiles.centre_line(t.steps(spark, d), "mmsi").select("mmsi", "point", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "n")  # means of thousandths: halves at six places


_VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{float(x)}::DOUBLE" for x in r) + ")" for r in rows) + ")"
_VESSELS = f"vessels AS (SELECT a.k || '_' || b.k AS vessel, a.k AS vessel_type, b.k AS ice_class, (a.lo + a.hi) / 2 AS dwt, a.speed AS design_speed_kn, a.fuel AS base_fuel_per_km, b.ice AS max_ice_m FROM {_VALUES([(k, *v) for k, v in fleet.VESSEL_TYPES.items()])} a(k, lo, hi, speed, fuel), {_VALUES(list(fleet.ICE_CLASSES.items()))} b(k, ice))"


@_query("a49_vessel_profiles", f"WITH {_VESSELS} SELECT *, round(greatest(1e-2, max_ice_m * 9e-1), 6) AS usable_ice_m, round(max_ice_m * 7e-1, 6) AS soft_ice_m FROM vessels")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = fleet.vessel_profiles(spark, 0.9)
    return v.select(*v.columns[:-2], _r("usable_ice_m", "usable_ice_m"), _r("soft_ice_m", "soft_ice_m"))


_KIND = {0: "handysize", 1: "panamax", 2: "capesize", 3: "ferry"}
_KIND_SQL = "CASE point_id % 5 WHEN 0 THEN 'handysize' WHEN 1 THEN 'panamax' WHEN 2 THEN 'capesize' WHEN 3 THEN 'ferry' END"


@_query("r15_vessel_lookup", f"WITH {t.POINTS}, k AS (SELECT point_id, {_KIND_SQL} AS k FROM points) SELECT point_id, CASE WHEN k IN ('handysize', 'capesize') THEN k ELSE 'panamax' END AS vessel_type, CASE k WHEN 'handysize' THEN 13e0 WHEN 'capesize' THEN 15e0 ELSE 14e0 END AS design_speed_kn FROM k")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.create_map(*(x for k, v in _KIND.items() for x in (F.lit(k).cast("long"), F.lit(v)))), F.col("point_id") % 5)
    types = spark.createDataFrame([(k, v[2]) for k, v in fleet.VESSEL_TYPES.items()], "vessel_type string, design_speed_kn double")
    return fleet.with_dimension(t.points(spark, d).select("point_id", kind.alias("vessel_type")), types, "vessel_type", "panamax").select("point_id", "vessel_type", "design_speed_kn")


@_query("r14_scenario_modes", f"WITH {t.RESULTS} SELECT s.scenario_id, m.mode FROM (SELECT DISTINCT scenario_id FROM results) s, (VALUES ('efficient'), ('safe'), ('robust')) m(mode)")
def _(spark: SparkSession, d: str) -> DataFrame:
    modes = spark.createDataFrame([("efficient",), ("safe",), ("robust",)], "mode string")
    return fleet.every_pair(t.results(spark, d).select("scenario_id").distinct(), modes)


@_query("g10_weight_grid", "SELECT a::DOUBLE AS w_ice, b::DOUBLE AS w_wave, c::DOUBLE AS w_ais FROM (SELECT unnest([1, 2, 4]) AS a), (SELECT unnest([0.5, 1]) AS b), (SELECT unnest([0, 4, 8]) AS c)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fleet.weight_grid(spark, {"w_ice": [1, 2, 4], "w_wave": [0.5, 1], "w_ais": [0, 4, 8]})


_SEASON = "CASE WHEN m IN (12, 1, 2) THEN 115e-2 WHEN m IN (6, 7, 8) THEN 1e0 ELSE 105e-2 END"
_LEGS_NM = f"{t.STEPS}, q AS (SELECT *, substr(route_id, length(route_id) - 3, 2)::INT AS m, lat AS lat2, lon AS lon2, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1 FROM steps WINDOW w AS (PARTITION BY route_id ORDER BY seq)), h AS (SELECT *, {_LEG} AS x FROM q), nm AS (SELECT *, {_NM} AS nm FROM h)"


def _month() -> F.Column:
    return F.substring("route_id", -4, 2).cast("int")


@_query("a32_leg_fuel", f"WITH {_LEGS_NM} SELECT route_id, round(sum(nm), 6) AS nm, round(sum(nm * 12e-3 * {_SEASON}), 6) AS fuel, round(sum(nm * 12e-3 * {_SEASON} * 3114e-3), 6) AS co2 FROM nm WHERE nm IS NOT NULL GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    legs = fleet.leg_fuel(t.steps(spark, d), fleet.fuel_per_nm(F.lit("cargo_standard"), _month()))
    return legs.groupBy("route_id").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("nm", "fuel", "co2")))


@_query("a33_fuel_features", f"WITH {_LEGS_NM}, o AS (SELECT route_id, coalesce(avg(nm), 10e0) AS nm, {_SEASON} AS s FROM nm GROUP BY route_id, m) SELECT route_id, round(nm, 6) AS segment_length_nm, round(8 * s, 6) AS wind_speed, round(18e-1 * s, 6) AS wave_height, CASE WHEN s >= 115e-2 THEN 2e-1 WHEN s > 1 THEN 1e-1 ELSE 5e-2 END AS ice_risk, 1e0 AS vclass_ix FROM o")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = fleet.fuel_features(t.steps(spark, d), _month(), F.lit("cargo_iceclass"))
    return f.select("route_id", *(_r(c, c) for c in ("segment_length_nm", "wind_speed", "wave_height")), "ice_risk", "vclass_ix")


@_query(
    "a39_context_bucket",
    f"""WITH {t.POINTS}, c AS (SELECT point_id, CASE WHEN lat BETWEEN 66 AND 85 AND lon BETWEEN 30 AND 180 THEN 'NSR' WHEN lat BETWEEN 65 AND 85 AND lon BETWEEN -170 AND -40 THEN 'NWP' END AS r, [ 'DJF', 'MAM', 'JJA', 'SON' ][month(ts) % 12 // 3 + 1] AS s,
 CASE point_id % 4 WHEN 0 THEN 'cargo' WHEN 1 THEN 'tanker' WHEN 2 THEN 'fishing' END AS v FROM points) SELECT point_id, CASE WHEN r IS NULL THEN 'global' ELSE concat_ws('_', r, s, v) END AS bucket FROM c""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("point_id") % 4
    vessel = F.when(k == 0, "cargo").when(k == 1, "tanker").when(k == 2, "fishing").otherwise("yacht")
    return t.points(spark, d).select("point_id", fleet.context_bucket(F.col("lat"), F.col("lon"), F.month("ts"), vessel).alias("bucket"))


_over_cells(
    "a44_eco_fuel",
    "round(15e-3 * 8e-1 * (1 + 8e-1 * coalesce(sic, 0)) * (1 + 3e-1 * wave / 10) * 25, 6) AS fuel",
    lambda: {"fuel": F.round(fleet.eco_fuel(F.lit(25.0), F.lit(0.015), F.lit(0.8), _C("sic"), _C("wave") / 10, 0.8, 0.3), 6)},
)


@_query(
    "a48_polar_xy",
    f"""WITH {t.POINTS}, k AS (SELECT sqrt(2 / 298.257223563e0 - pow(1 / 298.257223563e0, 2)) AS e), r AS (SELECT point_id, lon, 6378137e0 * cos(radians(70)) / sqrt(1 - e * e * pow(sin(radians(70)), 2))
 * (tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2)) / (tan(pi() / 4 - radians(70) / 2) / pow((1 - e * sin(radians(70))) / (1 + e * sin(radians(70))), e / 2)) AS rho FROM points, k)
SELECT point_id, round(rho * sin(radians(lon + 45)), 3) + 0e0 AS x, round(-rho * cos(radians(lon + 45)), 3) + 0e0 AS y FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x, y = fleet.polar_xy(F.col("lat"), F.col("lon"))
    return t.points(spark, d).select("point_id", (F.round(x, 3) + F.lit(0.0)).alias("x"), (F.round(y, 3) + F.lit(0.0)).alias("y"))


_FILES = """files AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Risk/' WHEN 1 THEN 'merged/' WHEN 2 THEN 'probe_train/' ELSE 'demo/' END || 'f_' || strftime(o_orderdate, '%Y%m') || '_' || o_orderkey || '.nc' AS path,
 o_orderkey * 7919 % 100003 AS size, o_orderkey * 31 % 1009 AS mtime FROM orders),
named AS (SELECT *, regexp_extract(path, '((?:19|20)\\d{2}(?:0[1-9]|1[0-2]))', 1) AS ym, CASE WHEN lower(path) LIKE '%risk%' THEN 'risk' WHEN lower(path) LIKE '%merged%' THEN 'merged' ELSE 'block' END AS type FROM files)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    folder = F.when(k % 4 == 0, "Risk/").when(k % 4 == 1, "merged/").when(k % 4 == 2, "probe_train/").otherwise("demo/")
    path = F.concat(folder, F.lit("f_"), F.date_format("o_orderdate", "yyyyMM"), F.lit("_"), k, F.lit(".nc"))
    f = spark.read.parquet(f"{d}/orders.parquet").select(path.alias("path"), (k * 7919 % 100003).alias("size"), (k * 31 % 1009).alias("mtime"))
    return f.withColumns({"ym": inventory.month_of(F.col("path")), "type": inventory.type_of(F.col("path"), {"risk": "risk", "merged": "merged"})})


@_query("s28_inventory", f"WITH {_FILES} SELECT path, ym, type, size FROM named")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", "ym", "type", "size")


@_query("s17_ranked_files", f"WITH {_FILES} SELECT path, CASE WHEN path LIKE 'merged/%' THEN 0 WHEN path LIKE 'demo/%' THEN 1 ELSE 2 END::INT AS rank FROM named WHERE NOT lower(path) LIKE '%train%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inventory.ranked_candidates(_files(spark, d), F.col("path").startswith("merged/"), F.col("path").startswith("demo/")).select("path", "rank")


@_query("a35_redundant_files", f"WITH {_FILES}, k AS (SELECT path, first_value(path) OVER (PARTITION BY ym, type ORDER BY mtime DESC, size DESC, path DESC) AS keep FROM named) SELECT path, keep FROM k WHERE path <> keep")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inventory.newest_of_each(_files(spark, d)).filter("redundant").select("path", "keep")


_PRIORITY = "CASE type WHEN 'block' THEN 0 WHEN 'merged' THEN 1 ELSE 2 END"
_LIMIT = 40_000_000


@_query(
    "a34_clean_plan",
    f"""WITH {_FILES}, m AS (SELECT DISTINCT ym FROM named ORDER BY ym DESC LIMIT 12), c AS (SELECT *, {_PRIORITY} AS priority FROM named WHERE ym NOT IN (SELECT ym FROM m) AND ym <> '199601'),
r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY priority, ym, size DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT path, priority::INT AS priority, size FROM r WHERE (SELECT sum(size) FROM named) - before > {_LIMIT}""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("type") == "block", 0).when(F.col("type") == "merged", 1).otherwise(2)
    return inventory.clean_plan(_files(spark, d), order, 12, _LIMIT, protected=("199601",)).select("path", "priority", "size")


_SCATTERED = "scattered AS (SELECT id // 40 AS i, id % 40 AS j, 64 + (id // 40) * 5e-1 + (id % 7) / 16e0 AS lat, (id % 40) * 4 + (id % 5) / 8e0 AS lon FROM (SELECT unnest(range(1200)) AS id))"


def _scattered(spark: SparkSession) -> DataFrame:
    """A grid of bent rows and columns."""
    k = F.col("id")
    ids = spark.range(1200)
    return ids.select(F.expr("id div 40").alias("i"), (k % 40).alias("j"), (64 + F.expr("id div 40") * 0.5 + (k % 7) / 16).alias("lat"), ((k % 40) * 4 + (k % 5) / 8).alias("lon"))


@_query(
    "r02_nearest_anywhere",
    f"WITH {t.POINTS}, {_SCATTERED}, d AS (SELECT point_id, i, j, row_number() OVER (PARTITION BY point_id ORDER BY (s.lat - p.lat) * (s.lat - p.lat) + (s.lon - p.lon) * (s.lon - p.lon), i, j) AS r FROM points p, scattered s) SELECT point_id, i, j FROM d WHERE r = 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return alignment.nearest_cells(t.points(spark, d), _scattered(spark)).select("point_id", "i", "j")


@_query(
    "r03_nearest_resample",
    f"""WITH {_SCATTERED}, g AS (SELECT id // 30 AS i, id % 30 AS j, 65 + (id // 30) * (15e0 / 19) AS lat, (id % 30) * (160e0 / 29) AS lon FROM (SELECT unnest(range(600)) AS id)),
d AS (SELECT g.i, g.j, s.i * 100 + s.j AS value, row_number() OVER (PARTITION BY g.i, g.j ORDER BY (s.lat - g.lat) * (s.lat - g.lat) + (s.lon - g.lon) * (s.lon - g.lon), s.i, s.j) AS r FROM g, scattered s) SELECT i, j, value FROM d WHERE r = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    source = _scattered(spark).withColumn("value", F.col("i") * 100 + F.col("j"))
    return alignment.nearest_resample(source, grid.grid_cells(spark, grid.GridAxes(20, 30, 65.0, 80.0, 0.0, 160.0)))


_ALIGNED = f"""a AS (SELECT c.i, c.j, coalesce(CASE WHEN c.lat BETWEEN 65 AND 80 AND c.lon BETWEEN 0 AND 160 THEN s.i * 80 + s.j END, 0)::DOUBLE AS value FROM (SELECT *, greatest(0, least(39, ceil((lat - 65e0) / (15e0 / 39) - 5e-1)))::BIGINT AS si, greatest(0, least(79, ceil((lon - 0e0) / (160e0 / 79) - 5e-1)))::BIGINT AS sj FROM cells) c
 JOIN (SELECT id // 80 AS i, id % 80 AS j FROM (SELECT unnest(range(3200)) AS id)) s ON s.i = c.si AND s.j = c.sj)"""


def _demo_values(spark: SparkSession) -> DataFrame:
    return grid.demo_grid(spark).select("i", "j", (F.col("i") * 80 + F.col("j")).alias("value"))


@_query("r06_aligned", f"WITH {t.CELLS}, {_ALIGNED} SELECT i, j, value FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return alignment.aligned(_demo_values(spark), grid.DEMO, t.cells(spark, d).select("i", "j", "lat", "lon"))


@_query("c37_loaded_density", f"WITH {t.CELLS}, {_ALIGNED} SELECT i, j, CASE WHEN m > 0 THEN value / m ELSE value END AS density FROM a, (SELECT max(value) AS m FROM a)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return alignment.loaded_density(_demo_values(spark), grid.DEMO, t.cells(spark, d).select("i", "j", "lat", "lon"))


_HIT = f"{t.POINTS}, hit AS (SELECT DISTINCT greatest(0, least(39, ceil((lat - 65e0) / (15e0 / 39) - 5e-1)))::BIGINT AS i, greatest(0, least(79, ceil((lon - 0e0) / (160e0 / 79) - 5e-1)))::BIGINT AS j FROM points WHERE lat IS NOT NULL AND lon IS NOT NULL)"


def _hit(spark: SparkSession, d: str) -> DataFrame:
    return alignment.visited_cells(t.points(spark, d), grid.DEMO, grid.demo_grid(spark))


@_query("r10_visited_cells", f"WITH {_HIT} SELECT i, j FROM hit WHERE j < 70")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _hit(spark, d)


@_query("r16_unvisited_cells", f"WITH {_HIT} SELECT id // 80 AS i, id % 80 AS j FROM (SELECT unnest(range(3200)) AS id) WHERE id % 80 < 70 EXCEPT SELECT i, j FROM hit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return alignment.unvisited_cells(_hit(spark, d), grid.demo_grid(spark))


@_query("p05_complete_points", f"WITH {t.POINTS} SELECT point_id, lat, lon, sog FROM points WHERE ts IS NOT NULL AND mmsi IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND sog >= 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.complete(t.points(spark, d)).select("point_id", "lat", "lon", "sog")


@_query(
    "r08_nearest_ocean_anywhere",
    f"""WITH {t.POINTS}, g AS (SELECT id // 80 AS i, id % 80 AS j, 65 + (id // 80) * (15e0 / 39) AS clat, 0 + (id % 80) * (160e0 / 79) AS clon FROM (SELECT unnest(range(3200)) AS id) WHERE id % 80 < 70),
m AS (SELECT point_id, i, j, row_number() OVER (PARTITION BY point_id ORDER BY (clat - lat) * (clat - lat) + (clon - lon) * (clon - lon), i, j) AS r FROM points, g) SELECT point_id, i, j FROM m WHERE r = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return alignment.nearest_ocean_anywhere(t.points(spark, d), grid.demo_grid(spark))


@_query(
    "a25_month_check",
    f"WITH {t.CELLS} SELECT i % 12 AS month, round(1e2 * avg((sic IS NULL)::INT), 6) AS sic_nan_pct, max(sic) AS sic_max, round(avg(sic), 6) AS sic_mean, round(avg(wave), 6) AS cost_mean, 1e2 * avg((sic IS NULL)::INT) > 30 AS warn_gaps, max(sic) > 12e-1 AS warn_sic, max(wave) < 3e-1 AS warn_cost FROM cells GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = checks.month_check(t.cells(spark, d).withColumn("month", F.col("i") % 12), ["month"], cost="wave")
    return c.select("month", _r("sic_nan_pct", "sic_nan_pct"), "sic_max", _r("sic_mean", "sic_mean"), _r("cost_mean", "cost_mean"), "warn_gaps", "warn_sic", "warn_cost")


@_query("a26_gap_shares", f"WITH {t.CELLS}, p AS (SELECT i % 12 AS m, avg((sic IS NULL)::INT) AS g FROM cells GROUP BY ALL), r AS (SELECT g, row_number() OVER (ORDER BY m) - 1 AS r, count(*) OVER () AS n FROM p) SELECT round(max(CASE WHEN r = 0 THEN g END), 6) AS first, round(max(CASE WHEN r = n // 2 THEN g END), 6) AS middle, round(max(CASE WHEN r = n - 1 THEN g END), 6) AS last FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = checks.gap_shares(t.cells(spark, d).withColumn("m", F.col("i") % 12), "m", "sic")
    return g.select(_r("first", "first"), _r("middle", "middle"), _r("last", "last"))


@_query("a28_resolution", "SELECT round(15e0 / 60, 6) AS step, 4::INT AS denominator")
def _(spark: SparkSession, d: str) -> DataFrame:
    return checks.resolution(grid.grid_cells(spark, grid.GridAxes(61, 80, 65.0, 80.0, 0.0, 160.0)), "lat").select(_r("step", "step"), "denominator")


@_query(
    "c36_otsu",
    f"""WITH {t.CELLS}, x AS (SELECT wave AS x FROM cells), f AS (SELECT min(x) AS lo, (max(x) - min(x)) / 256 AS w FROM x), h AS (SELECT least(255, floor((x - lo) / w)) AS b, count(*) AS n FROM x, f GROUP BY ALL),
s AS (SELECT b, n, lo + (b + 5e-1) * w AS mid FROM h, f), c AS (SELECT b, mid, sum(n) OVER o AS n1, sum(n * mid) OVER o AS s1, sum(n) OVER () AS n0, sum(n * mid) OVER () AS s0 FROM s WINDOW o AS (ORDER BY b))
SELECT 'ok' AS reason, round(mid, 6) AS threshold FROM c WHERE n1 < n0 ORDER BY round(n1::DOUBLE * (n0 - n1) * pow(s1 / n1 - (s0 - s1) / (n0 - n1), 2), 3) DESC, b LIMIT 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return checks.otsu(t.cells(spark, d), "wave").select("reason", _r("threshold", "threshold"))


@_query("f06_rescaled", f"WITH {t.CELLS} SELECT i, j, round(CASE WHEN max(traffic) OVER () > 1 THEN traffic / max(traffic) OVER () ELSE traffic END, 6) AS traffic FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    return checks.rescaled_if_large(t.cells(spark, d), "traffic").select("i", "j", _r("traffic", "traffic"))


@_query("s13_mostly_missing", f"WITH {t.CELLS}, s AS (SELECT *, avg((sic IS NOT NULL)::INT) OVER () AS share FROM cells) SELECT i, j, CASE WHEN share >= 5e-1 THEN sic END AS sic FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return checks.mostly_missing(t.cells(spark, d), "sic", 0.5).select("i", "j", "sic")


@_query("a51_label_balance", f"WITH {t.CELLS} SELECT (i + j) % 3 AS label, count(*) AS n, round(avg(sic), 6) AS mean_sic, round(avg(wave), 6) AS mean_wave FROM cells GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = checks.label_balance(t.cells(spark, d).withColumn("label", (F.col("i") + F.col("j")) % 3), ["sic", "wave"])
    return b.select("label", "n", _r("mean_sic", "mean_sic"), _r("mean_wave", "mean_wave"))


@_query("a43_moments", f"WITH {t.CELLS} SELECT i % 10 AS i, j, round(avg(wave), 6) AS mean, round(var_pop(wave), 6) AS variance FROM cells GROUP BY i % 10, j")
def _(spark: SparkSession, d: str) -> DataFrame:
    return checks.moments(t.cells(spark, d).withColumn("i", F.col("i") % 10), "wave").select("i", "j", _r("mean", "mean"), _r("variance", "variance"))


def _softmax() -> dict[str, F.Column]:
    a, b = checks.softmax([_C("wave"), _C("density") * 5], 2.0)
    return {"gate_wave": F.round(a, 6), "gate_density": F.round(b, 6)}


_over_cells("c35_gate", "round(exp(wave / 2) / (exp(wave / 2) + exp(density * 5 / 2)), 6) AS gate_wave, round(exp(density * 5 / 2) / (exp(wave / 2) + exp(density * 5 / 2)), 6) AS gate_density", _softmax)
_over_cells("c16_model_risk", "2e0 * density AS model_risk", lambda: {"model_risk": F.lit(2.0) * _C("density")})
_over_cells("c25_eco_field", "0e0 AS eco", lambda: {"eco": F.lit(0.0)})
_over_cells("a42_risk_source", "coalesce(sic, density) AS risk", lambda: {"risk": F.coalesce(_C("sic"), _C("density"))})
_over_cells("m03_fallback", "greatest(0e0, least(1e0, coalesce(sic, 1e0))) AS u", lambda: {"u": fleet.bounded_uncertainty(_C("sic"))})


@_query("p07_complete_ocean", f"WITH {t.CELLS} SELECT i, j FROM cells WHERE NOT is_land AND sic IS NOT NULL AND wave IS NOT NULL AND thick IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.cells(spark, d).filter("not is_land").dropna(subset=["sic", "wave", "thick"]).select("i", "j")


@_query("a59_ais_total", f"WITH {t.STEPS} SELECT route_id, round(sum(ais_cost), 6) AS ais_total FROM steps GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    totals = routes.cost_totals(t.steps(spark, d), ["ice_cost", "wave_cost", "ais_cost"])
    return totals.filter(F.col("component").startswith("ais")).groupBy("route_id").agg(F.round(F.sum("total"), 6).alias("ais_total"))


@_query("a56_risk_total", f"WITH {t.STEPS} SELECT route_id, round(sum(ice_cost) + sum(wave_cost), 6) AS risk_total FROM steps GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    totals = routes.cost_totals(t.steps(spark, d), ["ice_cost", "wave_cost", "ais_cost"])
    return totals.filter(F.col("component").isin("model_risk", "model_uncertainty", "ice_cost", "wave_cost")).groupBy("route_id").agg(F.round(F.sum("total"), 6).alias("risk_total"))


@_query("c19_exponents", f"WITH {t.RESULTS} SELECT run_id, coalesce(CASE WHEN run_id % 3 = 0 THEN 12e-1 END, CASE WHEN run_id % 5 = 0 THEN 1e0 END, 15e-1) AS ice_exponent FROM results")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("run_id")
    return t.results(spark, d).select("run_id", risk.resolved_exponent(F.when(k % 3 == 0, 1.2), F.when(k % 5 == 0, 1.0), F.lit(None).cast("double"), 1.5).alias("ice_exponent"))


@_query("o10_vessel_classes", f"WITH {t.CELLS} SELECT i, j, c AS vessel_class FROM cells, (SELECT unnest([0, 1, 2]) AS c)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.cells(spark, d).select("i", "j", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("vessel_class"))
