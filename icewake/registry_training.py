"""Queries over planning, training tables and loose records, with their SQL."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import risk
from .operators import density, encounters, grid, logistic, modes, planning, points, records, routes, training
from .plans import domain_tables as t
from .registry import _AT, _COMPARED, _DENSITY, _FIRST, _RASTER, _clip, _demo_density, _over_cells, _query, _r, demo_route

_TEXT = """CASE point_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
 WHEN 3 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 4 THEN strftime(ts, '%Y-%m') || ' about noon' ELSE 'unknown' END"""


def _time_text() -> Column:
    k = F.col("point_id") % 6
    shown = [F.date_format("ts", f) for f in (*records.TEXT_FORMATS[:2], "yyyy-MM-dd'T'HH:mm:ss'Z'", records.TEXT_FORMATS[3])]
    out = F.when(k == 4, F.concat(F.date_format("ts", "yyyy-MM"), F.lit(" about noon"))).when(k == 5, "unknown")
    for n, s in enumerate(shown):
        out = out.when(k == n, s)
    return out


@_query("p04_text_months", f"WITH {t.POINTS} SELECT point_id FROM points WHERE point_id % 6 <> 5 AND strftime(ts, '%Y%m') = '202401'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.points(spark, d).filter(records.in_text_month(_time_text(), "202401")).select("point_id")


@_query("p06_reachable_safe", f"WITH {t.RESULTS} SELECT run_id, scenario_id FROM results WHERE reachable AND mode = 'safe'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.results(spark, d).filter("reachable and mode = 'safe'").select("run_id", "scenario_id")


@_query("p12_flattened", f"WITH {t.RESULTS} SELECT run_id, mode AS meta_mode, risk AS meta_risk FROM results")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.flattened(t.results(spark, d).select("run_id", F.struct("mode", "risk").alias("meta")), "meta", "meta_")


@_query("o01_by_time", f"WITH {t.POINTS} SELECT point_id, ts FROM points ORDER BY ts, point_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.points(spark, d).select("point_id", "ts").orderBy("ts", "point_id")


@_query("o02_scenarios", f"WITH {t.RESULTS} SELECT DISTINCT scenario_id FROM results ORDER BY scenario_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.results(spark, d).select("scenario_id").distinct().orderBy("scenario_id")


@_query("o06_every_kth", f"WITH {t.POINTS} SELECT point_id, mmsi FROM points QUALIFY (row_number() OVER (PARTITION BY mmsi ORDER BY ts, point_id) - 1) % 10 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.every_kth(t.points(spark, d), "mmsi", ["ts", "point_id"], 10).select("point_id", "mmsi")


@_query("o07_stacked", f"WITH {t.POINTS} SELECT point_id AS id, sog, NULL::DOUBLE AS risk FROM points UNION ALL (WITH {t.RESULTS} SELECT run_id, NULL, risk FROM results)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.stacked(t.points(spark, d).select(F.col("point_id").alias("id"), "sog"), t.results(spark, d).select(F.col("run_id").alias("id"), "risk"))


@_query("a02_build_result", f"WITH {t.POINTS} SELECT count(*) AS num_points, count(lat) AS num_binned, 1e0 AS frac_binned FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.build_result(t.points(spark, d))


@_query("a04_density_dataset", f"WITH {_DENSITY} SELECT i, j, lat, 0 + j * (160e0 / 79) AS lon, n, density, 'traffic density' AS title FROM c9")
def _(spark: SparkSession, d: str) -> DataFrame:
    return density.dataset(density.rasterise(t.points(spark, d), grid.DEMO), grid.demo_grid(spark), "traffic density")


@_query("a05_route_total", f"WITH {t.STEPS} SELECT route_id, round(sum(ice_cost + wave_cost), 6) AS total FROM steps GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = planning.route_total(t.steps(spark, d).withColumn("cost", F.col("ice_cost") + F.col("wave_cost")), "cost")
    return s.select("route_id", _r("total", "total"))


_PARTS = ["ice_cost", "wave_cost", "ais_cost"]


@_query(
    "a07_breakdown",
    f"WITH {t.STEPS}, s AS (SELECT route_id, {', '.join(f'sum({c}) AS {c}' for c in _PARTS)} FROM steps GROUP BY route_id), k AS (SELECT *, {' + '.join(_PARTS)} AS total FROM s) SELECT route_id, round(total, 6) AS total, {', '.join(f'round({c}, 6) AS {c}, round(CASE WHEN total > 0 THEN {c} / total ELSE 0e0 END, 6) AS {c}_share' for c in _PARTS)} FROM k",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    b = planning.breakdown(t.steps(spark, d), _PARTS).drop("length_km")
    return b.select("route_id", *(_r(c, c) for c in b.columns if c != "route_id"))


@_query("a13_risk_total", f"WITH {t.STEPS} SELECT route_id, round(sum(ice_cost) + sum(wave_cost) + sum(ais_cost), 6) AS risk_total FROM steps GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    named = t.steps(spark, d).withColumnsRenamed({"ice_cost": "ice_risk", "wave_cost": "wave_risk", "ais_cost": "ais_density"}).withColumn("base_distance", F.lit(1.0))
    parts = routes.cost_totals(named, ["ice_risk", "wave_risk", "ais_density", "base_distance"])
    return planning.risk_totals(parts).select("route_id", _r("risk_total", "risk_total"))


@_query(
    "a17_conclusions",
    f"WITH {_COMPARED}, s AS (SELECT mode, avg(risk_reduction_pct) AS cut, avg(detour_pct) AS detour FROM c GROUP BY mode) SELECT mode, CASE mode WHEN 'safe' THEN CASE WHEN cut > 50 AND detour < 5 THEN 'good_trade' ELSE 'limited' END WHEN 'robust' THEN CASE WHEN cut > 75 THEN 'strong_protection' ELSE 'moderate_protection' END END AS conclusion FROM s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return modes.conclusions(modes.summary(modes.compare(t.results(spark, d)))).select("mode", "conclusion")


@_query(
    "a57_headline_deltas",
    f"""WITH {_FIRST}, b AS (SELECT scenario_id, arg_min(mode, (distance_km, mode)) AS shortest, min(distance_km) AS km, arg_min(mode, (risk, mode)) AS least_risk, min(risk) AS risk,
 max(CASE WHEN mode = 'efficient' THEN distance_km END) AS bkm, max(CASE WHEN mode = 'efficient' THEN risk END) AS brisk FROM f GROUP BY scenario_id)
SELECT scenario_id, shortest, km - bkm AS delta_km, least_risk, round(CASE WHEN brisk > 0 THEN 100e0 * (risk - brisk) / brisk END, 6) + 0e0 AS risk_change_pct FROM b""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    h = modes.headline_deltas(t.results(spark, d))
    return h.withColumn("risk_change_pct", F.round("risk_change_pct", 6) + F.lit(0.0))


@_query(
    "a50_bundle",
    f"WITH {_COMPARED} SELECT f.scenario_id, f.mode, f.distance_km, round(f.total_cost, 6) AS total_cost, f.risk, c.delta_km, round(c.delta_cost, 6) AS delta_cost FROM f LEFT JOIN c ON f.scenario_id = c.scenario_id AND f.mode = c.mode",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    r = t.results(spark, d)
    both = modes.first_results(r).join(modes.compare(r), ["scenario_id", "mode"], "left")
    return both.select("scenario_id", "mode", "distance_km", _r("total_cost", "total_cost"), "risk", "delta_km", _r("delta_cost", "delta_cost"))


@_query(
    "a60_share_labels",
    f"WITH {t.STEPS}, s AS (SELECT route_id, sum(ais_cost) AS m, sum(ice_cost + wave_cost + ais_cost) AS c, avg(CASE WHEN uncertainty IS NOT NULL THEN (uncertainty > 7e-1)::INT END) AS u FROM steps GROUP BY route_id) SELECT route_id, coalesce(CASE WHEN c > 0 THEN round(m / c, 9) < 5e-2 END, false) AS small_model_share, round(u, 6) AS share_unsure, coalesce(round(u, 9) > 3e-1, false) AS warn FROM s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = t.steps(spark, d).withColumns({"model_cost": F.col("ais_cost"), "total_cost": F.col("ice_cost") + F.col("wave_cost") + F.col("ais_cost")})
    return planning.share_labels(s).select("route_id", "small_model_share", _r("share_unsure", "share_unsure"), "warn")


_SMOOTH = "round(CASE WHEN count(*) OVER (PARTITION BY route_id) < 5 THEN {c} ELSE sum({c}) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END, 9)"
_UNIT = "CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-12 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0e0 END"


@_query(
    "w14_hot_stretch",
    f"WITH {t.STEPS}, s AS (SELECT route_id, seq, {_SMOOTH.format(c='ice_cost')} AS a, {_SMOOTH.format(c='wave_cost')} AS b FROM steps), n AS (SELECT route_id, seq, {_UNIT.format(c='a')} AS a, {_UNIT.format(c='b')} AS b FROM s WINDOW w AS (PARTITION BY route_id)) SELECT route_id, coalesce(min(CASE WHEN a > 61e-2 AND b > 61e-2 THEN seq END), -1) AS first_hot, coalesce(max(CASE WHEN a > 61e-2 AND b > 61e-2 THEN seq END), -1) AS last_hot FROM n GROUP BY route_id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = planning.hot_stretch(t.steps(spark, d), ["ice_cost", "wave_cost"], 0.61)
    return s.select("route_id", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("first_hot", "last_hot")))


@_query("r12_route_raster", f"WITH {_RASTER}, a AS (SELECT mmsi || '-' || strftime(ts, '%Y%m%d') AS route_id, {_AT} FROM points) SELECT route_id, round(avg(r.n), 6) AS mean_value, count(r.n) AS met FROM a JOIN r USING (i, j) GROUP BY route_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    raster = _demo_density(spark, d).select("i", "j", F.col("n").cast("double").alias("value"))
    met = planning.along_raster(density.points_to_cells(t.steps(spark, d), grid.DEMO), raster)
    return met.select("route_id", _r("mean_value", "mean_value"), "met")


@_query("g14_route_quality", f"WITH {t.STEPS}, s AS (SELECT route_id, sum(is_land::INT) AS on_land FROM steps GROUP BY route_id) SELECT count_if(on_land = 0)::BIGINT AS ok, count_if(on_land > 0)::BIGINT AS failed FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return planning.route_quality(routes.land_crossings(t.steps(spark, d)))


_WEIGHTS = "w AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 5)::DOUBLE END AS legacy, (o_orderkey % 3)::DOUBLE AS corridor, (o_orderkey % 7 // 4)::DOUBLE AS congestion, o_orderkey % 4 = 0 AS to_corridor FROM orders)"


@_query(
    "c13_traffic_weights",
    f"""WITH {_WEIGHTS}, r AS (SELECT *, coalesce(legacy, 0e0) AS l, corridor > 0 OR congestion > 0 AS newer FROM w), m AS (SELECT *, to_corridor AND l > 0 AND NOT newer AS mapped FROM r)
SELECT run_id, CASE WHEN mapped THEN l ELSE corridor END AS w_corridor, congestion AS w_congestion, CASE WHEN mapped OR newer THEN 0e0 ELSE l END AS w_legacy, mapped FROM m""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("run_id")
    runs = t.results(spark, d).select("run_id")
    w = planning.resolved_traffic_weights(F.when(k % 2 == 0, (k % 5).cast("double")), (k % 3).cast("double"), F.floor(k % 7 / 4).cast("double"), k % 4 == 0)
    return runs.select("run_id", *(c.alias(n) for n, c in w.items()))


@_query("c14_density_component", f"WITH {_DENSITY} SELECT i, j, density AS ais_density FROM c9")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _demo_density(spark, d).select("i", "j", F.col("density").alias("ais_density"))


@_query("c15_traffic_component", f"WITH {t.CELLS} SELECT i, j, 25e-1 * density AS ais_density, round(wave + 25e-1 * density, 6) AS cost FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    return planning.with_traffic_component(t.cells(spark, d).withColumn("cost", F.col("wave")), "density", 2.5).select("i", "j", "ais_density", _r("cost", "cost"))


@_query("c34_beta_risk")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = t.cells(spark, d).withColumn("variance", 0.1 * F.col("density") * (1 - F.col("density")))
    return training.beta_risk(c, "density", "variance").select("i", "j", "risk_mean", "risk_q", "risk_cvar")


_FEATURES = ["sic", "wave", "thick", "density", "drift"]


@_query("f02_training_frame", f"WITH {t.CELLS} SELECT i, j, sic, wave, thick, density, NULL::DOUBLE AS drift, 8 AS month, 1 AS vessel_class FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    return training.frame(t.cells(spark, d), _FEATURES, 8, 1)


@_query("f03_training_table", f"WITH {t.CELLS} SELECT i, j, sic, wave, thick, density, NULL::DOUBLE AS drift, 8 AS month, 1 AS vessel_class, CASE WHEN density > 5e-1 THEN 1 ELSE 0 END::INTEGER AS label, 220 AS day FROM cells WHERE NOT is_land AND (density > 5e-1 OR density = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = t.cells(spark, d)
    return training.export_frame(cells, density.traffic_labels(cells, "density", 0.5), _FEATURES)


@_query("f07_sampled_cells", f"WITH {_RASTER}, o AS (SELECT count(*) AS o, count_if(n > 0) AS p FROM r WHERE NOT is_land) SELECT 1 AS label, p::BIGINT AS n FROM o WHERE p > 0 UNION ALL SELECT 0, least(o - p, greatest(3 * p, 100))::BIGINT FROM o WHERE o > p")
def _(spark: SparkSession, d: str) -> DataFrame:
    raster = density.on_grid(density.rasterise(t.points(spark, d), grid.DEMO), grid.demo_grid(spark)).filter("not is_land")
    return training.sampled_cells(raster.filter("n > 0"), raster).groupBy("label").agg(F.count("*").alias("n"))


@_query("f11_zero_density", f"WITH {t.CELLS}, n AS (SELECT i, j, density FROM cells WHERE (i + j) % 3 = 0) SELECT c.i, c.j, coalesce(n.density, 0e0) AS density FROM cells c LEFT JOIN n USING (i, j)")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = t.cells(spark, d)
    return training.with_density(cells, cells.filter((F.col("i") + F.col("j")) % 3 == 0).select("i", "j", "density")).select("i", "j", "density")


def _drawn(columns: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {columns})), 1, 15))::BIGINT"


@_query("f07_drawn_cells", f"""WITH {t.CELLS}, o AS (SELECT i, j, density > 9e-1 AS hit, {_drawn('i::VARCHAR, j::VARCHAR')} AS k FROM cells WHERE NOT is_land),
n AS (SELECT i, j, row_number() OVER (ORDER BY k) AS r FROM o WHERE NOT hit) SELECT i, j, 1 AS label FROM o WHERE hit UNION ALL SELECT i, j, 0 FROM n WHERE r <= greatest(3 * (SELECT count_if(hit) FROM o), 100)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    ocean = t.cells(spark, d).filter("not is_land")
    return training.sampled_cells(ocean.filter("density > 0.9"), ocean)


@_query("o04_sample", f"WITH {t.POINTS} SELECT point_id FROM points ORDER BY {_drawn('point_id::VARCHAR', 7)} LIMIT 500")
def _(spark: SparkSession, d: str) -> DataFrame:
    return points.drawn(t.points(spark, d), "point_id", 500, 7).select("point_id")


# Labels that ice and waves raise, for the fits.
LABELLED = f"""{t.CELLS}, ls AS (SELECT i * {t.WIDTH} + j AS id, lat, greatest(0e0, least(1e0, sic)) AS sic, greatest(0e0, least(1e1, wave)) AS wave,
 CASE WHEN (i * 31 + j * 17) % 1009 < 1009 * (1e-1 + 5e-1 * sic * sic + 3e-2 * wave) THEN 1 ELSE 0 END AS y FROM cells WHERE sic IS NOT NULL)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    y = F.when((F.col("i") * 31 + F.col("j") * 17) % 1009 < 1009 * (0.1 + 0.5 * F.col("sic") * F.col("sic") + 0.03 * F.col("wave")), 1).otherwise(0)
    return t.cells(spark, d).filter("sic is not null").select((F.col("i") * t.WIDTH + F.col("j")).alias("id"), "lat", "sic", "wave", y.alias("label"))


def _newton(keys: str, steps: int = 9) -> str:
    """Newton steps over rows r (keys, x1, x2, y, w, tw), three normal equations at a time, then f (coefficients, mean loss) and area (auc)."""
    on = f"USING ({keys})"
    text = [f"c0 AS (SELECT DISTINCT {keys}, 0e0 AS b0, 0e0 AS b1, 0e0 AS b2 FROM r)"]
    for k in range(steps):
        text.append(f"""s{k} AS MATERIALIZED (SELECT {keys}, b0, b1, b2, sum(w * (y - m)) AS g0, sum(w * (y - m) * x1) - b1 AS g1, sum(w * (y - m) * x2) - b2 AS g2, sum(o) AS a, sum(o * x1) AS b, sum(o * x2) AS c, sum(o * x1 * x1) + 1 AS e, sum(o * x1 * x2) AS f, sum(o * x2 * x2) + 1 AS h
 FROM (SELECT *, w * m * (1 - m) AS o FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS m FROM r JOIN c{k} {on})) GROUP BY {keys}, b0, b1, b2)""")
        det = "(a * (e * h - f * f) - b * (b * h - f * c) + c * (b * f - e * c))"
        text.append(f"""c{k + 1} AS MATERIALIZED (SELECT {keys}, b0 + (g0 * (e * h - f * f) - b * (g1 * h - f * g2) + c * (g1 * f - e * g2)) / {det} AS b0,
 b1 + (a * (g1 * h - f * g2) - g0 * (b * h - f * c) + c * (b * g2 - g1 * c)) / {det} AS b1, b2 + (a * (e * g2 - g1 * f) - b * (b * g2 - g1 * c) + g0 * (b * f - e * c)) / {det} AS b2 FROM s{k})""")
    text.append(f"z AS MATERIALIZED (SELECT *, round(b0 + b1 * x1 + b2 * x2, 9) AS z FROM r JOIN c{steps} {on})")
    text.append(f"f AS (SELECT {keys}, b0, b1, b2, sum(w * (ln(1 + exp(z)) - y * z)) / sum(w) AS log_loss FROM z GROUP BY {keys}, b0, b1, b2)")
    text.append(f"zz AS (SELECT {keys}, z, sum(tw * y) AS pos, sum(tw * (1 - y)) AS neg FROM z WHERE tw > 0 GROUP BY {keys}, z)")
    text.append(f"area AS (SELECT {keys}, sum(pos * (below - neg / 2e0)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY z) AS below FROM zz) GROUP BY {keys})")
    return ",\n".join(text)


_CV = [(1.0, 1.0), (2.0, 1.0), (1.5, 0.8)]
_EXPONENTS = [(round(0.5 + 0.1 * a, 1), round(0.5 + 0.1 * b, 1)) for a in range(26) for b in range(26)]
_GRID = "(SELECT (5 + a) / 1e1 AS p, (5 + b) / 1e1 AS q FROM (SELECT unnest(range(26)) AS a), (SELECT unnest(range(26)) AS b))"
_AUC = f"{LABELLED}, g AS (SELECT sic, wave, y, count(*)::DOUBLE AS w FROM ls GROUP BY ALL), r AS MATERIALIZED (SELECT p, q, pow(sic, p) AS x1, pow(wave, q) AS x2, y, w, w AS tw FROM g, {_GRID}), {_newton('p, q')}"


@_query(
    "a22_fitted_quality",
    f"""WITH {LABELLED}, e AS (SELECT * FROM (VALUES {', '.join(f'({p}::DOUBLE, {q}::DOUBLE)' for p, q in _CV)}) e(p, q)), ends AS (SELECT quantile_cont(lat, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS l FROM ls),
v AS (SELECT unnest(range(6)) AS v), r AS MATERIALIZED (SELECT p, q, v, pow(sic, p) AS x1, pow(wave, q) AS x2, y, CASE WHEN v = 0 OR NOT lat BETWEEN l[v] AND l[v + 1] THEN 1e0 ELSE 0e0 END AS w, CASE WHEN v = 0 OR lat BETWEEN l[v] AND l[v + 1] THEN 1e0 ELSE 0e0 END AS tw FROM ls, e, v, ends),
{_newton('p, q, v')}
SELECT p, q, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(auc, 6) AS auc, round(log_loss, 6) AS log_loss, round(m, 6) AS cv_auc_mean, round(s, 6) AS cv_auc_std, n, k AS n_positive
FROM f JOIN area USING (p, q, v) JOIN (SELECT p, q, avg(auc) AS m, stddev_pop(auc) AS s FROM area WHERE v > 0 GROUP BY p, q) USING (p, q), (SELECT count(*) AS n, sum(y)::BIGINT AS k FROM ls) WHERE v = 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = logistic.calibrate(_labelled(spark, d), _CV, blocks=5)
    return c.select("p", "q", *(_r(x, x) for x in ("b0", "b1", "b2", "auc", "log_loss", "cv_auc_mean", "cv_auc_std")), "n", "n_positive")


@_query("a23_auc_grid", f"WITH {_AUC} SELECT p, q, round(auc, 6) AS auc, round(log_loss, 6) AS log_loss FROM f JOIN area USING (p, q)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return logistic.calibrate(_labelled(spark, d), _EXPONENTS).select("p", "q", _r("auc", "auc"), _r("log_loss", "log_loss"))


@_query("w09_best_exponents", f"WITH {_AUC} SELECT p, q, round(auc, 6) AS auc FROM area ORDER BY round(auc, 6) DESC, p, q LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return logistic.calibrate(_labelled(spark, d), _EXPONENTS).select("p", "q", _r("auc", "auc")).orderBy(F.desc("auc"), "p", "q").limit(20)


_POISSON = " + ".join(f"(u > {sum(0.36787944117144233 / factorial(j) for j in range(k + 1))!r})::INT" for k in range(10))


@_query(
    "a23_intervals",
    f"""WITH {LABELLED}, d AS (SELECT unnest(range(20)) AS v), u AS (SELECT sic, wave, y, v, (('0x' || substr(md5(id || ':' || v), 1, 8))::BIGINT + 5e-1) / 4294967296e0 AS u FROM ls, d),
g AS (SELECT sic, wave, y, v, sum({_POISSON})::DOUBLE AS w FROM u GROUP BY sic, wave, y, v), e AS (SELECT (19 + a) / 1e1 AS p, (9 + b) / 1e1 AS q FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b)),
r AS MATERIALIZED (SELECT p, q, v, pow(sic, p) AS x1, pow(wave, q) AS x2, y, w, w AS tw FROM g, e WHERE w > 0), {_newton('p, q, v')},
best AS (SELECT v, p, q FROM area QUALIFY row_number() OVER (PARTITION BY v ORDER BY -round(auc, 9), p, q) = 1)
SELECT round(quantile_cont(p, 0.025), 6) AS p_low, round(quantile_cont(p, 0.975), 6) AS p_high, round(quantile_cont(q, 0.025), 6) AS q_low, round(quantile_cont(q, 0.975), 6) AS q_high, count(*) AS draws FROM best""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = logistic.intervals(_labelled(spark, d), "id", 2.0, 1.0, draws=20, reach=1)
    return c.select(*(_r(x, x) for x in ("p_low", "p_high", "q_low", "q_high")), "draws")


_INPUTS = ["f_sic", "f_wave", "f_thickness", "f_lat", "f_lon"]
_FIVE = f"coalesce({_clip('sic')}, 0e0) AS f_sic, {_clip('wave / 1e1')} AS f_wave, coalesce({_clip('thick / 2e0')}, 0e0) AS f_thickness, {_clip('(lat - 60e0) / 25e0')} AS f_lat, {_clip('(lon + 180e0) / 360e0')} AS f_lon"


def _network_sql() -> str:
    steps, names = [f"x0 AS (SELECT i, j, {_FIVE} FROM cells)"], _INPUTS
    for layer, size in enumerate((*training.HIDDEN, 3)):
        w = training.fixed_weights(len(names), size, layer)
        sums = [" + ".join(f"{n} * ({w[r][c]}::DOUBLE)" for r, n in enumerate(names)) for c in range(size)]
        own = [f"{s} AS o{c}" if size == 3 else f"greatest(0e0, {s}) AS h{layer}_{c}" for c, s in enumerate(sums)]
        steps.append(f"x{layer + 1} AS (SELECT i, j, {', '.join(own)} FROM x{layer})")
        names = [f"h{layer}_{c}" for c in range(size)]
    return ", ".join(steps)


@_query("m02_network_risk", f"WITH {t.CELLS}, {_network_sql()}, a AS (SELECT i, j, ln(1 + exp(o0)) + 1 AS a, ln(1 + exp(o1)) + 1 AS b, ln(1 + exp(o2)) + 1 AS c FROM x3) SELECT i, j, round(c / (a + b + c), 6) AS risk, round(3 / (a + b + c), 6) AS uncertainty FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = t.cells(spark, d)
    f = risk.model_features(F.col("lat"), F.col("lon"), F.col("sic"), F.col("wave"), F.col("thick"))
    rows = c.select("i", "j", *(F.coalesce(x, F.lit(0.0)).alias(n) for n, x in f.items()))
    return training.network_risk(rows, _INPUTS).select("i", "j", _r("risk", "risk"), _r("uncertainty", "uncertainty"))


@_query("m04_small_model", f"WITH {t.CELLS}, z AS (SELECT i, j, -5e-1 + 12e-1 * (coalesce(sic, 5e-1) - 5e-1) / 3e-1 + 8e-1 * (wave - 35e-1) / 2e0 AS z FROM cells), a AS (SELECT i, j, ln(1 + exp(-z)) + 1 AS s, ln(1 + exp(z)) + 1 AS r FROM z) SELECT i, j, round(1 - s / (s + r), 6) AS risk, round(2 / (s + r), 6) AS uncertainty FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = training.small_model(t.cells(spark, d), {"sic": (0.5, 0.3, 1.2), "wave": (3.5, 2.0, 0.8)}, -0.5)
    return m.select("i", "j", _r("risk", "risk"), _r("uncertainty", "uncertainty"))


@_query("a30_field_meanings", "SELECT DISTINCT field, CASE WHEN contains(lower(field), 'lat') THEN 'lat' WHEN contains(lower(field), 'lon') OR contains(lower(field), 'lng') THEN 'lon' WHEN contains(lower(field), 'mmsi') THEN 'mmsi' WHEN contains(lower(field), 'time') OR contains(lower(field), 'date') THEN 'time' WHEN contains(lower(field), 'sog') OR contains(lower(field), 'speed') THEN 'speed' WHEN contains(lower(field), 'cog') OR contains(lower(field), 'course') THEN 'course' WHEN contains(lower(field), 'type') THEN 'type' END AS meaning FROM (SELECT unnest([event_type || '_Time', event_type || 'Lng', 'Ship' || event_type, 'x_speed_' || event_type]) AS field FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_type")
    fields = t.points(spark, d).select(F.explode(F.array(F.concat(k, F.lit("_Time")), F.concat(k, F.lit("Lng")), F.concat(F.lit("Ship"), k), F.concat(F.lit("x_speed_"), k))).alias("field")).distinct()
    return records.field_meanings(fields)


@_query("a40_normalised", f"WITH {t.POINTS} SELECT mmsi, floor(epoch(ts))::BIGINT AS ts, lat, lon, sog FROM points WHERE point_id % 5 NOT IN (3, 4)")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("point_id") % 5
    seconds = F.unix_timestamp("ts")
    when = F.when(k == 0, seconds.cast("string")).when(k == 1, (seconds * 1000 + 123).cast("string")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, F.lit("soon")).otherwise(seconds.cast("string"))
    raw = t.points(spark, d).select(F.col("mmsi").cast("string").alias("MMSI"), when.alias("Timestamp"), F.when(k == 4, 95.0).otherwise(F.col("lat")).cast("string").alias("LAT"), F.col("lon").alias("Longitude"), F.col("sog").alias("SOG"))
    return records.normalised_records(raw, {"MMSI": "mmsi", "Timestamp": "ts", "Latitude": "lat", "Longitude": "lon", "SOG": "sog"}).select("mmsi", "ts", "lat", "lon", "sog")


@_query(
    "a41_encounters",
    f"""WITH {t.POINTS}, s AS (SELECT floor(epoch(ts) / 86400)::BIGINT AS slot, mmsi, arg_min({{'lat': lat, 'lon': lon, 'sog': sog, 'cog': cog}}, (ts, lat, lon, sog, cog)) AS p
 FROM (SELECT *, (point_id * 37 % 360)::DOUBLE AS cog FROM points) GROUP BY ALL),
g AS (SELECT a.slot, a.p AS p, b.p AS q, (b.p.lon - a.p.lon) * 11132e-2 * cos(radians((a.p.lat + b.p.lat) / 2)) AS x, (b.p.lat - a.p.lat) * 110574e-3 AS y FROM s a JOIN s b ON a.slot = b.slot AND a.mmsi < b.mmsi),
k AS (SELECT *, q.sog * 1852e-3 * sin(radians(q.cog)) - p.sog * 1852e-3 * sin(radians(p.cog)) AS vx, q.sog * 1852e-3 * cos(radians(q.cog)) - p.sog * 1852e-3 * cos(radians(p.cog)) AS vy FROM g WHERE x * x + y * y <= 300e0 * 300e0),
h AS (SELECT *, CASE WHEN vx * vx + vy * vy > 1e-9 THEN greatest(0e0, -(x * vx + y * vy) / (vx * vx + vy * vy)) ELSE 0e0 END AS t FROM k),
r AS (SELECT floor((p.lat + q.lat) / 2 / 4)::BIGINT AS ci, floor((p.lon + q.lon) / 2 / 4)::BIGINT AS cj, greatest(0e0, 1 - sqrt(pow(x + vx * t, 2) + pow(y + vy * t, 2)) / 300e0) AS risk FROM h)
SELECT ci, cj, round(avg(risk), 6) AS risk, round(max(risk), 6) AS worst, count(*) AS pairs FROM r GROUP BY ci, cj""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.points(spark, d).withColumn("cog", (F.col("point_id") * 37 % 360).cast("double"))
    return encounters.interaction_of_all(p, reach_km=300.0, minutes=1440, near_km=300.0, cell_deg=4.0).select("ci", "cj", _r("risk", "risk"), _r("worst", "worst"), "pairs")


_CONDITIONS = "k AS (SELECT event_id AS point_id, (event_id * 13 % 101)::DOUBLE AS iceberg, (event_id * 7 % 41)::DOUBLE AS wind, (event_id * 17 % 101)::DOUBLE AS ice, (event_id * 29 % 101)::DOUBLE AS congestion FROM events)"


@_query("t01_alerts", f"WITH {_CONDITIONS} SELECT point_id, 'iceberg' AS cause, 'Collision' AS kind, 'High' AS severity FROM k WHERE iceberg > 70 UNION ALL SELECT point_id, 'wind', 'Weather', 'Medium' FROM k WHERE wind > 30 UNION ALL SELECT point_id, 'ice', 'Weather', 'High' FROM k WHERE ice > 80 UNION ALL SELECT point_id, 'congestion', 'Traffic', 'Medium' FROM k WHERE congestion > 80")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("point_id")
    c = t.points(spark, d).select("point_id", *((k * a % m).cast("double").alias(n) for n, a, m in (("iceberg", 13, 101), ("wind", 7, 41), ("ice", 17, 101), ("congestion", 29, 101))))
    return records.alerts(c).select("point_id", "cause", "kind", "severity")


@_query("t02_in_water", f"WITH {t.POINTS} SELECT point_id, lat BETWEEN 66 AND 70 AND lon BETWEEN 10 AND 60 OR lat BETWEEN 72 AND 75 AND lon BETWEEN 100 AND 140 AS in_water FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.in_any_box(t.points(spark, d), [(66, 70, 10, 60), (72, 75, 100, 140)]).select("point_id", "in_water")


# fixed values: ports and way points of the demonstration
PORTS = [("MUR", 68.97, 33.08), ("SAB", 71.27, 72.07), ("TIK", 71.64, 128.87), ("PEV", 69.70, 170.27)]
WAYPOINTS = [("MUR-SAB", [(70.5, 45.0), (71.0, 60.0)])]
_PORTS = ", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE)" for p, a, b in PORTS)


@_query("t03_port_distances", f"WITH p AS (SELECT * FROM (VALUES {_PORTS}) p(port, lat, lon)), q AS (SELECT a.port AS a, b.port AS b, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS x FROM p a JOIN p b ON a.port < b.port) SELECT a, b, round(2 * 6371e0 * atan2(sqrt(x), sqrt(1 - x)))::BIGINT AS km FROM q")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame(PORTS, "port string, lat double, lon double")
    one, two = (p.select(F.col("port").alias(n), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}")) for k, n in ((1, "a"), (2, "b")))
    return records.port_distances(one.join(two, F.col("a") < F.col("b"))).select("a", "b", "km")


@_query("t04_waypoints", f"WITH p AS (SELECT * FROM (VALUES {_PORTS}) p(port, lat, lon)) SELECT a.port AS a, b.port AS b, CASE WHEN a.port = 'MUR' AND b.port = 'SAB' THEN 2 ELSE 2 END::INTEGER AS n, CASE WHEN a.port = 'MUR' AND b.port = 'SAB' THEN 705e-1 ELSE a.lat END AS first_lat FROM p a JOIN p b ON a.port < b.port")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame(PORTS, "port string, lat double, lon double")
    legs = p.select(F.col("port").alias("a")).join(p.select(F.col("port").alias("b")), F.col("a") < F.col("b"))
    known = spark.createDataFrame(WAYPOINTS, "key string, points array<struct<lat double, lon double>>")
    return records.waypoints(legs, p, known).select("a", "b", F.size("points").alias("n"), F.col("points")[0]["lat"].alias("first_lat"))


@_query("t05_base_conditions", f"WITH {t.POINTS} SELECT point_id, CASE WHEN lat - 70 > 0 THEN CASE WHEN month(ts) BETWEEN 5 AND 9 THEN -5 ELSE -25 END ELSE CASE WHEN month(ts) BETWEEN 5 AND 9 THEN 0 ELSE -15 END END AS temperature, CASE WHEN month(ts) BETWEEN 5 AND 9 THEN 15 ELSE 25 END AS wind FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.points(spark, d).select("point_id", *(c.alias(n) for n, c in records.base_conditions(F.col("lat") - 70, F.month("ts")).items()))


@_query("t06_clusters", f"WITH {t.POINTS} SELECT mmsi % 7 AS cluster, count(*) AS ships, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(sog), 6) AS mean_speed FROM points GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = records.cluster_summary(t.points(spark, d).withColumn("cluster", F.col("mmsi") % 7))
    return s.select("cluster", "ships", *(_r(c, c) for c in ("lat", "lon", "mean_speed")))


_over_cells(
    "t07_visibility",
    "CASE WHEN density < 33e-2 THEN 'Poor' WHEN density < 66e-2 THEN 'Moderate' ELSE 'Good' END AS visibility, ['Clear', 'Partly Cloudy', 'Overcast', 'Snow', 'Blizzard'][least(5, floor(density * 5)::INTEGER + 1)] AS forecast",
    lambda: {"visibility": records.visibility(F.col("density")), "forecast": records.forecast(F.col("density"))},
)


def _fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("i") * 7 + F.col("j") * 11
    cells = _demo_density(spark, d).withColumns({"ice_cost": risk.demo_ice_risk(F.col("lat"), F.col("is_land")), "wave_cost": k % 31 / 30.0, "risk_cost": k % 17 / 16.0, "uncertainty": k % 101 / 100.0})
    return planning.profile_fields(cells)


@_query("g04_profile_plans")
def _(spark: SparkSession, d: str) -> DataFrame:
    fields = _fields(spark, d)
    steps = demo_route(spark, fields.select("run_id", "i", "j", "lat", "lon", "cost")).drop("lat", "lon")
    return planning.run_table(steps.join(fields.drop("cost"), ["run_id", "i", "j"], "left"))


@_query("g04_profile_fields", f"""WITH {_DENSITY}, p AS (SELECT * FROM (VALUES ('efficient', 5e-1, 5e-1, 3e-1, 0e0), ('safe', 2e0, 15e-1, 1e0, 0e0), ('robust', 2e0, 15e-1, 1e0, 1e0)) p(run_id, fi, fw, fr, fu))
SELECT run_id, i, j, round(CASE WHEN NOT is_land THEN 1e0 + fi * CASE WHEN lat >= 75 THEN 4e0 ELSE 0e0 END + fw * ((i * 7 + j * 11) % 31 / 30e0) + fr * ((i * 7 + j * 11) % 17 / 16e0) + fu * ((i * 7 + j * 11) % 101 / 100e0) END, 6) AS cost FROM c9, p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("run_id", "i", "j", _r("cost", "cost"))
