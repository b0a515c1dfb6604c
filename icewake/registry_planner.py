"""Queries of whole plans and configured scenarios, with routes walked back in recursive SQL as their oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import planner, search
from .operators.fleet import VESSEL_TYPES
from .operators.planner import COMPONENTS
from .plans import domain_tables as t
from .registry import _DENSITY, GOAL, START, _clip, _demo_density, _query, _r
from .registry_search import _DISTANCES

# fixed values: vessels (type, thickest ice in metres, share of it that is used)
VESSELS = {"handy": ("handysize", 0.3, 0.85), "panamax": ("panamax", 0.5, 0.90), "ice_class": ("capesize", 1.2, 0.95)}
# fixed values: scenarios (start, end, layers or not, wave weight, model weight, corridor and congestion weights, vessel)
SCENARIOS = [
    ("barents_to_chukchi_edl", 69.0, 33.0, 70.5, 170.0, True, 2.0, 4.0, 4.0, 1.6, "ice_class"),
    ("kara_short_efficient", 74.0, 60.0, 76.0, 90.0, True, 1.0, 0.0, 2.0, 0.8, "panamax"),
    ("southern_route_safe", 64.0, 35.0, 69.0, 110.0, True, 1.5, 3.0, 2.5, 1.0, "handy"),
    ("west_to_east_demo", 66.0, 5.0, 78.0, 150.0, False, 2.5, 0.0, 1.5, 0.6, "handy"),
    ("high_ais_density_case", 71.0, 10.0, 72.5, 60.0, True, 1.5, 0.0, 5.0, 2.0, "panamax"),
    ("high_uncertainty_case", 72.0, 40.0, 74.5, 140.0, True, 2.0, 3.5, 2.5, 1.0, "ice_class"),
]
VOYAGE = [(name, *START, *GOAL, layers, 1.0, 2.0, 4.0, 1.0, "panamax") for name, layers in (("with layers", True), ("without", False))]


def _requests(rows: list[tuple]) -> list[tuple]:
    at = lambda v: (*VESSEL_TYPES[VESSELS[v][0]][2:], *VESSELS[v][1:])
    return [(*r[:-1], *at(r[-1])) for r in rows]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The demonstration grid under the traffic of the points, with layers made from cell numbers, hardly any two of them alike."""
    k = F.col("i") * 7919 + F.col("j") * 104729
    return _demo_density(spark, d).withColumns({
        "density": (F.col("density") + k * 17 % 1019 / 1018.0) / 2, "sic": k % 1013 / 1012.0, "wave": (F.col("i") * 13 + F.col("j") * 29) % 71 / 10.0,
        "thick": (F.col("i") * 7 + F.col("j") * 11) % 31 / 100.0, "risk": k % 1009 / 1008.0, "uncertainty": k * 31 % 997 / 996.0,
    })


_CELLS = """k9 AS (SELECT *, i * 7919 + j * 104729 AS k FROM c9), g9 AS (SELECT i, j, lat, 0 + j * (160e0 / 79) AS lon, is_land, (density + k * 17 % 1019 / 1018e0) / 2 AS density, k % 1013 / 1012e0 AS sic,
 (i * 13 + j * 29) % 71 / 1e1 AS wave, (i * 7 + j * 11) % 31 / 1e2 AS thick, k % 1009 / 1008e0 AS risk, k * 31 % 997 / 996e0 AS uncertainty FROM k9), p9 AS (SELECT quantile_cont(density, 0.9) AS p90 FROM g9 WHERE NOT is_land)"""
_SHOWN = ["distance_km", "total_cost", "search_cost", *COMPONENTS, "mean_uncertainty", "hours", "fuel", "co2", "norm_distance", "norm_fuel", "norm_risk", "norm_uncertainty"]


def _sql(rows: list[tuple], weights: tuple[float, float, float]) -> str:
    """All plans of ``rows`` over g9: weights, fields, relaxation, the way back from each goal, sums and scores."""
    text = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x!r}::DOUBLE"
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in _requests(rows))
    sums = ", ".join(f"coalesce(sum({c}), 0e0) AS {c}" for c in COMPONENTS)
    norm = lambda n, c: f"coalesce((round(coalesce({c}, 0e0), 9) - min(round(coalesce({c}, 0e0), 9)) OVER w) / nullif(max(round(coalesce({c}, 0e0), 9)) OVER w - min(round(coalesce({c}, 0e0), 9)) OVER w, 0e0), 0e0) AS {n}"
    norms = ", ".join(norm(n, c) for n, c in (("norm_distance", "distance_km"), ("norm_fuel", "fuel"), ("norm_risk", "model_risk"), ("norm_uncertainty", "model_uncertainty")))
    return f"""WITH RECURSIVE {_DENSITY}, {_CELLS}, rq AS (SELECT * FROM (VALUES {values}) v(request, slat, slon, elat, elon, use_layers, wp, wm, wc, wj, kn, per_km, max_ice, margin)),
pf AS (SELECT * FROM (VALUES ('efficient', 0, 5e-1, 5e-1, 3e-1, 0e0), ('safe', 1, 2e0, 15e-1, 1e0, 0e0), ('robust', 2, 2e0, 15e-1, 1e0, 1e0)) p(mode, place, fi, fw, fr, fu)),
ends AS (SELECT request, 's' AS which, slat AS plat, slon AS plon FROM rq UNION ALL SELECT request, 'g', elat, elon FROM rq),
snap AS (SELECT request, which, i, j FROM ends, g9 WHERE NOT is_land QUALIFY row_number() OVER (PARTITION BY request, which ORDER BY (lat - plat) * (lat - plat) + (lon - plon) * (lon - plon), i, j) = 1),
rn AS MATERIALIZED (SELECT rq.request || '/' || mode AS run_id, rq.*, pf.*, greatest(1e-2, max_ice * margin) AS lim, a.i AS si, a.j AS sj, b.i AS gi, b.j AS gj FROM rq, pf, snap a, snap b WHERE a.request = rq.request AND b.request = rq.request AND a.which = 's' AND b.which = 'g'),
fl AS MATERIALIZED (SELECT run_id, i, j, lat, lon, is_land, uncertainty, NOT is_land AND NOT (use_layers AND thick > lim) AS passable, 1e0 AS base_distance,
 4 * fi * CASE WHEN use_layers THEN pow({_clip('sic')}, 15e-1) WHEN lat >= 75 THEN 1e0 ELSE 0e0 END AS ice_risk, CASE WHEN use_layers THEN wp * fw * pow({_clip('wave', hi='10e0')} / 6e0, 2e0) ELSE 0e0 END AS wave_risk,
 CASE WHEN use_layers THEN wm * fr * risk ELSE 0e0 END AS model_risk, CASE WHEN use_layers AND wm > 0 THEN fu * uncertainty ELSE 0e0 END AS model_uncertainty,
 CASE WHEN use_layers AND thick > lim * 7e-1 AND thick <= lim THEN 3e0 * pow((thick - lim * 7e-1) / (lim - lim * 7e-1), 2) ELSE 0e0 END AS ice_class_soft,
 wc * greatest(0e0, least(1e0, 1 - sqrt(density))) AS ais_corridor, wj * pow(greatest(0e0, density - p90) / greatest(1e-6, 1 - p90), 2) AS ais_congestion FROM g9, p9, rn),
f AS MATERIALIZED (SELECT run_id, i, j, base_distance + ice_risk + wave_risk + model_risk + model_uncertainty + ice_class_soft + ais_corridor + ais_congestion AS cost FROM fl WHERE passable), runs AS (SELECT run_id, si, sj, gi, gj FROM rn), {_DISTANCES}, e AS MATERIALIZED (SELECT * FROM d),
way AS MATERIALIZED (SELECT c.run_id, c.i, c.j, p.i AS pi, p.j AS pj FROM e c JOIN f USING (run_id, i, j) JOIN (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS di, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dj) s ON true JOIN e p ON p.run_id = c.run_id AND p.i = c.i + s.di AND p.j = c.j + s.dj
 QUALIFY row_number() OVER (PARTITION BY c.run_id, c.i, c.j ORDER BY p.d + sqrt((s.di * s.di + s.dj * s.dj)::DOUBLE) * f.cost, p.i, p.j) = 1),
back AS (SELECT runs.run_id, gi AS i, gj AS j, 0 AS n FROM runs JOIN e ON e.run_id = runs.run_id AND e.i = gi AND e.j = gj
 UNION ALL SELECT back.run_id, way.pi, way.pj, n + 1 FROM back JOIN runs ON runs.run_id = back.run_id JOIN way ON way.run_id = back.run_id AND way.i = back.i AND way.j = back.j WHERE NOT (back.i = si AND back.j = sj)),
st AS (SELECT fl.*, n, pow(sin(radians(lag(lat) OVER b - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lag(lat) OVER b)) * pow(sin(radians(lag(lon) OVER b - lon) / 2), 2) AS x FROM back JOIN fl USING (run_id, i, j) WINDOW b AS (PARTITION BY run_id ORDER BY n)),
ms AS (SELECT run_id, count(*) AS steps, count(*) FILTER (WHERE is_land) AS on_land, coalesce(sum(12742 * asin(sqrt(x))), 0e0) AS distance_km, avg(uncertainty) AS mean_uncertainty, {sums} FROM st GROUP BY run_id),
al AS (SELECT rn.request, mode, place, use_layers, steps, on_land, distance_km, mean_uncertainty, e.d AS search_cost, kn, per_km, {', '.join(f'coalesce({c}, 0e0) AS {c}' for c in COMPONENTS)} FROM rn LEFT JOIN ms USING (run_id) LEFT JOIN e ON e.run_id = rn.run_id AND e.i = gi AND e.j = gj),
ec AS (SELECT *, {' + '.join(COMPONENTS)} AS total_cost, coalesce(distance_km / (kn * 1852e-3), 0e0) AS hours, coalesce(distance_km * per_km, 0e0) AS fuel, coalesce(distance_km * per_km, 0e0) * 3114e-3 AS co2 FROM al),
nm AS (SELECT *, {norms} FROM ec WINDOW w AS (PARTITION BY request)), sc AS (SELECT *, round({weights[2]!r}::DOUBLE * norm_fuel + {weights[0]!r}::DOUBLE * norm_risk + {weights[1]!r}::DOUBLE * norm_uncertainty, 9) AS score FROM nm)
SELECT request, mode, CASE WHEN use_layers THEN 'layers' ELSE 'belt' END AS source, steps IS NOT NULL AS reachable, coalesce(steps, 0) AS steps, coalesce(on_land, 0) AS on_land, {', '.join(f'round({c}, 5) AS {c}' for c in _SHOWN)}, round(score, 5) AS score,
 row_number() OVER (PARTITION BY request ORDER BY score, place) = 1 AS recommended FROM sc"""


def _rounded(c: str, digits: int) -> Column:
    """As the SQL rounds: the scaled double to the nearest integer, half away from zero; Spark's ``round`` goes by the decimal digits."""
    x = F.col(c) * 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) + 0.5) / 10.0**digits


def _plans(spark: SparkSession, d: str, rows: list[tuple], weights: tuple[float, float, float]) -> DataFrame:
    plans, _ = planner.plan(_cells(spark, d), planner.request_table(spark, _requests(rows)), weights, size=32)
    return plans.select("request", "mode", "source", "reachable", "steps", "on_land", *(_rounded(c, 5).alias(c) for c in (*_SHOWN, "score")), "recommended")


@_query("g04_whole_plans", _sql(VOYAGE, (0.33, 0.33, 0.34)))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d, VOYAGE, (0.33, 0.33, 0.34))


@_query("g06_configured_scenarios", _sql(SCENARIOS, (1.0, 1.0, 1.0)))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d, SCENARIOS, (1.0, 1.0, 1.0))


SWEEP = [(f"corridor {w:g}", *START, *GOAL, True, 1.0, 2.0, w, 0.0, "panamax") for w in (0.0, 4.0, 8.0)]


def _walked(rows: list[tuple], select: str) -> str:
    """The same up to the way back, then ``select`` over ``back``, whose n counts from the goal."""
    return f"{_sql(rows, (1.0, 1.0, 1.0)).split(chr(10) + 'st AS (')[0].rstrip(',')} {select}"


def _steps(spark: SparkSession, d: str, rows: list[tuple]) -> DataFrame:
    return planner.plan(_cells(spark, d), planner.request_table(spark, _requests(rows)), size=32)[1].filter("seq >= 0")


@_query("g02_route_steps", _walked(VOYAGE, "SELECT run_id, max(n) OVER (PARTITION BY run_id) - n AS seq, i, j, round(cost, 6) AS step_cost FROM back JOIN f USING (run_id, i, j)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d, VOYAGE).select("run_id", "seq", "i", "j", _r("step_cost", "step_cost"))


@_query("g07_path_changes", _walked(SWEEP, ", b AS (SELECT run_id, list((i, j) ORDER BY n) AS path FROM back GROUP BY run_id) SELECT run_id, path <> (SELECT path FROM b WHERE run_id = 'corridor 0/efficient') AS path_changed FROM b"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.path_changes(_steps(spark, d, SWEEP), "corridor 0/efficient")


_REASONS = ("", "no_ice_layer", "no_layers", "no_mask", "shape_mismatch")


@_query(
    "c20_fallback_reasons",
    f"""WITH {t.CELLS}, r AS (SELECT unnest([{', '.join(f"'{r}'" for r in _REASONS)}]) AS reason), x AS (SELECT *, is_land AND reason <> 'no_mask' AS shut FROM cells, r)
SELECT reason, CASE WHEN reason = '' THEN 'layers' ELSE 'belt' END AS source, i, j, round(CASE WHEN NOT shut THEN 1e0 + CASE WHEN reason = '' THEN 4e0 * coalesce(pow({_clip('sic')}, 15e-1), 0e0) + coalesce(pow({_clip('wave', hi='10e0')} / 6e0, 2e0), 0e0)
 WHEN lat >= 75 THEN 4e0 ELSE 0e0 END END, 6) AS cost FROM x""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = t.cells(spark, d)
    layer = lambda c: cells.select("i", "j", F.col(c).alias("value"))
    mask, none = cells.select("i", "j", "is_land"), layer("sic").withColumn("value", F.lit(None).cast("double"))
    given = {"": (mask, layer("sic"), layer("wave")), "no_ice_layer": (mask, None, layer("wave")), "no_layers": (mask, none, None), "no_mask": (None, layer("sic"), layer("wave")), "shape_mismatch": (mask, layer("sic").filter("j < 399"), layer("wave"))}
    plain = planner.run_list(planner.request_table(spark, [("all", None, None, None, None, True, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)]), (planner.Profile("plain"),))
    out = None
    for mask_of, sic, wave in given.values():
        rows, why = planner.placed_layers(cells, mask_of, {"sic": sic, "wave": wave})
        own = planner.run_fields(rows, plain, why).select("reason", "source", "i", "j", _r("cost", "cost"))
        out = own if out is None else out.unionByName(own)
    return out
