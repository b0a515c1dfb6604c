"""Queries over scenario suites, layers and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cost, density, grid, inventory, modes, planning, suite
from .plans import domain_tables as t
from .registry import _AT, _COMPARED, _clip, _query, _r
from .registry_evaluation import _FILES, _files
from .registry_training import _fields

# fixed values: the demonstration's scenarios
SCENARIOS = [
    ("barents_to_chukchi", 69.0, 33.0, 70.5, 170.0),
    ("kara_short", 73.0, 60.0, 76.0, 120.0),
    ("southern_route", 60.0, 30.0, 68.0, 90.0),
    ("west_to_east_demo", 66.0, 5.0, 78.0, 150.0),
]


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario_id string, start_lat double, start_lon double, end_lat double, end_lon double")


@_query("g05_cases")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.demo_grid(spark)
    fields = [cost.demo_cost(cells, p).withColumn("run_id", F.lit(f"penalty {p:g}")) for p in (2.0, 4.0, 8.0)]
    steps = suite.suite(scenarios(spark), fields[0].union(fields[1]).union(fields[2]), cells, grid.DEMO)
    return suite.suite_table(steps, ["base_distance", "ice_risk"])


def _suite(spark: SparkSession, d: str) -> DataFrame:
    return suite.suite(scenarios(spark), _fields(spark, d), grid.demo_grid(spark), grid.DEMO)


@_query("g06_scenario_suite")
def _(spark: SparkSession, d: str) -> DataFrame:
    return suite.suite_table(_suite(spark, d), ["p_ice", "p_wave", "p_risk", "p_uncertainty"])


@_query("g08_mode_uncertainty")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = suite.suite_table(_suite(spark, d), ["p_risk", "p_uncertainty"])
    return rows.select("scenario_id", "mode", "reachable", "p_risk_total", "p_uncertainty_total", "mean_uncertainty", "max_uncertainty")


@_query("g13_modes_and_density")
def _(spark: SparkSession, d: str) -> DataFrame:
    fields = planning.with_traffic_component(_fields(spark, d), "density", 1.0)
    return suite.density_by_mode(suite.suite(scenarios(spark), fields, grid.demo_grid(spark), grid.DEMO), 0.2, 0.8)


_VESSEL = f"""CASE WHEN NOT (is_land OR coalesce(thick > l, false)) THEN 1e0 + coalesce(4e0 * pow({_clip('sic')}, 15e-1), 0e0) + pow({_clip('wave', hi='10e0')} / 6e0, 2e0)
 + coalesce(CASE WHEN thick > l * 7e-1 AND thick <= l THEN 3e0 * pow((thick - l * 7e-1) / (l - l * 7e-1), 2) ELSE 0e0 END, 0e0) END"""


@_query(
    "c20_cost_or_demo",
    f"""WITH {t.CELLS}, l AS (SELECT *, 5e-1 * 9e-1 AS l FROM cells) SELECT 'with' AS layers, true AS real, i, j, round({_VESSEL}, 6) AS cost FROM l
UNION ALL SELECT 'without', false, i, j, CASE WHEN NOT is_land THEN 1e0 + CASE WHEN lat >= 75 THEN 4e0 ELSE 0e0 END END FROM cells""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = t.cells(spark, d)
    made = [suite.cost_or_demo(c, 0.5, 0.9).select(F.lit(n).alias("layers"), "real", "i", "j", _r("cost", "cost")) for n, c in (("with", cells), ("without", cells.withColumn("sic", F.lit(None).cast("double"))))]
    return made[0].union(made[1])


@_query(
    "s19_chosen_density",
    f"""WITH {_FILES}, m AS (SELECT DISTINCT ym FROM named), b AS (SELECT ym, path FROM named WHERE NOT lower(path) LIKE '%train%'
 QUALIFY row_number() OVER (PARTITION BY ym ORDER BY CASE WHEN path LIKE 'merged/%' THEN 0 WHEN path LIKE 'demo/%' THEN 1 ELSE 2 END, mtime DESC, path) = 1)
SELECT m.ym, coalesce(b.path, 'none') AS path FROM m LEFT JOIN b ON m.ym = b.ym""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return suite.chosen_density(_files(spark, d), F.col("path").startswith("merged/"), F.col("path").startswith("demo/"), fallback="none")


@_query("a53_expired_files", f"WITH {_FILES} SELECT path, mtime FROM named WHERE mtime < 1009 - 300 AND ym <> '199601'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inventory.expired(_files(spark, d), 1009, 300, protected=("199601",)).select("path", "mtime")


_DAYS = f"{t.POINTS}, p AS (SELECT {_AT}, date_trunc('day', ts) AS time, sog FROM points), c AS (SELECT i, j, time, max(sog) AS sog FROM p GROUP BY ALL)"


@_query("s12_layer_step", f"WITH {_DAYS}, k AS (SELECT i, j, sog FROM c QUALIFY dense_rank() OVER (ORDER BY time) = 3) SELECT i, j, greatest(0e0, least(1e0, CASE WHEN (SELECT max(sog) FROM k) > 15e-1 THEN sog / 1e2 ELSE sog END)) AS value FROM k")
def _(spark: SparkSession, d: str) -> DataFrame:
    at = density.points_to_cells(t.points(spark, d), grid.DEMO).withColumn("time", F.date_trunc("day", "ts"))
    return suite.layer(at.groupBy("i", "j", "time").agg(F.max("sog").alias("sog")), ["sic", "ice_concentration", "sog"], 2)


@_query("s27_month_slice", f"WITH {t.POINTS}, p AS (SELECT {_AT}, ts, point_id, sog FROM points WHERE strftime(ts, '%Y%m') = '202401') SELECT i, j, sog AS sic_pred FROM p QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY ts, point_id) = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return suite.month_slice(density.points_to_cells(t.points(spark, d), grid.DEMO), "202401", "sog", ["ts", "point_id"])


@_query("s30_line_points", f"WITH {t.POINTS} SELECT point_id, 0 AS seq, lat, lon FROM points WHERE point_id % 4 <> 3 UNION ALL SELECT point_id, 1, lat, lon + 1 FROM points WHERE point_id % 4 <> 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("point_id") % 4
    line = F.format_string('{"type": "LineString", "coordinates": [[%s, %s], [%s, %s]]}', F.col("lon").cast("string"), F.col("lat").cast("string"), (F.col("lon") + 1).cast("string"), F.col("lat").cast("string"))
    feature = F.concat(F.lit('{"type": "Feature", "properties": {}, "geometry": '), line, F.lit("}"))
    whole = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), feature, F.lit("]}"))
    texts = t.points(spark, d).select("point_id", F.when(k == 0, whole).when(k == 1, feature).when(k == 2, line).otherwise("[no JSON").alias("text"))
    return suite.line_points(texts, "point_id", "text")


@_query("s35_reported", f"WITH {_COMPARED} SELECT scenario_id, mode, delta_km AS dist_km, NULL::VARCHAR AS cost_pct, round(risk_reduction_pct, 6) + 0e0 AS risk_reduction FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = suite.reported(modes.compare(t.results(spark, d)).withColumnRenamed("delta_km", "D_Dist_km"), ["scenario_id", "mode"])
    return rows.select("scenario_id", "mode", "dist_km", "cost_pct", (F.round("risk_reduction", 6) + F.lit(0.0)).alias("risk_reduction"))


@_query("s36_report_lines", f"WITH {_COMPARED} SELECT '| ' || scenario_id || ' | ' || mode || ' | ' || delta_km::BIGINT || ' |' AS line FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = modes.compare(t.results(spark, d)).withColumn("delta_km", F.col("delta_km").cast("long"))
    return suite.report_lines(rows, ["scenario_id", "mode", "delta_km"])


_PEAK = "exp(-(pow(j - 64 * {x}, 2) + pow(i - 64 * {y}, 2)) / (2e0 * pow(64 * {w}, 2)))"


@_query(
    "s34_demo_raster",
    f"""WITH g AS (SELECT id // 64 AS i, id % 64 AS j FROM (SELECT unnest(range(4096)) AS id)),
r AS (SELECT i, j, {_PEAK.format(x='25e-2', y='35e-2', w='12e-2')} + 8e-1 * {_PEAK.format(x='7e-1', y='6e-1', w='18e-2')} - 2e-1 * {_PEAK.format(x='5e-1', y='8e-1', w='5e-1')} AS raw FROM g)
SELECT i, j, round((raw - (SELECT min(raw) FROM r)) / ((SELECT max(raw) FROM r) - (SELECT min(raw) FROM r)), 6) AS value FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return suite.demo_raster(spark).select("i", "j", _r("value", "value"))
