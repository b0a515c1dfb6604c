"""Queries of searches over blocks of cells, with relaxation in recursive SQL as their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alignment, block_search, cost, grid, suite
from .plans import domain_tables as t
from .registry import _AT, _DENSITY, GOAL, START, _demo_density, _query, _r
from .registry_suite import SCENARIOS, scenarios
from .registry_training import _fields

# Relaxation over f (run_id, i, j, cost) from and to the cells of runs (run_id, si, sj, gi, gj).
_DISTANCES = """d(run_id, i, j, d) USING KEY (run_id, i, j) AS (SELECT run_id, si, sj, 0e0 FROM runs JOIN f USING (run_id) WHERE f.i = si AND f.j = sj
UNION SELECT f.run_id, f.i, f.j, min(p.d + sqrt((s.di * s.di + s.dj * s.dj)::DOUBLE) * f.cost) AS d FROM d p
 JOIN (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS di, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dj) s ON true JOIN f ON f.run_id = p.run_id AND f.i = p.i + s.di AND f.j = p.j + s.dj
 LEFT JOIN recurring.d r ON r.run_id = f.run_id AND r.i = f.i AND r.j = f.j
 GROUP BY f.run_id, f.i, f.j, r.d HAVING min(p.d + sqrt((s.di * s.di + s.dj * s.dj)::DOUBLE) * f.cost) < coalesce(r.d, 'inf'::DOUBLE))"""
_RELAX = f"""{_DISTANCES}
SELECT run_id, round(d, 6) AS search_cost FROM d JOIN runs USING (run_id) WHERE i = gi AND j = gj"""
_PROFILES = """pf AS (SELECT * FROM (VALUES ('efficient', 5e-1, 5e-1, 3e-1, 0e0), ('safe', 2e0, 15e-1, 1e0, 0e0), ('robust', 2e0, 15e-1, 1e0, 1e0)) p(mode, fi, fw, fr, fu)),
pc AS (SELECT mode, i, j, 1e0 + fi * CASE WHEN lat >= 75 THEN 4e0 ELSE 0e0 END + fw * ((i * 7 + j * 11) % 31 / 30e0) + fr * ((i * 7 + j * 11) % 17 / 16e0) + fu * ((i * 7 + j * 11) % 101 / 100e0) AS cost FROM c9, pf WHERE NOT is_land)"""


def _snapped(rows: list[tuple[str, float, float, float, float]]) -> str:
    """Ends of scenarios at their nearest ocean cells within ten rows and columns."""
    ends = ", ".join(f"('{name}', '{end}', {float(lat)}::DOUBLE, {float(lon)}::DOUBLE)" for name, a, b, c, d in rows for end, lat, lon in (("s", a, b), ("g", c, d)))
    return f"""ends AS (SELECT * FROM (VALUES {ends}) e(name, which, lat, lon)), near AS (SELECT name, which, lat, lon, {_AT.replace(' AS i', ' AS i0').replace(' AS j', ' AS j0')} FROM ends),
sea AS (SELECT id // 80 AS i, id % 80 AS j, 65 + (id // 80) * (15e0 / 39) AS clat, 0 + (id % 80) * (160e0 / 79) AS clon FROM (SELECT unnest(range(3200)) AS id) WHERE id % 80 < 70),
snap AS (SELECT name, which, i, j FROM near JOIN sea ON abs(i - i0) <= 10 AND abs(j - j0) <= 10 QUALIFY row_number() OVER (PARTITION BY name, which ORDER BY pow(clat - lat, 2) + pow(clon - lon, 2), i, j) = 1),
cases AS (SELECT a.name, a.i AS si, a.j AS sj, b.i AS gi, b.j AS gj FROM snap a JOIN snap b ON a.name = b.name AND a.which = 's' AND b.which = 'g')"""


_DEMO = _snapped([("demo", *START, *GOAL)])


def _demo_runs(spark: SparkSession, fields: DataFrame) -> DataFrame:
    one = spark.createDataFrame([("demo", *START, *GOAL)], "scenario_id string, start_lat double, start_lon double, end_lat double, end_lon double")
    at = suite.snapped(one, grid.demo_grid(spark), grid.DEMO).drop("scenario_id")
    return fields.select("run_id").distinct().crossJoin(F.broadcast(at))  # one row


def _costs(fields: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    return block_search.search_blocks(fields, runs, size).filter("seq = 0").select("run_id", _r("distance", "search_cost"))


@_query("g01_route_costs", f"""WITH RECURSIVE {_DENSITY}, {_DEMO}, w AS (SELECT unnest([0e0, 4e0, 8e0]) AS w), f AS (SELECT 'corridor ' || w::INTEGER AS run_id, i, j, 1e0 + CASE WHEN lat >= 75 THEN 4e0 ELSE 0e0 END + w * greatest(0e0, least(1e0, 1 - sqrt(density))) AS cost FROM c9, w WHERE NOT is_land),
runs AS (SELECT 'corridor ' || w::INTEGER AS run_id, si, sj, gi, gj FROM cases, w), {_RELAX}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = _demo_density(spark, d)
    weights = [cost.demo_cost(cells, weights=cost.TrafficWeights(corridor=w)).select(F.lit(f"corridor {w:g}").alias("run_id"), "i", "j", "cost") for w in (0.0, 4.0, 8.0)]
    fields = weights[0].union(weights[1]).union(weights[2])
    return _costs(fields, _demo_runs(spark, fields), 32)


@_query("g04_profile_costs", f"WITH RECURSIVE {_DENSITY}, {_PROFILES}, {_DEMO}, f AS (SELECT mode AS run_id, i, j, cost FROM pc), runs AS (SELECT mode AS run_id, si, sj, gi, gj FROM cases, pf), {_RELAX}")
def _(spark: SparkSession, d: str) -> DataFrame:
    fields = _fields(spark, d)
    return _costs(fields, _demo_runs(spark, fields), 32)


@_query("g06_suite_costs", f"WITH RECURSIVE {_DENSITY}, {_PROFILES}, {_snapped(SCENARIOS)}, f AS (SELECT name || '/' || mode AS run_id, i, j, cost FROM pc, cases), runs AS (SELECT name || '/' || mode AS run_id, si, sj, gi, gj FROM cases, pf), {_RELAX}")
def _(spark: SparkSession, d: str) -> DataFrame:
    fields = _fields(spark, d).select(F.col("run_id").alias("mode"), "i", "j", "cost")
    modes = fields.select("mode").distinct()
    runs = suite.snapped(scenarios(spark), grid.demo_grid(spark), grid.DEMO).crossJoin(F.broadcast(modes)).withColumn("run_id", F.concat_ws("/", "scenario_id", "mode"))  # a few scenarios and modes
    own = fields.join(runs.select("run_id", "mode"), "mode").drop("mode")
    return _costs(own, runs, 32)


@_query("g03_wide_search", f"WITH RECURSIVE {t.CELLS}, f AS (SELECT 'wide' AS run_id, i, j, 1 + wave / 2 + 4 * coalesce(sic, 0e0) AS cost FROM cells WHERE NOT is_land AND (i * 31 + j * 17) % 7 <> 0), runs AS (SELECT 'wide' AS run_id, 0 AS si, 1 AS sj, 20 AS gi, 341 AS gj), {_RELAX}")
def _(spark: SparkSession, d: str) -> DataFrame:
    passable = ~F.col("is_land") & ((F.col("i") * 31 + F.col("j") * 17) % 7 != 0)
    fields = t.cells(spark, d).filter(passable).select(F.lit("wide").alias("run_id"), "i", "j", (1 + F.col("wave") / 2 + 4 * F.coalesce("sic", F.lit(0.0))).alias("cost"))
    runs = fields.select("run_id").distinct().select("run_id", F.lit(0).alias("start_i"), F.lit(1).alias("start_j"), F.lit(20).alias("goal_i"), F.lit(341).alias("goal_j"))
    return _costs(fields, runs, 64)


@_query(
    "r03_density_resample",
    f"""WITH {_DENSITY}, s AS (SELECT i, j, lat AS clat, 0 + j * (160e0 / 79) AS clon, n FROM c9 WHERE NOT is_land), tg AS (SELECT id // 30 AS i, id % 30 AS j, 62 + (id // 30) * (20e0 / 19) AS lat, -8 + (id % 30) * (176e0 / 29) AS lon FROM (SELECT unnest(range(600)) AS id))
SELECT tg.i, tg.j, n AS value FROM tg JOIN s ON true QUALIFY row_number() OVER (PARTITION BY tg.i, tg.j ORDER BY (clat - lat) * (clat - lat) + (clon - lon) * (clon - lon), s.i, s.j) = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    source = _demo_density(spark, d).filter("not is_land").select("i", "j", "lat", "lon", F.col("n").alias("value"))
    return alignment.nearest_resample(source, grid.grid_cells(spark, grid.GridAxes(20, 30, 62.0, 82.0, -8.0, 168.0)))
