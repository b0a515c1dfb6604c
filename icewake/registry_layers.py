"""Queries of layers on disk, masks, and evidential models, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alignment, evidence, training
from .plans import domain_tables as t
from .registry import _query, _r
from .sources import layers
from .sources.scratch import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query("s20_layer_round_trip", f"WITH {t.CELLS} SELECT i, j, density AS value, format('{{}}x{{}}', max(i) OVER () + 1, max(j) OVER () + 1) AS shape FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "layer")
    sign = layers.write_layer(t.cells(spark, d).select("i", "j", "lat", "lon", F.col("density").alias("value")), path, {"from": "events"})
    return layers.read_layer(spark, path, sign).select("i", "j", "value", F.lit(sign.split("_")[0]).alias("shape"))


@_query("s22_parquet_glob", f"WITH {t.POINTS} SELECT point_id, mmsi % 3 AS part FROM points WHERE mmsi % 3 <> 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "glob")
    t.points(spark, d).select("point_id", (F.col("mmsi") % 3).alias("part")).write.partitionBy("part").parquet(path)
    found = layers.read_parquet_glob(spark, f"{path}/part=[02]/*.parquet")
    return found.select("point_id", F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"))


_KINDS = {"density": "density", "waves": "wave"}


@_query(
    "s28_file_scan",
    f"""WITH {t.POINTS}, f AS (SELECT '2024' || lpad((point_id % 12 + 1)::VARCHAR, 2, '0') AS ym, CASE point_id % 3 WHEN 0 THEN 'density' WHEN 1 THEN 'wave' ELSE 'block' END AS type, string_agg(point_id::VARCHAR || chr(10), '' ORDER BY point_id) AS content FROM points GROUP BY ALL)
SELECT ym, type, strlen(content) AS size, sha1(content) AS sha1 FROM f""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path, k = _folder(spark, "files"), F.col("point_id")
    name = F.concat(F.lit("2024"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.when(k % 3 == 0, "_density").when(k % 3 == 1, "_waves").otherwise("_other"))
    rows = t.points(spark, d).select(name.alias("name"), k.cast("string").alias("value"), k)
    rows.repartition("name").sortWithinPartitions("name", "point_id").select("name", "value").write.partitionBy("name").text(path)
    return layers.scan_files(spark, f"{path}/name=*", _KINDS).filter(~F.col("path").endswith("_SUCCESS")).select("ym", "type", "size", "sha1")


_MASK = "m AS (SELECT i, j, lat, lon, (i * 7 + j * 3) % 5 = 0 AS is_land FROM cells)"


@_query(
    "s14_mask_chain",
    f"""WITH {t.CELLS}, {_MASK}, o AS (SELECT max(i) + 1 AS ny, max(j) + 1 AS nx FROM m),
a AS (SELECT i, j, is_land, 'same_shape' AS rung FROM m),
b AS (SELECT c.i, c.j, m.is_land, 'index' AS rung FROM (SELECT i, j FROM cells WHERE i < 20 AND j < 50) c, o JOIN m ON m.i = round_even(c.i * ((ny - 1) / 19e0), 0) AND m.j = round_even(c.j * ((nx - 1) / 49e0), 0)),
s AS (SELECT * FROM m WHERE i < 10 AND j % 4 = 1),
e AS (SELECT i, j, is_land, 'nearest' AS rung FROM (SELECT c.i, c.j, s.is_land, row_number() OVER (PARTITION BY c.i, c.j ORDER BY (s.lat - c.lat) * (s.lat - c.lat) + (s.lon - c.lon) * (s.lon - c.lon), s.i, s.j) AS r FROM (SELECT * FROM cells WHERE i < 20 AND j < 50) c, s) WHERE r = 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE (SELECT ny >= 20 FROM o) UNION ALL SELECT * FROM e WHERE (SELECT ny >= 20 FROM o)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = t.cells(spark, d).select("i", "j", "lat", "lon")
    mask = cells.withColumn("is_land", (F.col("i") * 7 + F.col("j") * 3) % 5 == 0)
    small = cells.filter("i < 20 and j < 50")
    same = alignment.mask_for(mask, cells)
    if cells.agg(F.max("i")).first()[0] < 19:  # the two other rungs are shown on a part of 20 x 50 cells
        return same
    bare = mask.withColumns({"lat": F.lit(None).cast("double")})
    return same.unionByName(alignment.mask_for(bare, small)).unionByName(alignment.mask_for(mask.filter("i < 10 and j % 4 = 1"), small))


@_query("f05_full_export", f"WITH {t.CELLS} SELECT i, j, coalesce(sic, 0e0) AS sic, wave, 0e0 AS drift, 8 AS month, 1 AS vessel_class, 220 AS day, CASE WHEN density > 5e-1 THEN 1 ELSE 0 END AS label FROM cells WHERE NOT is_land AND (density > 5e-1 OR density = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    from .operators import density

    cells = t.cells(spark, d)
    return training.full_export(cells, density.traffic_labels(cells, "density", 0.5), ["sic", "wave", "drift"], _folder(spark, "export"))


_ALPHAS = "p AS (SELECT i, j, 11e-1 + 9 * coalesce(sic, 0e0) AS a, 1 + wave AS b, 1 + 2 * coalesce(thick, 0e0) AS c, (i + j) % 3 AS y FROM cells)"


def _slope(x: str) -> str:
    """Digamma in SQL: a five-point derivative of lgamma."""
    return f"((8 * (lgamma({x} + 1e-3) - lgamma({x} - 1e-3)) - (lgamma({x} + 2e-3) - lgamma({x} - 2e-3))) / 12e-3)"


@_query(
    "m05_loss_terms",
    f"""WITH {t.CELLS}, {_ALPHAS}, s AS (SELECT *, a + b + c AS s FROM p)
SELECT i, j, round(((y = 0)::INT - a / s) * ((y = 0)::INT - a / s) + ((y = 1)::INT - b / s) * ((y = 1)::INT - b / s) + ((y = 2)::INT - c / s) * ((y = 2)::INT - c / s), 6) AS mse, round((a / s * (1 - a / s) + b / s * (1 - b / s) + c / s * (1 - c / s)) / (s + 1), 6) AS variance,
 round(lgamma(s) - lgamma(3) - lgamma(a) - lgamma(b) - lgamma(c) + (a - 1) * ({_slope('a')} - {_slope('s')}) + (b - 1) * ({_slope('b')} - {_slope('s')}) + (c - 1) * ({_slope('c')} - {_slope('s')}), 4) AS divergence FROM s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0.0)
    p = t.cells(spark, d).select("i", "j", (1.1 + 9 * F.coalesce("sic", zero)).alias("a"), (1 + F.col("wave")).alias("b"), (1 + 2 * F.coalesce("thick", zero)).alias("c"), ((F.col("i") + F.col("j")) % 3).alias("y"))
    return evidence.loss_terms(p, ["a", "b", "c"], "y").select("i", "j", _r("mse", "mse"), _r("variance", "variance"), F.round("divergence", 4).alias("divergence"))


# The network of the small model, 5-32-16-2, with weights from a rule.
_FEATURES = ["sic", "wave", "thick", "lat", "lon"]
_SIZES = (32, 16, 2)
_SCALED = {"sic": (0.5, 0.3), "wave": (3.5, 2.0)}


def _weights() -> list[tuple[int, int, int, float]]:
    out, inputs = [], len(_FEATURES)
    for layer, size in enumerate(_SIZES):
        w = training.fixed_weights(inputs, size, layer)
        out += [(layer, r, c, w[r][c] / (100 if layer == 0 and r > 2 else 1)) for r in range(inputs) for c in range(size)]
        out += [(layer, -1, c, round(0.01 * (c % 5 - 2), 6)) for c in range(size)]
        inputs = size
    return out


def _small_network_sql() -> str:
    w = {(a, b, c): v for a, b, c, v in _weights()}
    x = [f"(coalesce({c}, 0e0) - {m}::DOUBLE) / {s}::DOUBLE" for c, (m, s) in _SCALED.items()]
    names, steps, before = [f"f{k}" for k in range(5)], [f"y0 AS (SELECT i, j, {x[0]} AS f0, {x[1]} AS f1, coalesce(thick, 0e0) AS f2, lat AS f3, lon AS f4 FROM cells)"], 0
    for layer, size in enumerate(_SIZES):
        sums = [" + ".join([f"({w[layer, -1, c]!r}::DOUBLE)", *(f"{n} * ({w[layer, r, c]!r}::DOUBLE)" for r, n in enumerate(names))]) for c in range(size)]
        own = [f"{s} AS o{c}" if layer == 2 else f"greatest(0e0, {s}) AS g{layer}_{c}" for c, s in enumerate(sums)]
        steps.append(f"y{layer + 1} AS (SELECT i, j, {', '.join(own)} FROM y{before})")
        names, before = [f"g{layer}_{c}" for c in range(size)], layer + 1
    return ", ".join(steps)


def _network(spark: SparkSession) -> evidence.Network:
    return evidence.Network.from_table(spark.createDataFrame(_weights(), "layer int, input int, output int, value double"), _FEATURES, _SCALED)


_SMALL = f"{_small_network_sql()}, ya AS (SELECT i, j, ln(1 + exp(o0)) + 1 AS a, ln(1 + exp(o1)) + 1 AS b FROM y3)"


@_query("m04_small_network", f"WITH {t.CELLS}, {_SMALL} SELECT i, j, round(1 - b / (a + b), 6) AS risk, round(2 / (a + b), 6) AS uncertainty FROM ya")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evidence.network_risk(t.cells(spark, d), _network(spark)).select("i", "j", _r("risk", "risk"), _r("uncertainty", "uncertainty"))


@_query(
    "m03_provided_risk",
    f"""WITH {t.CELLS}, {_SMALL} SELECT i, j, round(1 - b / (a + b), 6) AS risk, round(2 / (a + b), 6) AS uncertainty, 'small_network' AS source, '' AS reason FROM ya
UNION ALL SELECT i, j, CASE WHEN j % 2 = 0 THEN density ELSE 0 END, CASE WHEN j % 2 = 0 THEN least(1e0, wave / 5) ELSE 1 END, 'external', 'no_network' FROM cells
UNION ALL SELECT i, j, 0e0, 5e-1, 'placeholder', 'no_network,no_external' FROM cells""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = t.cells(spark, d)
    external = cells.filter("j % 2 = 0").select("i", "j", F.col("density").alias("risk"), (F.col("wave") / 5).alias("uncertainty"))
    runs = [evidence.provided_risk(cells, _network(spark), external), evidence.provided_risk(cells, None, external), evidence.provided_risk(cells, None, external.limit(0))]
    rows = [r.select("i", "j", "risk", "uncertainty", "source", "reason") for r in runs]
    first = rows[0].withColumns({c: F.round(c, 6) for c in ("risk", "uncertainty")})
    return first.unionByName(rows[1]).unionByName(rows[2])
