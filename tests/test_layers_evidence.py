"""Layers with manifests, file scans, masks, and evidential models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from icewake.functions import special
from icewake.operators import alignment, evidence, training
from icewake.sources import layers


def cells(spark, ny=3, nx=4):
    return spark.range(ny * nx).select(F.expr(f"id div {nx}").alias("i"), (F.col("id") % nx).alias("j"), (60.0 + F.expr(f"id div {nx}")).alias("lat"), (10.0 + F.col("id") % nx).alias("lon"), (F.col("id") / 7).alias("value"))


def test_layers_come_back_whole_and_others_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/density"
    sign = layers.write_layer(cells(spark), path, {"points": "42", "by": "test"})
    assert sign == "3x4_60.0000_62.0000_10.0000_13.0000"
    assert sorted(tuple(r) for r in layers.read_layer(spark, path, sign).collect()) == sorted(tuple(r) for r in cells(spark).collect())
    told = layers.read_manifest(spark, path).first()
    assert told["cells"] == 12 and told["provenance"] == {"points": "42", "by": "test"}
    with pytest.raises(layers.SignatureMismatch):
        layers.read_layer(spark, path, "9x9_0.0000_1.0000_0.0000_1.0000")
    with pytest.raises(Exception):
        layers.write_layer(cells(spark), path)
    cells(spark).limit(1).select("i", "j", "lat", "lon", "value").write.mode("append").parquet(f"{path}/cells/grid={sign}")
    with pytest.raises(layers.SignatureMismatch):
        layers.read_layer(spark, path, sign)
    with pytest.raises(layers.SignatureMismatch):
        layers.write_layer(cells(spark).limit(0), f"file://{tmp_path}/none")
    assert layers.write_layer(cells(spark).withColumn("value", F.lit(None).cast("double")), f"file://{tmp_path}/gaps") == sign
    assert layers.read_layer(spark, f"file://{tmp_path}/gaps", sign).filter("value is null").count() == 12


def test_globs_and_file_scans(spark, tmp_path):
    for name, frame in (("a", spark.range(3)), ("b", spark.range(2).withColumn("more", F.lit(1)))):
        frame.write.parquet(f"file://{tmp_path}/{name}")
    assert layers.read_parquet_glob(spark, f"file://{tmp_path}/[ab]/*.parquet").agg(F.count("*"), F.count("more")).first()[:] == (5, 2)
    (tmp_path / "files").mkdir()
    (tmp_path / "files/ais_density_202401.nc").write_bytes(b"abc")
    (tmp_path / "files/other.bin").write_bytes(b"x")
    got = {(r["ym"], r["type"], r["size"], r["sha1"]) for r in layers.scan_files(spark, f"file://{tmp_path}/files", {"density": "density"}).collect()}
    assert got == {("202401", "density", 3, "a9993e364706816aba3e25717850c26c9cd0d89d"), (None, "block", 1, "11f6ad8ec52a2984abaafd7c3b516503785c2072")}
    assert layers.scan_files(spark, f"file://{tmp_path}/files", {}, digest=False).filter("sha1 is not null").count() == 0


def test_mask_chain_says_how_it_was_found(spark):
    mask = cells(spark).withColumn("is_land", F.col("j") >= 2)
    rung = lambda m, c: {(r["rung"], r["is_land"], r["j"]) for r in alignment.mask_for(m, c).collect()}
    assert rung(mask, cells(spark)) == {("same_shape", j >= 2, j) for j in range(4)}
    assert rung(mask.filter("j in (0, 3)"), cells(spark, 2, 4)) == {("nearest", j >= 2, j) for j in range(4)}
    assert rung(mask.withColumn("lat", F.lit(None).cast("double")), cells(spark, 3, 8)) == {("index", j >= 4, j) for j in range(8)}
    assert rung(mask.filter("false"), cells(spark)) == {("no_mask", False, j) for j in range(4)}
    assert alignment.mask_for(mask, cells(spark).filter("false")).count() == 0


def test_full_export_fills_what_is_missing(spark, tmp_path):
    made = cells(spark).withColumn("sic", F.when(F.col("j") == 1, float("nan")).when(F.col("j") == 2, F.lit(None)).otherwise(0.5))
    got = training.full_export(made, cells(spark).filter("i = 0").withColumn("label", F.lit(1)), ["sic", "wave"], f"file://{tmp_path}/export")
    assert sorted((r["j"], r["sic"], r["wave"], r["month"], r["day"], r["vessel_class"]) for r in got.collect()) == [(0, 0.5, 0.0, 8, 220, 1), (1, 0.0, 0.0, 8, 220, 1), (2, 0.0, 0.0, 8, 220, 1), (3, 0.5, 0.0, 8, 220, 1)]


def test_gamma_functions_hold_nine_digits(spark):
    values = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4, 1e5]
    rows = spark.createDataFrame([(v,) for v in [*values, 0.0, -1.0]], "x double").select("x", special.log_gamma(F.col("x")).alias("g"), special.digamma(F.col("x")).alias("d")).collect()
    known = {1.0: -0.5772156649015329, 0.5: -1.9635100260214235, 2.0: 0.42278433509846714, 10.0: 2.251752589066721}
    for r in rows:
        if r["x"] <= 0:
            assert r["g"] is None and r["d"] is None
        else:
            assert math.isclose(r["g"], math.lgamma(r["x"]), rel_tol=1e-10, abs_tol=1e-10)
            assert r["x"] not in known or math.isclose(r["d"], known[r["x"]], abs_tol=1e-10)


def test_loss_of_known_predictions(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 0), (3.0, 1.0, 0), (3.0, 1.0, 1), (None, 1.0, 0), (2.0, 1.0, 7), (-1.0, 1.0, 0)], "a double, b double, y int")
    got = [tuple(None if x is None else round(x, 9) for x in (r["mse"], r["variance"], r["divergence"])) for r in evidence.loss_terms(rows, ["a", "b"], "y").collect()]
    kl = round(math.lgamma(4) - math.lgamma(3) - math.lgamma(2) + 2 * ((-0.5772156649 + 1.5) - (-0.5772156649 + 1.5 + 1 / 3)), 9)  # Beta(3, 1) from Beta(1, 1)
    assert got == [(0.5, round(0.5 / 3, 9), 0.0), (0.125, 0.075, kl), (1.125, 0.075, kl), (None,) * 3, (None,) * 3, (None,) * 3]


def test_network_and_who_provides(spark):
    rng = np.random.default_rng(7)
    shapes = [(3, 4), (4, 2)]
    layers_ = [(rng.normal(size=s), rng.normal(size=s[1])) for s in shapes]
    table = [(n, r, c, float(w[r, c])) for n, (w, b) in enumerate(layers_) for r in range(w.shape[0]) for c in range(w.shape[1])] + [(n, -1, c, float(b[c])) for n, (w, b) in enumerate(layers_) for c in range(len(b))]
    frame = spark.createDataFrame(table, "layer int, input int, output int, value double")
    net = evidence.Network.from_table(frame, ["sic", "wave", "absent"], {"sic": (0.5, 0.25)})
    grid = spark.createDataFrame([(0, 0, 0.1, 2.0, "x"), (0, 1, None, float("nan"), None)], "i long, j long, sic double, wave double, risk string")
    got = {r["j"]: (r["risk"], r["uncertainty"]) for r in evidence.network_risk(grid, net).collect()}
    for j, x in ((0, [(0.1 - 0.5) / 0.25, 2.0, 0.0]), (1, [-2.0, 0.0, 0.0])):
        h = np.maximum(np.array(x) @ layers_[0][0] + layers_[0][1], 0)
        a = np.log1p(np.exp(h @ layers_[1][0] + layers_[1][1])) + 1
        assert np.allclose(got[j], (1 - a[1] / a.sum(), 2 / a.sum()))
    with pytest.raises(ValueError):
        evidence.Network.from_table(frame, ["sic"], {})
    external = spark.createDataFrame([(0, 0, 1.7, None)], "i long, j long, risk double, uncertainty double")
    told = lambda *a: sorted((r["j"], r["source"], r["reason"]) for r in evidence.provided_risk(*a).collect())
    assert told(grid, net) == [(0, "small_network", ""), (1, "small_network", "")]
    assert told(grid.drop("sic"), net, external) == [(0, "external", "no_sic"), (1, "external", "no_sic")]
    assert told(grid, None, external.limit(0)) == [(0, "placeholder", "no_network,no_external"), (1, "placeholder", "no_network,no_external")]
    assert sorted((r["risk"], r["uncertainty"]) for r in evidence.provided_risk(grid, None, external).collect()) == [(0.0, 1.0), (1.0, 1.0)]
