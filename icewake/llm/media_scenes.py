"""A media column for the image operator: the test tables hold no pictures, so vectors are drawn.

The picture of a vector is a scene of textured rectangles whose layout follows from the vector's values
alone, so equal vectors have equal pictures.  A row whose id leaves 7 modulo 8 shows, instead of its own
scene, an edited view of the scene before it: cropped, brightened, noisy, and for some turned by 90
degrees; how, follows from its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 96
CROP = 80


def scene(seed: int) -> np.ndarray:
    """Grey scene (SIDE, SIDE): rectangles under a texture with detail at all scales, as photographs have."""
    rng = np.random.default_rng(seed)
    a = np.full((SIDE, SIDE), 120.0)
    at, size, grey = rng.integers(-6, SIDE - 6, (15, 2)), rng.integers(7, 26, (15, 2)), rng.integers(80, 160, 15)
    for (y, x), (h, w), g in zip(at.tolist(), size.tolist(), grey.tolist()):
        a[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = g
    for cells, depth in ((6, 50), (12, 50), (24, 50), (48, 40)):
        at = (np.arange(SIDE) + 0.5) * cells / SIDE
        weight = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(cells + 1)))
        a += depth * (weight @ rng.uniform(-1, 1, (cells + 1, cells + 1)) @ weight.T)
    return np.clip(a, 5, 235)


def edited(a: np.ndarray, number: int) -> np.ndarray:
    """Cropped, brightened, noisy and perhaps turned view of a scene."""
    rng = np.random.default_rng(number)
    y, x = rng.integers(0, SIDE - CROP + 1, 2)
    a = a[y : y + CROP, x : x + CROP] * rng.uniform(0.85, 1.1) + rng.uniform(-10, 10) + rng.normal(0, 1.5, (CROP, CROP))
    return np.rot90(a, int(rng.integers(0, 2)))


def pictures(vectors: DataFrame) -> DataFrame:
    """``(image_id, width, height, pixels)``; a null vector has a null picture."""
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("embedding").alias("own"), F.col("embedding").isNull().alias("bare"))
    before = rows.groupBy((F.col("vec_id") + 1).alias("vec_id")).agg(F.min("own").alias("other"))
    seeds = rows.join(before, "vec_id", "left").select("vec_id", "bare", "own", F.when(F.pmod("vec_id", F.lit(8)) == 7, F.col("other")).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, bare, own, other in zip(*(c.to_pylist() for c in b.columns)):
                if bare and other is None:
                    out.append((number, None, None, None))
                    continue
                a = scene((own if other is None else other) % (1 << 64))
                a = a if other is None else edited(a, number % (1 << 64))
                a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
                out.append((number, a.shape[1], a.shape[0], a.tobytes()))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["image_id", "width", "height", "pixels"])

    # drawing is far more work than its input is wide, so the rows are dealt out before it; by a hash of their
    # own, as the join has dealt them by vec_id into partitions that adaptive execution merges
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seeds.repartition(tasks, F.xxhash64("vec_id", F.lit("draw"))).mapInArrow(run, "image_id long, width int, height int, pixels binary")
