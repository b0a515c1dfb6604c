"""Cropped and edited copies among images, by local descriptors.

Corners are found at several scales, as many as the image's area asks for; around each, an orientation is
taken from the intensity centroid and ``BITS`` brightness comparisons, turned by that orientation, make a
binary descriptor.  Every descriptor goes under its value in each of ``TABLES`` disjoint groups of bits (a
Hamming table each), and under that value with its least sure bit turned: by the pigeonhole principle all
corners that differ in fewer bits than there are tables meet, and farther ones where they differ in unsure bits.
Images that meet at one corner are candidates, and only of those are all corners compared: a corner's nearest in the other image counts within ``NEAR`` bits, and the two are linked
if ``CONSENSUS`` of these agree on one similarity transform.  Links make classes.

A group of bits is wide (51), so that unrelated corners hardly meet and candidates grow with the images.
Groups of many copies are not expanded into pairs: images that meet in a table are first compared with the
smallest of them, and after that only across the classes found so far, so that no link between classes
is lost whatever a table's size: images that meet at any corner are compared or in one class already.

Byte-identical images are one image.  The brightness tests are the least correlated of a pool under an
exponential model of image texture, so nothing is fitted and no sample is read.

Defined results: an image that is null, or whose pixels do not fill width x height, has no descriptors
and is a class of its own unless an identical one exists; rows without an id are left out; of rows that repeat an id with
different pixels the one of smallest digest counts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches
from .components import connected_components
from .linked_groups import class_links

SCALES = (1.0, 1.225, 1.5, 1.84, 2.25)  # near enough that a corner of any ratio between has its like at one of them
CORNER_AREA = 512  # one corner for so many pixels, at every scale
LEAST_CORNERS = 6  # at every scale
MARGIN = 15
REACH = 11
TURNS = 72
BITS = 256
POOL = 2500  # tests to choose from
TEXTURE = 4.0  # pixels over which the model's texture is correlated
TABLES = 5
NEAR = 32
CONSENSUS = 5
SLACK = 3.0  # pixels that a corner may lie off the transform
HYPOTHESES = 32  # corners, evenly chosen, whose pairs propose transforms; all corners vote

_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("bits", "u1", BITS // 8), ("weak", "u1", TABLES)])  # weak: place of the least sure bit in each table


@cache
def turned_tests() -> np.ndarray:
    """Pixel offsets of the brightness tests at every turn: (TURNS, BITS, 2, 2).

    A test joins unless it is correlated with one that has, and the bound rises until there are enough.
    """
    pool = np.clip(np.random.default_rng(20).normal(0, REACH / 2, (POOL, 2, 2)), 1 - REACH, REACH - 1)
    p, q = pool[:, 0], pool[:, 1]
    near = lambda a, b: np.exp(-np.hypot(a[:, None, 0] - b[:, 0], a[:, None, 1] - b[:, 1]) / TEXTURE)
    shared = near(p, p) - near(p, q) - near(q, p) + near(q, q)
    spread = np.sqrt(np.maximum(np.diag(shared), 1e-6))
    alike = np.abs(shared / np.outer(spread, spread))
    left, chosen = np.flatnonzero(spread**2 > 0.5).tolist(), []
    for bound in np.arange(0.1, 1.1, 0.05):
        later = []
        for k in left:
            if len(chosen) < BITS and (not chosen or alike[k, chosen].max() < bound):
                chosen.append(k)
            else:
                later.append(k)
        left = later
    angles = 2 * np.pi * np.arange(TURNS) / TURNS
    spin = np.array([[[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]] for a in angles])
    return np.rint(np.einsum("tij,bpj->tbpi", spin, pool[chosen])).astype(np.int8)


@cache
def table_bits() -> list[np.ndarray]:
    """Disjoint groups of bits, one for each Hamming table."""
    width = BITS // TABLES
    order = np.random.default_rng(4).permutation(BITS)
    return [order[k * width : (k + 1) * width] for k in range(TABLES)]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1, edges repeated."""
    for axis in (1, 2):
        p = np.cumsum(np.pad(a, [(r + 1, r) if k == axis else (0, 0) for k in range(3)], mode="edge"), axis=axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(p, range(2 * r + 1, 2 * r + 1 + n), axis=axis) - np.take(p, range(n), axis=axis)) / (2 * r + 1)
    return a


def _shrunk(a: np.ndarray, factor: float) -> np.ndarray:
    """Images smaller by ``factor``: box filter, then bilinear samples."""
    if factor == 1.0:
        return a
    a = _box(a, max(1, int(round(factor / 2))))
    for axis in (1, 2):
        n = int(a.shape[axis] / factor)
        at = (np.arange(n) + 0.5) * factor - 0.5
        lo = np.clip(np.floor(at).astype(int), 0, a.shape[axis] - 2)
        w = np.clip(at - lo, 0, 1).reshape([-1 if k == axis else 1 for k in range(3)])
        a = np.take(a, lo, axis=axis) * (1 - w) + np.take(a, lo + 1, axis=axis) * w
    return a


def describe(images: np.ndarray, turned: np.ndarray) -> list[np.ndarray]:
    """Corners of equally large grey images (n, h, w), as an array of _POINT for each image."""
    n_images = len(images)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    dy, dx = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1]
    disc = (dx**2 + dy**2 <= REACH**2).astype(np.float64)
    for factor in SCALES:
        a = _shrunk(images.astype(np.float64), factor)
        n, h, w = a.shape
        if min(h, w) < 2 * MARGIN + 3:
            continue
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = strength[:, MARGIN : h - MARGIN, MARGIN : w - MARGIN]
        peak = np.ones(inner.shape, dtype=bool)
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                if sy or sx:
                    other = strength[:, MARGIN + sy : h - MARGIN + sy, MARGIN + sx : w - MARGIN + sx]
                    peak &= inner > other if (sy, sx) < (0, 0) else inner >= other
        score = np.where(peak & (inner > 1e-3), inner, -1.0).reshape(n, -1)
        k = min(max(LEAST_CORNERS, h * w // CORNER_AREA), score.shape[1])
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        image, best = np.repeat(np.arange(n), k), best.reshape(-1)
        good = score[image, best] > 0
        image, best = image[good], best[good]
        smooth = _box(a, 1)
        for s in range(0, len(image), 4096):  # patches of so many corners stand in memory
            i, at = image[s : s + 4096], best[s : s + 4096]
            y, x = at // (w - 2 * MARGIN) + MARGIN, at % (w - 2 * MARGIN) + MARGIN
            patch = a[i[:, None, None], y[:, None, None] + dy, x[:, None, None] + dx] * disc
            angle = np.arctan2((patch * dy).sum(axis=(1, 2)), (patch * dx).sum(axis=(1, 2)))
            offset = turned[np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS]
            v = smooth[i[:, None, None], y[:, None, None] + offset[..., 1], x[:, None, None] + offset[..., 0]]
            points = np.empty(len(i), dtype=_POINT)
            points["x"], points["y"] = (x + 0.5) * factor, (y + 0.5) * factor
            points["bits"] = np.packbits(v[..., 0] < v[..., 1], axis=1, bitorder="little")
            sure = np.abs(v[..., 0] - v[..., 1])
            points["weak"] = np.stack([sure[:, which].argmin(axis=1) for which in table_bits()], axis=1)
            found.append((i, points))
    if not found:
        return [np.empty(0, dtype=_POINT)] * n_images
    owner, points = np.concatenate([i for i, _ in found]), np.concatenate([p for _, p in found])
    order = np.argsort(owner, kind="stable")
    return np.split(points[order], np.searchsorted(owner[order], np.arange(1, n_images)))


def described(images: DataFrame) -> DataFrame:
    """``(image_id, content, points)`` of every image (image_id, width, height, pixels): digest and packed corners."""
    turned = turned_tests()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, widths, heights, pixels = (c.to_pylist() for c in b.columns)
            content = [f"none {i}" if p is None else sha256(f"{w}|{h}|".encode() + p).hexdigest() for i, w, h, p in zip(ids, widths, heights, pixels)]
            points = [b""] * len(ids)
            shapes: dict[tuple[int, int], list[int]] = {}
            for k, (w, h, p) in enumerate(zip(widths, heights, pixels)):
                if p is not None and w and h and len(p) == w * h:
                    shapes.setdefault((h, w), []).append(k)
            for (h, w), own in shapes.items():
                step = max(1, min(128, (1 << 20) // (h * w)))
                for s in range(0, len(own), step):
                    part = own[s : s + step]
                    stack = np.stack([np.frombuffer(pixels[k], dtype=np.uint8).reshape(h, w) for k in part])
                    for k, found in zip(part, describe(stack, turned)):
                        points[k] = found.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content), pa.array(points, pa.binary())], names=["image_id", "content", "points"])

    columns = [F.col(c).cast(k).alias(c) for c, k in (("image_id", "long"), ("width", "int"), ("height", "int"), ("pixels", "binary"))]
    return images.select(*columns).filter("image_id is not null").mapInArrow(run, "image_id long, content string, points binary")


def table_keys(found: DataFrame) -> DataFrame:
    """``(key, image_id)``: every corner under two values in each table; a clash of keys only adds a candidate."""
    groups = table_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [np.frombuffer(p, dtype=_POINT) for p in b.column(1).to_pylist()]
            sizes = np.array([len(p) for p in points], dtype=np.int64)
            if not sizes.sum():
                continue
            together = np.concatenate(points)
            bits = np.unpackbits(together["bits"], axis=1, bitorder="little")
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
            for k, which in enumerate(groups):
                own = (bits[:, which].astype(np.int64) << np.arange(len(which))).sum(axis=1) | (k << len(which))
                for key in (own, own ^ (np.int64(1) << together["weak"][:, k].astype(np.int64))):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["key", "image_id"])

    return found.select("image_id", "points").mapInArrow(run, "key long, image_id long")


def _met(found: DataFrame) -> DataFrame:
    """``(key, id)`` of all images that meet another under the key.

    The window drops the many keys of one image before anything is written.
    """
    by_key = Window.partitionBy("key")
    keys = table_keys(found).withColumns({"least": F.min("image_id").over(by_key), "most": F.max("image_id").over(by_key)})
    return materialise(keys.filter("least <> most").select("key", F.col("image_id").alias("id")).distinct(), "met")


def consensus(first: np.ndarray, second: np.ndarray) -> int:
    """Most corners of two images (arrays of _POINT) that agree on one similarity transform."""
    if min(len(first), len(second)) < CONSENSUS:
        return 0
    u, v = (np.ascontiguousarray(p["bits"]).view("<u8") for p in (first, second))
    nearest, apart = [], []
    for s in range(0, len(u), 256):
        d = np.bitwise_count(u[s : s + 256, None] ^ v).sum(axis=2, dtype=np.int32)
        nearest.append(d.argmin(axis=1))
        apart.append(d.min(axis=1))
    good = np.flatnonzero(np.concatenate(apart) <= NEAR)
    if len(good) < CONSENSUS:
        return 0
    a = first["x"][good] + 1j * first["y"][good].astype(np.float64)
    other = np.concatenate(nearest)[good]
    b = second["x"][other] + 1j * second["y"][other].astype(np.float64)
    ends = np.unique(np.linspace(0, len(good) - 1, min(len(good), HYPOTHESES)).astype(int))
    i, j = (x.reshape(-1) for x in np.meshgrid(ends, ends, indexing="ij"))
    far = (i < j) & (np.abs(a[j] - a[i]) >= 8)
    i, j = i[far], j[far]
    m = (b[j] - b[i]) / (a[j] - a[i])
    usable = (np.abs(m) > 0.25) & (np.abs(m) < 4)
    i, m = i[usable], m[usable]
    best = 0
    for s in range(0, len(m), 256):
        at, by = i[s : s + 256], m[s : s + 256, None]
        agree = np.abs(by * (a - a[at, None]) + b[at, None] - b) <= SLACK * np.maximum(1, np.abs(by))
        votes = agree.sum(axis=1)
        for k in np.argsort(-votes, kind="stable"):
            if votes[k] <= best:
                break
            best = max(best, min(len(np.unique(a[agree[k]])), len(np.unique(b[agree[k]]))))
    return best


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those pairs ``(a, b)`` of which enough corners agree on one transform, with all columns (longs)."""
    names = pairs.columns
    of = lambda c: found.select(F.col("image_id").alias(c), F.col("points").alias(f"{c}_points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = ([np.frombuffer(x, dtype=_POINT) for x in batch.column(c).to_pylist()] for c in ("a_points", "b_points"))
            agreed = [consensus(x, y) >= CONSENSUS for x, y in zip(p, q)]
            yield batch.filter(pa.array(agreed, pa.bool_())).select(names)

    # the pairs are few and their comparison is long, so they are dealt out evenly
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select(*names, "a_points", "b_points").repartition(tasks, F.xxhash64("a", "b", F.lit("pair")))
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def copy_links(found: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: a set of links that joins all images (``image_id, points``) of a class."""
    small_batches(found.sparkSession)
    met = _met(found)
    out = class_links(met, lambda pairs: _verified(pairs, found))
    discard(met)
    return out


def copy_classes(images: DataFrame) -> DataFrame:
    """``(image_id, class_id, n_images)`` per image: smallest id of its class and the images in that class."""
    rows = described(images).groupBy("image_id").agg(F.min(F.struct("content", "points")).alias("p"))
    named = materialise(rows.select("image_id", "p.content", "p.points"), "described")  # the one pass over the pixels
    firsts = materialise(named.groupBy("content").agg(F.min("image_id").alias("first_id")), "firsts")
    placed = materialise(named.select("image_id", "content").join(firsts, "content").select("image_id", "first_id"), "placed")
    leading = firsts.select(F.col("first_id").alias("image_id"))
    links = copy_links(named.select("image_id", "points").join(leading, "image_id", "left_semi"))
    roots = connected_components(links)
    out = materialise(placed.join(roots, placed.first_id == roots.node, "left").select("image_id", F.coalesce("root", "first_id").alias("class_id")), "classes")
    sizes = materialise(out.groupBy("class_id").agg(F.count("*").alias("n_images")), "sizes")
    return out.join(sizes, "class_id").select("image_id", "class_id", "n_images")
