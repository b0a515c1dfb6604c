"""Encounters: every pair of vessels within reach in a time slot, once, and what its closest approach risks.

The globe is cut into tiles.  A vessel stands in its own tile and visits every tile that a box of its reach touches, over
the date line too.  A pair meets where the vessel of the larger number stands, so no pair is met twice and none is
missed at a border.  Where very many vessels stand in one tile, they are dealt into blocks that all visitors of the tile visit.

The raster of all pairs needs no row a pair: vessels of a slot are packed into blocks of neighbours, blocks whose boxes are within reach
are joined, and every pair of their vessels is summed up by cell where the two blocks meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..sources.scratch import Written
from .block_search import few_blocks

LON_KM, LAT_KM, KNOT_KMH = 111.32, 110.574, 1.852
BLOCK = 1024  # vessels that stand in a block of a tile
PACK = 4096  # vessels in a block of neighbours
CHUNKS = (64, 128)  # vessels of the one and of the other block that are compared at once
FEW_CELLS = 1024  # cells that are counted without sorting
_BOX = ("lat0", "lat1", "lon0", "lon1")


def first_in_slot(points: DataFrame, minutes: int) -> DataFrame:
    """slot, mmsi, lat, lon, sog, cog: the first usable point of each vessel in each slot; no speed or course is 0."""
    slot = F.floor(F.unix_timestamp("ts") / (60 * minutes)).cast("long")
    usable = points.select(slot.alias("slot"), F.col("mmsi").cast("long"), "ts", finite("lat").alias("lat"), finite("lon").alias("lon"), F.coalesce(finite("sog"), F.lit(0.0)).alias("sog"), F.coalesce(finite("cog"), F.lit(0.0)).alias("cog"))
    usable = usable.filter("slot is not null and mmsi is not null and lat between -90 and 90 and lon between -180 and 180")
    return usable.groupBy("slot", "mmsi").agg(F.min_by(F.struct("lat", "lon", "sog", "cog"), F.struct("ts", "lat", "lon", "sog", "cog")).alias("x")).select("slot", "mmsi", "x.*")


def _offset(one: str, two: str) -> tuple[Column, Column]:
    """East and north from one to two on a plane at their middle latitude, in km, the short way round."""
    east = F.pmod(F.col(f"{two}.lon") - F.col(f"{one}.lon") + 540.0, F.lit(360.0)) - 180.0
    return east * LON_KM * F.cos(F.radians((F.col(f"{one}.lat") + F.col(f"{two}.lat")) / 2)), (F.col(f"{two}.lat") - F.col(f"{one}.lat")) * LAT_KM


def _with_speeds(stands: DataFrame) -> DataFrame:
    """vx and vy, km an hour to the east and north, in place of speed and course."""
    speed = lambda s: F.col("sog") * KNOT_KMH * s(F.radians("cog"))
    return stands.withColumns({"vx": speed(F.sin), "vy": speed(F.cos)}).drop("sog", "cog")


def pairs(points: DataFrame, reach_km: float = 10.0, minutes: int = 10, tile_deg: float = 1.0) -> DataFrame:
    """slot, a, b (a < b), km now, closest_km and hours until then for all pairs of vessels within ``reach_km`` in a slot."""
    around = round(360 / tile_deg)
    if abs(around * tile_deg - 360) > 1e-9:
        raise ValueError("tiles have to divide the circle")
    column = lambda lon: F.floor((lon + 180.0) / tile_deg)
    row = lambda lat: F.floor((lat + 90.0) / tile_deg)
    stands = first_in_slot(points, minutes).withColumns({"ti": row(F.col("lat")), "tj": F.pmod(column(F.col("lon")), F.lit(around))})
    sizes = stands.groupBy("slot", "ti", "tj").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    crowded = sizes.filter("blocks > 1")
    dealt = stands.join(crowded, ["slot", "ti", "tj"], "left").withColumn("block", F.pmod(F.xxhash64("mmsi"), F.coalesce("blocks", F.lit(1))))
    up = reach_km / LAT_KM * (1 + 1e-9)
    edge = F.least(F.abs("lat") + up, F.lit(90.0))
    side = F.when(edge < 89.9, up * LAT_KM / LON_KM / F.cos(F.radians(edge))).otherwise(180.0)
    whole = 2 * side + tile_deg >= 360  # the box reaches round the pole
    west, east = F.when(whole, F.lit(0)).otherwise(column(F.col("lon") - side)), F.when(whole, F.lit(around - 1)).otherwise(column(F.col("lon") + side))
    seen = stands.drop("ti", "tj").withColumn("ti", F.explode(F.sequence(row(F.col("lat") - up), row(F.col("lat") + up)))).withColumn("tj", F.explode(F.sequence(west, east))).withColumn("tj", F.pmod("tj", F.lit(around)))
    seen = seen.join(crowded, ["slot", "ti", "tj"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    seen, dealt = (_with_speeds(v) for v in (seen, dealt))  # once a vessel, not once a pair
    x, y = _offset("p", "q")
    level = F.abs(y) <= reach_km * (1 + 1e-9)  # before the costlier distance
    met = seen.alias("p").join(dealt.alias("q"), (F.col("p.slot") == F.col("q.slot")) & (F.col("p.ti") == F.col("q.ti")) & (F.col("p.tj") == F.col("q.tj")) & (F.col("p.block") == F.col("q.block")) & (F.col("p.mmsi") < F.col("q.mmsi")) & level & (x * x + y * y <= reach_km * reach_km))
    vx, vy = (F.col(f"q.{c}") - F.col(f"p.{c}") for c in ("vx", "vy"))
    made = met.select(F.col("p.slot").alias("slot"), F.col("p.mmsi").alias("a"), F.col("q.mmsi").alias("b"), x.alias("x"), y.alias("y"), vx.alias("vx"), vy.alias("vy"), F.col("p.lat").alias("lat1"), F.col("q.lat").alias("lat2"), F.col("p.lon").alias("lon1"), F.col("q.lon").alias("lon2"))
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
    hours = F.when(v2 > 1e-9, F.greatest(F.lit(0.0), -(F.col("x") * F.col("vx") + F.col("y") * F.col("vy")) / v2)).otherwise(0.0)
    made = made.withColumn("hours", hours)
    closest = F.sqrt(F.pow(F.col("x") + F.col("vx") * F.col("hours"), 2) + F.pow(F.col("y") + F.col("vy") * F.col("hours"), 2))
    plain = (F.col("lon1") + F.col("lon2")) / 2
    middle = F.when(F.abs(F.col("lon2") - F.col("lon1")) <= 180, plain).otherwise(plain - 180.0 * F.when(plain > 0, 1).otherwise(-1))
    return made.select("slot", "a", "b", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("km"), closest.alias("closest_km"), "hours", ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), middle.alias("lon"))


def interaction(met: DataFrame, near_km: float, cell_deg: float) -> DataFrame:
    """ci, cj, risk, worst, pairs: 1 - closest / ``near_km``, at least 0, averaged over the pairs whose middle is in a cell."""
    risk = F.greatest(F.lit(0.0), 1 - F.col("closest_km") / near_km)
    cells = met.select(F.floor(F.col("lat") / cell_deg).cast("long").alias("ci"), F.floor(F.col("lon") / cell_deg).cast("long").alias("cj"), risk.alias("risk"))
    return cells.groupBy("ci", "cj").agg(F.avg("risk").alias("risk"), F.max("risk").alias("worst"), F.count("*").alias("pairs"))


def interaction_of_all(points: DataFrame, reach_km: float, minutes: int, near_km: float, cell_deg: float) -> DataFrame:
    """``interaction`` of all ``pairs``, without a row for each of them."""
    blocks = Written(_blocks(_with_speeds(first_in_slot(points, minutes)), reach_km), "vessels")
    places, holds = blocks.table.drop("vessels"), blocks.table.select("block", "vessels").hint("shuffle_hash")
    boxes = [{c: F.col(f"{v}.{c}") for c in _BOX} for v in "pq"]
    apart = _least_km2(*boxes, F.least, lambda a, b: F.greatest(a, F.lit(b)), lambda d: F.cos(F.radians(d)))
    near = places.alias("p").join(places.alias("q"), (F.col("p.slot") == F.col("q.slot")) & (F.col("p.block") <= F.col("q.block")) & (apart <= reach_km * reach_km * (1 + 1e-9))).select(F.col("p.block").alias("one"), F.col("q.block").alias("two"))
    both = near.join(holds.toDF("one", "first"), "one").join(holds.toDF("two", "second"), "two").select("one", "two", "first", "second")
    chunks, few = CHUNKS, FEW_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[int, int], list[float]] = {}
            for k in range(b.num_rows):
                one, two, first, second = (c[k].as_py() for c in b.columns)
                _add_pairs(sums, _vessels(first), _vessels(second), one == two, reach_km, near_km, cell_deg, chunks, few)
            columns = [*zip(*((*cell, *x) for cell, x in sums.items()), strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["ci", "cj", "km", "least", "pairs"])

    with few_blocks(points.sparkSession):
        risk = lambda km: F.greatest(F.lit(0.0), 1 - km / near_km)
        met = both.mapInArrow(run, "ci long, cj long, km double, least double, pairs long").groupBy("ci", "cj")
        sums = Written(met.agg(risk(F.sum("km") / F.sum("pairs")).alias("risk"), risk(F.min("least")).alias("worst"), F.sum("pairs").alias("pairs")), "interaction")
    blocks.drop()
    return sums.table


def _blocks(stands: DataFrame, reach_km: float) -> DataFrame:
    """slot, block, its box, and lat, lon, vx and vy of up to ``PACK`` vessels of a slot that follow each other along strips of latitude."""
    order = ("slot", "strip", "lon", "mmsi")
    ordered = stands.withColumn("strip", F.floor(F.col("lat") * (3 * LAT_KM / reach_km))).repartitionByRange(*order).sortWithinPartitions(*order).select("slot", "lat", "lon", "vx", "vy")
    size = PACK

    def rows(made: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ends = [pa.array([float(f(v[k])) for _, v in made]) for k in (0, 1) for f in (np.min, np.max)]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int64()), *ends, pa.array([v.tobytes() for _, v in made], pa.binary())], names=["slot", *_BOX, "vessels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, np.empty((4, 0))
        for b in batches:
            slots, values, made = b.column(0).to_numpy(), np.stack([c.to_numpy() for c in b.columns[1:]]), []
            starts = [0, *np.flatnonzero(np.diff(slots)) + 1, len(slots)]
            for low, high in zip(starts, starts[1:], strict=False):
                if low == high:  # a batch without rows
                    continue
                if slots[low] != slot:
                    made += [(slot, held)] if held.size else []
                    slot, held = int(slots[low]), np.empty((4, 0))
                held = np.concatenate([held, values[:, low:high]], axis=1)
                while held.shape[1] >= size:
                    made.append((slot, held[:, :size]))
                    held = held[:, size:]
            if made:
                yield rows(made)
        if held.size:
            yield rows([(slot, held)])

    packed = ordered.mapInArrow(run, "slot long, lat0 double, lat1 double, lon0 double, lon1 double, vessels binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _least_km2(p: Mapping, q: Mapping, least: Callable, most: Callable, cos: Callable):  # noqa: ANN202
    """No two places of the boxes are nearer: square km, of columns or of arrays, the short way round."""
    north = most(most(q["lat0"] - p["lat1"], p["lat0"] - q["lat1"]), 0.0)
    gap, beyond = most(q["lon0"] - p["lon1"], p["lon0"] - q["lon1"]), 360.0 - (most(p["lon1"], q["lon1"]) - least(p["lon0"], q["lon0"]))
    steep = most((p["lat1"] + q["lat1"]) / 2, (p["lat0"] + q["lat0"]) / -2)  # the middle latitude nearest to a pole
    east = most(least(gap, beyond), 0.0) * LON_KM * cos(steep)
    return north * LAT_KM * (north * LAT_KM) + east * east


def _most_km2(p: Mapping, q: Mapping) -> np.ndarray:
    """No two places of the boxes are further apart: square km of arrays; where they may meet over the date line, infinite."""
    north = np.maximum(q["lat1"] - p["lat0"], p["lat1"] - q["lat0"]) * LAT_KM
    east = np.maximum(q["lon1"] - p["lon0"], p["lon1"] - q["lon0"])
    flat = np.maximum(np.maximum((p["lat0"] + q["lat0"]) / 2, (p["lat1"] + q["lat1"]) / -2), 0.0)  # the middle latitude nearest to the equator
    return np.where(east > 180, np.inf, north**2 + (east * LON_KM * np.cos(np.radians(flat))) ** 2)


def _vessels(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed).reshape(4, -1)


def _chunk_boxes(v: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{c}{k}": f.reduceat(x, starts) for c, x in zip(("lat", "lon"), v[:2], strict=True) for k, f in enumerate((np.minimum, np.maximum))}


def _add_pairs(sums: dict[tuple[int, int], list], p: np.ndarray, q: np.ndarray, same: bool, reach: float, near: float, cell: float, chunks: tuple[int, int], few: int) -> None:
    """Adds closest approaches (``near`` at most, in km), the least of them and the number of the pairs between two blocks to the cells of their middles."""
    starts = [np.arange(0, v.shape[1], n) for v, n in zip((p, q), chunks, strict=True)]
    a, b = ({k: x.reshape(shape) for k, x in _chunk_boxes(v, s).items()} for v, s, shape in ((p, starts[0], (-1, 1)), (q, starts[1], (1, -1))))
    meet = _least_km2(a, b, np.minimum, np.maximum, lambda d: np.cos(np.radians(d))) <= reach * reach * (1 + 1e-9)
    inside = _most_km2(a, b) <= reach * reach * (1 - 1e-9)
    wide = np.maximum(b["lon1"] - a["lon0"], a["lon1"] - b["lon0"]) > 180
    corners = np.stack([np.floor((a[c] + b[c]) / 2 / cell) for c in _BOX])  # the cells that middles may be in
    corners[2:, wide] = np.floor(np.array([[-180.0], [180.0]]) / cell)
    (c1, s1), (c2, s2) = ((np.cos(h), np.sin(h)) for h in (np.radians(v[0]) / 2 for v in (p, q)))
    n, m, size = np.ones(p.shape[1]), np.ones(q.shape[1]), chunks[0] * chunks[1]
    zero, space, squares = np.zeros(size), np.empty(5 * size), np.empty((2, size))
    # sums of two products each: km a degree at the middle latitude, degrees east, km north, difference of speeds, sums of latitudes and longitudes
    left = np.stack([np.stack(x, axis=1) for x in ((LON_KM * c1, -LON_KM * s1), (-p[1], n), (-LAT_KM * p[0], n), (p[2], -n), (p[3], -n), (p[0], n), (p[1], n))])
    right = np.stack([np.stack(x) for x in ((c2, s2), (m, q[1]), (m, LAT_KM * q[0]), (m, q[2]), (m, q[3]), (m, q[0]), (m, q[1]))])
    for i, j in np.argwhere(meet):
        i0, j0 = starts[0][i], starts[1][j]
        rows, columns = slice(i0, i0 + chunks[0]), slice(j0, j0 + chunks[1])
        if same and j0 + chunks[1] <= i0 + 1:
            continue
        high, across = left[0, rows].shape[0], right[0, :, columns].shape[1]
        planes = space[: 5 * high * across].reshape(5, high, across)
        scale, x, y, u, v = np.matmul(left[:5, rows], right[:5, :, columns], out=planes).reshape(5, -1)
        over = np.abs(x) > 180 if wide[i, j] else None
        if wide[i, j]:
            x -= 360 * np.rint(x / 360)
        x *= scale
        once, at = same and j0 < i0 + chunks[0], None
        if once or not inside[i, j]:
            d2, y2 = squares[:, : len(x)]
            np.multiply(x, x, out=d2)
            np.multiply(y, y, out=y2)
            d2 += y2
            met = d2 <= reach * reach
            if once:
                met &= (np.arange(j0, j0 + across) > np.arange(i0, i0 + high)[:, None]).ravel()
            at = np.flatnonzero(met)
            if not at.size:
                continue
            x, y, u, v = (z.take(at) for z in (x, y, u, v))
        v2 = u * u
        v2 += v * v
        if v2.min() <= 1e-9:
            v2[v2 <= 1e-9] = np.inf
        hours = x * u
        hours += y * v
        hours /= v2
        np.maximum(hours, zero[: len(x)], out=hours)
        u *= hours
        v *= hours
        x -= u
        y -= v
        x *= x
        y *= y
        x += y
        closest = np.sqrt(x, out=x)
        if near < reach:  # no risk beyond
            np.minimum(closest, near, out=closest)
        ci, last, cj, end = (int(k) for k in corners[:, i, j])
        if (ci, cj) == (last, end):
            _add(sums, (ci, cj), float(closest.sum()), float(closest.min()), len(closest))
            continue
        lat, lon = np.matmul(left[5:, rows], right[5:, :, columns]).reshape(2, -1)
        if at is not None:
            lat, lon, over = lat.take(at), lon.take(at), None if over is None else over.take(at)
        lat /= 2 * cell
        if over is None:
            lon /= 2 * cell
        else:
            lon = (lon / 2 - np.where(over, np.where(lon > 0, 180.0, -180.0), 0.0)) / cell
        span = end - cj + 1
        np.floor(lat, out=lat)
        np.floor(lon, out=lon)
        lat -= ci
        lat *= span
        lon -= cj
        lat += lon
        at = lat.astype(np.int64)
        kinds = None
        if (last - ci + 1) * span > few:
            kinds, at = np.unique(at, return_inverse=True)
        count, total = np.bincount(at), np.bincount(at, closest)
        cells = np.flatnonzero(count)
        names = [(ci + int(k) // span, cj + int(k) % span) for k in (cells if kinds is None else kinds)]
        known = max(sums[name][1] if name in sums else np.inf for name in names)
        near_by = np.flatnonzero(closest < known)  # no other pair can lower a cell's least distance
        least = np.full(len(count), np.inf)
        np.minimum.at(least, at[near_by], closest[near_by])
        for name, k in zip(names, cells, strict=True):
            _add(sums, name, float(total[k]), float(least[k]), int(count[k]))


def _add(sums: dict[tuple[int, int], list], cell: tuple[int, int], km: float, least: float, pairs: int) -> None:
    x = sums.setdefault(cell, [0.0, np.inf, 0])
    x[0], x[1], x[2] = x[0] + km, min(x[1], least), x[2] + pairs
