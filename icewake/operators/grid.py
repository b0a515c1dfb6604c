"""Grids as cell tables, and moving values between grids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import ceiling_index, nearest_index


@dataclass(frozen=True)
class GridAxes:
    """An even latitude-longitude grid: ny rows from lat0, nx columns from lon0."""

    ny: int
    nx: int
    lat0: float
    lat1: float
    lon0: float
    lon1: float

    @property
    def dlat(self) -> float:
        return (self.lat1 - self.lat0) / (self.ny - 1)

    @property
    def dlon(self) -> float:
        return (self.lon1 - self.lon0) / (self.nx - 1)


DEMO = GridAxes(40, 80, 65.0, 80.0, 0.0, 160.0)
DEMO_LAND_FROM = 70


def grid_cells(spark: SparkSession, axes: GridAxes) -> DataFrame:
    """i, j, lat, lon of every cell."""
    ids = spark.range(axes.ny * axes.nx)
    ij = ids.select(F.expr(f"id div {axes.nx}").alias("i"), (F.col("id") % axes.nx).alias("j"))
    return ij.select("i", "j", (F.lit(axes.lat0) + F.col("i") * axes.dlat).alias("lat"), (F.lit(axes.lon0) + F.col("j") * axes.dlon).alias("lon"))


def demo_grid(spark: SparkSession) -> DataFrame:
    """The demonstration grid, its last ten columns land."""
    return grid_cells(spark, DEMO).withColumn("is_land", F.col("j") >= DEMO_LAND_FROM)


def land_share(cells: DataFrame) -> DataFrame:
    """Shares of land and ocean cells."""
    land = F.avg(F.col("is_land").cast("int"))
    return cells.agg(land.alias("land_fraction"), (1 - land).alias("ocean_fraction"))


def index_resample(source: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """``source`` (i, j, value) on a grid of another shape by rounded index, halves to even."""
    spark = source.sparkSession
    step = lambda n, m: (m - 1) / max(n - 1, 1)
    target = spark.range(new[0] * new[1]).select(F.expr(f"id div {new[1]}").alias("i"), (F.col("id") % new[1]).alias("j"))
    at = target.select("i", "j", F.rint(F.col("i") * step(new[0], old[0])).cast("long").alias("si"), F.rint(F.col("j") * step(new[1], old[1])).cast("long").alias("sj"))
    return at.join(source.select(F.col("i").alias("si"), F.col("j").alias("sj"), "value"), ["si", "sj"]).select("i", "j", "value")


def stride(cells: DataFrame, every: int) -> DataFrame:
    """Every n-th row and column."""
    return cells.filter((F.col("i") % every == 0) & (F.col("j") % every == 0))


def nearest_ocean(points: DataFrame, cells: DataFrame, axes: GridAxes, radius: int = 10) -> DataFrame:
    """Each point's nearest ocean cell within ``radius`` cells of its own cell; the first in row order wins.

    Ocean cells around each cell that has points are gathered once into an array, (2 radius + 1)^2 at most, and
    a point looks through the array of its own cell: only points and cells are shuffled, not points times cells.
    """
    own = points.filter("lat is not null and lon is not null").withColumns({"i0": nearest_index(F.col("lat"), axes.lat0, axes.dlat, axes.ny), "j0": nearest_index(F.col("lon"), axes.lon0, axes.dlon, axes.nx)})
    span = F.sequence(F.lit(-radius), F.lit(radius))
    used = own.select("i0", "j0").distinct()
    around = used.withColumn("di", F.explode(span)).withColumn("dj", F.explode(span)).withColumns({"i": F.col("i0") + F.col("di"), "j": F.col("j0") + F.col("dj")})
    ocean = cells.filter("not is_land").select("i", "j", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    gathered = around.join(ocean, ["i", "j"]).groupBy("i0", "j0").agg(F.collect_list(F.struct("clat", "clon", "i", "j")).alias("near"))
    d2 = lambda c: F.pow(c["clat"] - F.col("lat"), 2) + F.pow(c["clon"] - F.col("lon"), 2)
    best = own.join(gathered, ["i0", "j0"]).select("point_id", F.array_min(F.transform("near", lambda c: F.struct(d2(c).alias("d"), c["i"].alias("i"), c["j"].alias("j")))).alias("cell"))
    return best.select("point_id", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))


def sample_ahead(points: DataFrame, axes: GridAxes) -> DataFrame:
    """``points`` with the first axis values not below them, as indexes."""
    return points.withColumns({"i": ceiling_index(F.col("lat"), axes.lat0, axes.dlat, axes.ny), "j": ceiling_index(F.col("lon"), axes.lon0, axes.dlon, axes.nx)})
