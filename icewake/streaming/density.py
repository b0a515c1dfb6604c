"""Traffic density kept up to date over a stream of points; an extension, the batch form is A01."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.density import points_to_cells
from ..operators.grid import GridAxes


def windowed_density(points: DataFrame, axes: GridAxes, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Points per window and cell; points later than the watermark are not counted."""
    cells = points_to_cells(points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), axes)
    return cells.groupBy(F.window("ts", window).alias("w"), "i", "j").agg(F.count("*").alias("n")).select("w.start", "w.end", "i", "j", "n")
