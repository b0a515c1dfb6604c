"""Column expressions over positions: distances, longitudes, grid indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
NAUTICAL_MILE_M = 1852.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance (W12); NULL where an end is NULL."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - F.least(a, F.lit(1.0))))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same in nautical miles, on a sphere of 6,371,000 m."""
    return haversine_km(lat1, lon1, lat2, lon2, 6_371_000.0 / NAUTICAL_MILE_M)


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180) (P10)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inside a box that may cross the date line."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def nearest_index(x: Column, first: float, step: float, count: int) -> Column:
    """Nearest index of an even axis; ties to the lower index, outside values clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.ceil((x - first) / step - 0.5))).cast("long")


def ceiling_index(x: Column, first: float, step: float, count: int) -> Column:
    """First index of an even axis whose value is not below x, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.ceil((x - first) / step))).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    """x held within bounds; NULL and NaN stay."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))
