"""Vessels, look-ups with defaults, fuel along routes and context buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import clip, haversine_nm
from ..functions.risk import season_factor
from .routes import CO2_PER_FUEL

# fixed values: vessel types (dwt from, dwt to, design speed in knots, fuel per km)
VESSEL_TYPES = {"handysize": (10000, 40000, 13.0, 0.035), "panamax": (60000, 80000, 14.0, 0.050), "capesize": (150000, 200000, 15.0, 0.080)}
# fixed values: ice classes and the thickness they bear, in metres
ICE_CLASSES = {"no_ice_class": 0.00, "fsicr_1c": 0.25, "fsicr_1b": 0.50, "fsicr_1a": 0.80, "fsicr_1a_super": 1.00, "polar_pc7": 1.20, "polar_pc6": 1.50, "polar_pc5": 2.00}
# fixed values: fuel per nautical mile by vessel class, and of any other
FUEL_PER_NM = {"icebreaker": 0.020, "cargo_iceclass": 0.015, "cargo_standard": 0.012, "fishing_small": 0.006}
FUEL_PER_NM_OTHER = 0.015
# fixed values: regions (west, south, east, north)
REGIONS = {"NSR": (30.0, 66.0, 180.0, 85.0), "NWP": (-170.0, 65.0, -40.0, 85.0)}


def vessel_profiles(spark: SparkSession, margin: float = 1.0) -> DataFrame:
    """Every vessel type in every ice class, deadweight in the middle of its range."""
    types = spark.createDataFrame([(k, *v) for k, v in VESSEL_TYPES.items()], "vessel_type string, dwt_low int, dwt_high int, design_speed_kn double, base_fuel_per_km double")
    classes = spark.createDataFrame(list(ICE_CLASSES.items()), "ice_class string, max_ice_m double")
    pairs = types.crossJoin(F.broadcast(classes))  # 3 x 8 rows
    return pairs.select(
        F.concat_ws("_", "vessel_type", "ice_class").alias("vessel"), "vessel_type", "ice_class",
        ((F.col("dwt_low") + F.col("dwt_high")) / 2).alias("dwt"), "design_speed_kn", "base_fuel_per_km", "max_ice_m",
        F.greatest(F.lit(0.01), F.col("max_ice_m") * margin).alias("usable_ice_m"), (F.col("max_ice_m") * 0.7).alias("soft_ice_m"),
    )


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, default: str) -> DataFrame:
    """Look-up by key; a key that is unknown or NULL takes the row of ``default`` (R15).  The dimension is a small fixed table."""
    known = dimension.select(F.col(key).alias("_known"))
    found = rows.join(known, F.col(key) == F.col("_known"), "left").withColumn("_key", F.coalesce("_known", F.lit(default))).drop("_known", key)
    return found.join(dimension.withColumnRenamed(key, "_key"), "_key", "left").withColumnRenamed("_key", key)


def every_pair(left: DataFrame, right: DataFrame, most: int = 10_000) -> DataFrame:
    """Scenarios times modes, or weight grids (R14, G10, O10): the right side is a parameter list of at most ``most`` rows."""
    if len(right.take(most + 1)) > most:
        raise ValueError(f"the right side is to be a parameter list of at most {most} rows")
    return left.crossJoin(F.broadcast(right))


def weight_grid(spark: SparkSession, weights: dict[str, list[float]]) -> DataFrame:
    """Every combination of the weights listed."""
    rows = spark.range(1)
    for name, values in weights.items():
        rows = rows.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))
    return rows.drop("id")


def fuel_per_nm(vessel_class: Column, month: Column, layer_factor: float = 1.0) -> Column:
    """Fuel per nautical mile: class, season and layers."""
    base = F.lit(None).cast("double")
    for name, value in FUEL_PER_NM.items():
        base = F.when(vessel_class == name, value).otherwise(base)
    return F.coalesce(base, F.lit(FUEL_PER_NM_OTHER)) * season_factor(month) * layer_factor


def leg_fuel(steps: DataFrame, per_nm: Column) -> DataFrame:
    """Nautical miles, fuel and CO2 of each leg but the first step's (A32); sums per route are its totals."""
    w = Window.partitionBy("route_id").orderBy("seq")
    nm = haversine_nm(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    legs = steps.withColumn("nm", nm).filter("nm is not null").withColumn("fuel", F.col("nm") * per_nm)
    return legs.withColumn("co2", F.col("fuel") * CO2_PER_FUEL)


def fuel_features(steps: DataFrame, month: Column, vessel_class: Column) -> DataFrame:
    """Mean leg (10 without any), season's wind, wave and ice risk, and whether the class names ice."""
    w = Window.partitionBy("route_id").orderBy("seq")
    nm = haversine_nm(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    made = steps.withColumns({"_nm": nm, "_month": month, "_class": F.lower(vessel_class)})
    one = made.groupBy("route_id").agg(F.coalesce(F.avg("_nm"), F.lit(10.0)).alias("segment_length_nm"), F.min("_month").alias("_month"), F.min("_class").alias("_class"))
    s = season_factor(F.col("_month"))
    ice = F.when(s >= 1.15, 0.2).when(s > 1.0, 0.1).otherwise(0.05)
    named = F.coalesce(F.col("_class"), F.lit("cargo_iceclass")).contains("ice").cast("double")
    return one.select("route_id", "segment_length_nm", (8.0 * s).alias("wind_speed"), (1.8 * s).alias("wave_height"), ice.alias("ice_risk"), named.alias("vclass_ix"))


def eco_fuel(nm: Column, per_nm: Column, class_factor: Column, ice: Column, wave: Column, alpha_ice: float, alpha_wave: float) -> Column:
    """Fuel of a segment with its ice, wave and class multipliers (A44); missing layers multiply by one."""
    phi = lambda alpha, r: 1 + F.lit(alpha) * F.coalesce(r, F.lit(0.0))
    return per_nm * class_factor * phi(alpha_ice, ice) * phi(alpha_wave, wave) * nm


def context_bucket(lat: Column, lon: Column, month: Column, vessel: Column, vessels: tuple[str, ...] = ("cargo", "tanker", "fishing")) -> Column:
    """REGION_SEASON_vessel; without a known vessel REGION_SEASON, outside all regions global."""
    region = F.lit(None).cast("string")
    for name, (west, south, east, north) in reversed(REGIONS.items()):
        region = F.when(lat.between(south, north) & lon.between(west, east), name).otherwise(region)
    season = F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON")
    known = F.when(vessel.isin(*vessels), vessel)
    return F.when(region.isNull() | season.isNull(), "global").otherwise(F.concat_ws("_", region, season, known))


def polar_xy(lat: Column, lon: Column, a: float = 6378137.0, f: float = 1 / 298.257223563, true_lat: float = 70.0, lon0: float = -45.0) -> tuple[Column, Column]:
    """North polar stereographic metres, true at ``true_lat`` (A48): the closed form on the ellipsoid."""
    e = (2 * f - f * f) ** 0.5
    tangent = lambda phi: F.tan(F.lit(0.7853981633974483) - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    fixed = F.radians(F.lit(true_lat))
    scale = F.cos(fixed) / F.sqrt(1 - e * e * F.pow(F.sin(fixed), 2))
    rho = a * scale * tangent(F.radians(lat)) / tangent(fixed)
    turn = F.radians(lon - lon0)
    return rho * F.sin(turn), -rho * F.cos(turn)


def bounded_uncertainty(x: Column) -> Column:
    """Uncertainty within 0..1, one where it is missing."""
    return F.coalesce(clip(x, 0.0, 1.0), F.lit(1.0))
