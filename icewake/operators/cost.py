"""Cost fields: itemised components over the cells of a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from .selection import quantiles


@dataclass(frozen=True)
class TrafficWeights:
    """Weights of the traffic terms (C13): the corridor and congestion weights replace the legacy one."""

    corridor: float = 0.0
    congestion: float = 0.0
    legacy: float = 0.0

    def resolved(self, map_legacy: bool) -> TrafficWeights:
        if self.corridor > 0 or self.congestion > 0:
            return TrafficWeights(self.corridor, self.congestion, 0.0)
        return TrafficWeights(self.legacy, 0.0, 0.0) if map_legacy and self.legacy > 0 else self


def with_traffic(cells: DataFrame, weights: TrafficWeights) -> DataFrame:
    """Adds corridor and congestion costs from ``density``."""
    d = F.col("density")
    p90 = quantiles(cells.filter("not is_land"), "density", [0.9])[0] if weights.congestion > 0 else None
    return cells.withColumns({
        "ais_corridor": risk.corridor(d, weights.corridor) if weights.corridor > 0 else F.lit(0.0),
        "ais_congestion": risk.congestion(d, F.lit(1.0 if p90 is None else p90), weights.congestion) if weights.congestion > 0 else F.lit(0.0),
        "ais_legacy": F.lit(weights.legacy) * d,
    })


def demo_cost(cells: DataFrame, ice_penalty: float = 4.0, threshold: float = 75.0, weights: TrafficWeights = TrafficWeights()) -> DataFrame:
    """Cost of every cell: distance, latitude ice and traffic; NULL on land."""
    rows = cells.withColumns({"base_distance": F.when(~F.col("is_land"), 1.0), "ice_risk": risk.demo_ice_risk(F.col("lat"), F.col("is_land"), ice_penalty, threshold)})
    rows = with_traffic(rows, weights.resolved(True)) if "density" in cells.columns else rows.withColumns({k: F.lit(0.0) for k in ("ais_corridor", "ais_congestion", "ais_legacy")})
    return rows.withColumn("cost", F.col("base_distance") + F.col("ice_risk") + F.col("ais_corridor") + F.col("ais_congestion") + F.col("ais_legacy"))


def vessel_cost(cells: DataFrame, max_thickness: float, margin: float, ice_penalty: float = 4.0, wave_penalty: float = 1.0, p: float = risk.ICE_EXPONENT, q: float = risk.WAVE_EXPONENT) -> DataFrame:
    """Cost from sea ice, waves and a vessel's ice class; NULL on land and where ice is too thick."""
    limit = risk.usable_thickness(F.lit(max_thickness), F.lit(margin))
    rows = cells.withColumns({
        "ice_risk": F.coalesce(risk.ice_risk(F.col("sic"), ice_penalty, p), F.lit(0.0)),
        "wave_risk": F.coalesce(risk.wave_risk(F.col("wave"), wave_penalty, q), F.lit(0.0)),
        "ice_class_soft": F.coalesce(risk.soft_ice(F.col("thick"), limit), F.lit(0.0)),
        "blocked": F.col("is_land") | risk.hard_ice(F.col("thick"), limit),
    })
    return rows.withColumn("cost", F.when(~F.col("blocked"), 1.0 + F.col("ice_risk") + F.col("wave_risk") + F.col("ice_class_soft")))
