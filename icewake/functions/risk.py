"""Column expressions for cost components, fuel and risk.  NULL means no data and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clip

ICE_EXPONENT, WAVE_EXPONENT = 1.5, 2.0
SOFT_START, SOFT_WEIGHT = 0.7, 3.0
# fixed values: below these (density: above) a cell is safe
SAFE_SIC, SAFE_THICKNESS, SAFE_WAVE, SAFE_DENSITY = 0.30, 1.0, 4.0, 0.10


def demo_ice_risk(lat: Column, is_land: Column, penalty: float = 4.0, threshold: float = 75.0) -> Column:
    """Constant penalty on ocean from a latitude on."""
    return F.when(~is_land & (lat >= threshold), penalty).otherwise(0.0)


def ice_risk(sic: Column, penalty: float = 4.0, exponent: float = ICE_EXPONENT) -> Column:
    """Penalty by sea-ice concentration."""
    return F.lit(penalty) * F.pow(clip(sic, 0.0, 1.0), F.lit(exponent))


def wave_risk(wave: Column, penalty: float = 1.0, exponent: float = WAVE_EXPONENT) -> Column:
    """Penalty by wave height, scaled by six metres."""
    return F.lit(penalty) * F.pow(clip(wave, 0.0, 10.0) / 6.0, F.lit(exponent)) if penalty > 0 else F.lit(0.0)


def usable_thickness(max_thickness: Column, margin: Column) -> Column:
    """Effective ice thickness a vessel may meet."""
    return F.greatest(F.lit(0.01), max_thickness * margin)


def soft_ice(thickness: Column, limit: Column, weight: float = SOFT_WEIGHT) -> Column:
    """Rising penalty in the last part below the limit."""
    start = limit * SOFT_START
    x = (thickness - start) / (limit - start)
    return F.when((thickness > start) & (thickness <= limit), F.lit(weight) * x * x).otherwise(0.0)


def hard_ice(thickness: Column, limit: Column) -> Column:
    """True where the ice is too thick for the vessel."""
    return F.coalesce(thickness > limit, F.lit(False))


def corridor(density: Column, weight: float) -> Column:
    """Cost that falls with traffic density."""
    return F.lit(weight) * clip(1 - F.sqrt(density), 0.0, 1.0)


def congestion(density: Column, p90: Column, weight: float) -> Column:
    """Cost above the 90th percentile of traffic density (C11)."""
    x = F.greatest(F.lit(0.0), density - p90) / F.greatest(F.lit(1e-6), 1 - p90)
    return F.lit(weight) * x * x


def uncertainty_cost(u: Column, weight: float) -> Column:
    """Weighted uncertainty within 0..1 (C17)."""
    return F.lit(weight) * clip(u, 0.0, 1.0)


def model_features(lat: Column, lon: Column, sic: Column, wave: Column, thickness: Column) -> dict[str, Column]:
    """Inputs of the risk model, all within 0..1."""
    return {
        "f_sic": clip(sic, 0.0, 1.0),
        "f_wave": clip(wave / 10.0, 0.0, 1.0),
        "f_thickness": clip(thickness / 2.0, 0.0, 1.0),
        "f_lat": clip((lat - 60.0) / 25.0, 0.0, 1.0),
        "f_lon": clip((lon + 180.0) / 360.0, 0.0, 1.0),
    }


def fuel_per_nm(speed: Column, ice: Column) -> Column:
    """Fuel per nautical mile by speed and ice."""
    return (0.1 + 0.02 * speed * speed) * (1 + 0.5 * ice)


def piecewise_ice(sic: Column, low: float = 0.10, high: float = 0.75, gamma: float = 1.5, alpha: float = 0.6) -> Column:
    """Free below ``low``, blocked from ``high``, a power between; no data counts as blocked."""
    between = F.lit(alpha) * F.pow((sic - low) / (high - low), F.lit(gamma))
    return F.when(sic.isNull() | (sic >= high), 1.0).when(sic < low, 0.0).otherwise(clip(between, 0.0, 1.0))


def risk_ice_blend(risk: Column, ice: Column, alpha: float) -> Column:
    """Weighted mean of risk and ice, risk alone without ice."""
    return clip(F.coalesce(F.lit(alpha) * risk + F.lit(1 - alpha) * ice, risk), 0.0, 1.0)


def escort_discount(risk: Column, coverage: Column, eta: float) -> Column:
    """Risk lowered where an escort is likely."""
    return clip(risk * (1 - F.lit(eta) * coverage), 0.0, 1.0)


def corridor_discount(cost: Column, corridor_share: Column, alpha: float) -> Column:
    """Ice cost lowered in a corridor, not below zero."""
    return F.greatest(F.lit(0.0), cost * (1 - F.lit(alpha) * corridor_share))


def live_blend(new: Column, base: Column, weight: float) -> Column:
    """Newer field blended into the base."""
    return F.lit(weight) * new + F.lit(1 - weight) * base


def dirichlet(*logits: Column) -> tuple[list[Column], Column]:
    """Class probabilities and uncertainty of an evidential head (M01): evidence = softplus."""
    alpha = [F.log1p(F.exp(x)) + 1 for x in logits]
    total = sum(alpha[1:], alpha[0])
    return [a / total for a in alpha], F.lit(float(len(alpha))) / total


def step_fuel(base: Column, sic: Column, thickness: Column, wave: Column) -> Column:
    """Fuel of a step with ice and wave corrections."""
    return base * (1 + 1.2 * sic * sic + 0.2 * thickness) * (1 + 0.12 * F.greatest(F.lit(0.0), wave - 1))


def season_factor(month: Column) -> Column:
    """Winter 1.15, summer 1.0, all else 1.05."""
    return F.when(month.isin(12, 1, 2), 1.15).when(month.isin(6, 7, 8), 1.0).otherwise(1.05)


def safe_label(sic: Column, wave: Column, thickness: Column, density: Column) -> Column:
    """1 where ships pass and ice, waves and thickness (or no data on it) are mild, else 0.

    The rule for risky cells has thresholds of its own, but all that is not safe is labelled 0 anyway.
    """
    calm = (density > SAFE_DENSITY) & (sic < SAFE_SIC) & (thickness.isNull() | (thickness < SAFE_THICKNESS)) & (wave < SAFE_WAVE)
    return F.when(calm, 1).otherwise(0)


def resolved_exponent(explicit: Column, fitted: Column, scenario: Column, default: float) -> Column:
    """The exponent that counts: given, else fitted for the month, else the scenario's, else the default."""
    return F.coalesce(explicit, fitted, scenario, F.lit(default))
