"""Comparing planning modes across scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASELINE = "efficient"


def first_results(results: DataFrame) -> DataFrame:
    """First reachable row of each scenario and mode by run order."""
    w = Window.partitionBy("scenario_id", "mode").orderBy("run_id")
    return results.filter("reachable").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def compare(results: DataFrame) -> DataFrame:
    """Each mode against the baseline of its scenario (R13, A15); scenarios without a usable baseline go."""
    rows = first_results(results)
    base = rows.filter((F.col("mode") == BASELINE) & (F.col("distance_km") >= 1e-6)).select("scenario_id", *(F.col(c).alias(f"b_{c}") for c in ("distance_km", "total_cost", "risk")))
    both = rows.filter(F.col("mode") != BASELINE).join(base, "scenario_id")
    delta = lambda c: F.col(c) - F.col(f"b_{c}")
    return both.select(
        "scenario_id",
        "mode",
        delta("distance_km").alias("delta_km"),
        (100.0 * delta("distance_km") / F.col("b_distance_km")).alias("detour_pct"),
        delta("total_cost").alias("delta_cost"),
        F.when(F.col("b_risk") > 1e-6, -100.0 * delta("risk") / F.col("b_risk")).alias("risk_reduction_pct"),
    )


def summary(compared: DataFrame, small_detour: float = 5.0) -> DataFrame:
    """Per mode: mean reduction over valid rows, mean detour over all, counts (A16), and a word for the reduction."""
    better = F.col("risk_reduction_pct") > 0
    out = compared.groupBy("mode").agg(
        F.count("*").alias("scenarios"),
        F.avg("risk_reduction_pct").alias("mean_reduction"),
        F.avg("detour_pct").alias("mean_detour"),
        F.count_if(better).alias("better"),
        F.count_if(better & (F.col("detour_pct") <= small_detour)).alias("better_cheaply"),
    )
    verdict = F.when(F.col("mean_reduction") >= 75, "strong").when(F.col("mean_reduction") >= 50, "clear").when(F.col("mean_reduction") > 0, "slight").otherwise("none")
    return out.withColumn("verdict", verdict)


def headline(results: DataFrame) -> DataFrame:
    """Shortest and least risky mode of each scenario."""
    rows = first_results(results)
    return rows.groupBy("scenario_id").agg(F.min_by("mode", F.struct("distance_km", "mode")).alias("shortest"), F.min_by("mode", F.struct("risk", "mode")).alias("least_risk"))


def scaled_to_most(results: DataFrame, columns: list[str]) -> DataFrame:
    """Measures as shares of the largest of the scenario; NULL where that is 0."""
    w = Window.partitionBy("scenario_id")
    return results.withColumns({f"{c}_share": F.col(c) / F.nullif(F.max(c).over(w), F.lit(0.0)) for c in columns})


def pareto_front(results: DataFrame) -> DataFrame:
    """Rows of a scenario that no other row beats in distance and risk.

    In order of distance a row stays if its risk is below that of all shorter rows, so one sorted window
    within a scenario does it, without comparing pairs.  Rows equal in both measures all stay.
    """
    at = Window.partitionBy("scenario_id", "distance_km")
    rows = results.withColumn("_at", F.min("risk").over(at))
    levels = rows.groupBy("scenario_id", "distance_km").agg(F.min("risk").alias("_level"))
    before = Window.partitionBy("scenario_id").orderBy("distance_km").rowsBetween(Window.unboundedPreceding, -1)
    bound = levels.select("scenario_id", "distance_km", F.min("_level").over(before).alias("_before"))
    kept = rows.join(bound, ["scenario_id", "distance_km"]).filter((F.col("risk") == F.col("_at")) & (F.col("_before").isNull() | (F.col("risk") < F.col("_before"))))
    return kept.select(results.columns)


def conclusions(summed: DataFrame) -> DataFrame:
    """What ``summary`` lets one say of each mode (A17): the safe mode is a good trade if it cuts risk by more
    than half for a detour below 5 percent; the robust one stands out if it cuts risk by more than 75 percent."""
    cut, detour = F.col("mean_reduction"), F.col("mean_detour")
    safe = F.when((cut > 50) & (detour < 5), "good_trade").otherwise("limited")
    robust = F.when(cut > 75, "strong_protection").otherwise("moderate_protection")
    return summed.withColumn("conclusion", F.when(F.col("mode") == "safe", safe).when(F.col("mode") == "robust", robust))


def headline_deltas(results: DataFrame) -> DataFrame:
    """Shortest and least risky mode of each scenario, and how they stand to the baseline."""
    rows = first_results(results).select("scenario_id", "mode", "distance_km", "total_cost", "risk")
    best = rows.groupBy("scenario_id").agg(
        F.min_by(F.struct("mode", "distance_km"), F.struct("distance_km", "mode")).alias("short"),
        F.min_by(F.struct("mode", "risk"), F.struct("risk", "mode")).alias("safe"),
        F.max(F.when(F.col("mode") == BASELINE, F.struct("distance_km", "risk"))).alias("base"),
    )
    risk = F.when(F.col("base.risk") > 0, 100.0 * (F.col("safe.risk") - F.col("base.risk")) / F.col("base.risk"))
    return best.select(
        "scenario_id",
        F.col("short.mode").alias("shortest"),
        (F.col("short.distance_km") - F.col("base.distance_km")).alias("delta_km"),
        F.col("safe.mode").alias("least_risk"),
        risk.alias("risk_change_pct"),
    )
