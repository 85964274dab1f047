"""Evidence of a window against its context's profile: z scores, latches, trend, persistence and review level.

State is expressed by window functions over (machine, module, mode): a latch is the last event that switched it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.config import MonitorPolicy

KEY = ("machine_id", "module_id", "operating_mode")


def latch(on: Column, off: Column, w) -> Column:
    return F.coalesce(F.last(F.when(on, F.lit(True)).when(off, F.lit(False)), ignorenulls=True).over(w), F.lit(False))


def context_scores(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    """z scores of the windows whose context has a profile (center_*, scale_*, ridge coefficients). profiles: a row per KEY, small."""
    j = windows.join(profiles, list(KEY))
    predicted = F.col("intercept") + F.col("b_hp2") * F.col("hp2") + F.col("b_valve") * F.col("valve")
    z = lambda x, name: (x - F.col(f"center_{name}")) / F.greatest(F.col(f"scale_{name}"), F.lit(1e-6))
    return j.withColumn("lp2_residual", F.col("lp2") - predicted).withColumns({"z_hp2": z(F.col("hp2"), "hp2"), "z_lp2": z(F.col("lp2_residual"), "residual"), "z_gap": z(F.col("pressure_gap"), "pressure_gap"), "z_span": z(F.col("temperature_span"), "temperature_span")})


def latched_evidence(scored: DataFrame, policy: MonitorPolicy = MonitorPolicy(), by: tuple[str, ...] = KEY) -> DataFrame:
    """Reason codes with hysteresis, the trend of the residual and its latch, and seconds of persistence.

    Latches of z scores outlast gaps; trend and persistence begin anew after a gap of more than reset_s. With forest_score,
    forest_entry and forest_exit, a window that the forest isolates has a code too, by a latch of the same kind.
    """
    key = Window.partitionBy(*by).orderBy("window_start_s")
    up_to = key.rowsBetween(Window.unboundedPreceding, 0)
    a, b = policy.entry_z, policy.exit_z
    big = lambda c: latch(F.abs(c) >= a, F.abs(c) < b, up_to)
    t = F.col("window_start_s")
    out = scored.withColumn("_break", F.coalesce((t - F.lag(t).over(key) > policy.reset_s).cast("int"), F.lit(0)))
    out = out.withColumn("island", F.sum("_break").over(up_to)).withColumns({"hp2_on": big(F.col("z_hp2")), "gap_on": big(F.col("z_gap")), "span_on": big(F.col("z_span")), "lp2_on": latch(F.col("z_lp2") <= -a, F.col("z_lp2") > -b, up_to)})
    island = Window.partitionBy(*by, "island").orderBy("window_start_s")
    out = out.withColumn("trend", F.col("z_lp2") - F.first("z_lp2").over(island.rangeBetween(-int(policy.trend_s), 0)))
    out = out.withColumn("trend_on", latch(F.col("trend") <= policy.trend_entry, F.abs("trend") < policy.trend_exit, island.rowsBetween(Window.unboundedPreceding, 0)))
    codes = {"HP2_ROBUST_Z": "hp2_on", "LP2_NEGATIVE_RESIDUAL": "lp2_on", "PRESSURE_GAP_ANOMALY": "gap_on", "TEMPERATURE_SPAN_ANOMALY": "span_on", "LP2_DOWNWARD_TREND": "trend_on"}
    if "forest_score" in scored.columns:
        codes["PRESSURE_PATTERN_ANOMALY"] = "forest_on"
        out = out.withColumn("forest_on", latch(F.col("forest_score") >= F.col("forest_entry"), F.col("forest_score") < F.col("forest_exit"), up_to))
    out = out.withColumn("reason_codes", F.array_sort(F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in codes.items()]), lambda x: x.isNotNull()))).withColumn("active", F.size("reason_codes") > 0)
    return persistence(out, "active", policy, by=by).withColumn("score", F.greatest(*[F.abs(c) for c in ("z_hp2", "z_lp2", "z_gap", "z_span")])).drop("_break")


def persistence(rows: DataFrame, active: str, policy: MonitorPolicy = MonitorPolicy(), out: str = "persistent_s", by: tuple[str, ...] = KEY) -> DataFrame:
    """Seconds since the present run of active windows began, its first window included; 0 if inactive. rows have island."""
    island = Window.partitionBy(*by, "island").orderBy("window_start_s")
    t = F.col("window_start_s")
    runs = rows.withColumn("_run", F.sum((~F.col(active)).cast("int")).over(island.rowsBetween(Window.unboundedPreceding, 0)))
    began = F.min(F.when(F.col(active), t)).over(Window.partitionBy(*by, "island", "_run"))
    return runs.withColumn(out, F.when(F.col(active), t - began + policy.window_s).otherwise(0)).drop("_run")


def review_level(status: Column, first_active: Column, first_s: Column, second_active: Column, second_s: Column, policy: MonitorPolicy = MonitorPolicy()) -> Column:
    """A window that isn't eligible keeps its status. Both evidences for p1_s: P1_REVIEW; either for p2_s: P2_REVIEW; any active: SHADOW."""
    both = first_active & second_active & (first_s >= policy.p1_s) & (second_s >= policy.p1_s)
    either = (first_active & (first_s >= policy.p2_s)) | (second_active & (second_s >= policy.p2_s))
    return F.when(status != "ELIGIBLE", status).when(both, "P1_REVIEW").when(either, "P2_REVIEW").when(first_active | second_active, "SHADOW").otherwise("NORMAL")
