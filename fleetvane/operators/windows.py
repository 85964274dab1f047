"""Event-time windows: aggregates, quality gates and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.config import GROUP, PRESSURES, SENSORS, TEMPERATURES, MonitorPolicy
from fleetvane.functions.scalar import operating_mode, ratio, token

SECOND_US, DAY_S = 1_000_000, 86_400
#: Places of source order that are sorted together.
BUCKET_LINES = 1 << 16


def _bucket(order: Column, is_struct: bool) -> Column:
    """A run of BUCKET_LINES places in source order, or of lines of a file's block."""
    part = lambda c: F.floor(c / BUCKET_LINES).cast("long")
    return F.struct(order["block"].alias("block"), part(order["line"]).alias("part")) if is_struct else part(order)


def with_carries(rows: DataFrame, small: DataFrame, bucket: str) -> DataFrame:
    """rows with the columns of small, which has a row per machine, module and bucket; null keys are equal."""
    same = F.lit(True)
    for c in (*GROUP, bucket):
        same = same & F.col(f"_rows.{c}").eqNullSafe(F.col(f"_carried.{c}"))
    more = [c for c in small.columns if c not in (*GROUP, bucket)]
    return rows.alias("_rows").join(small.alias("_carried"), same, "left").select("_rows.*", *[f"_carried.{c}" for c in more])


def prepared(long: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """Rows with out_of_order (against source order), transition, settling and window_start_s.

    Settling lasts from a transition row on. Rows are sorted within a machine and module's day, and within runs of source
    order; what reaches over their edges (the last time, the last transition) is carried by one small row each, so a
    history of years is never one task's.
    """
    buckets = _bucket(F.col("source_order"), long.schema["source_order"].dataType.typeName() == "struct")
    transition = F.coalesce(token(F.col("module_status")).isin(*policy.transition_tokens), F.lit(False)) | F.coalesce(F.col("busy") == 1, F.lit(False))
    rows = long.withColumns({"transition": transition, "_run": buckets, "_day": F.floor(F.col("us") / (DAY_S * SECOND_US)).cast("long")})
    before = lambda key: Window.partitionBy(*GROUP).orderBy(key)

    runs = rows.groupBy(*GROUP, "_run").agg(F.max_by("us", "source_order").alias("_end_us"))
    runs = runs.withColumn("_run_us", F.lag("_end_us").over(before("_run"))).drop("_end_us")
    by_source = Window.partitionBy(*GROUP, "_run").orderBy("source_order")
    rows = with_carries(rows, runs, "_run").withColumn("out_of_order", F.coalesce(F.col("us") < F.coalesce(F.lag("us").over(by_source), F.col("_run_us")), F.lit(False)))

    changes = F.when(F.col("transition"), F.col("us"))
    days = rows.groupBy(*GROUP, "_day").agg(F.max("us").alias("_end_us"), F.max(changes).alias("_change_us"))
    earlier = before("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*GROUP, "_day", F.lag("_end_us").over(before("_day")).alias("_day_us"), F.max("_change_us").over(earlier).alias("_day_change_us"))
    by_time = Window.partitionBy(*GROUP, "_day").orderBy("us", "source_order")
    rows = with_carries(rows, days, "_day")
    last_change = F.coalesce(F.last(changes, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)), F.col("_day_change_us"))
    since = (F.col("us") - last_change) / SECOND_US
    rows = rows.withColumn("settling", F.coalesce((since >= 0) & (since < policy.settling_s), F.lit(False)))
    rows = rows.withColumn("previous_us", F.coalesce(F.lag("us").over(by_time), F.col("_day_us"))).withColumn("repeated", F.coalesce((F.col("us") == F.lag("us").over(by_time)) | (F.col("us") == F.lead("us").over(by_time)), F.lit(False)))
    return rows.withColumn("window_start_s", (F.floor(F.col("us") / (policy.window_s * SECOND_US)) * policy.window_s).cast("long")).drop("_run", "_run_us", "_day", "_day_us", "_day_change_us")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _all(columns: tuple[str, ...], test) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(test(F.col(c)), F.lit(False))
    return out


def event_windows(long: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """One row per machine, module and window: medians, coverage, the gate's reasons in fixed order and the status."""
    rows = prepared(long, policy)
    step = (F.col("us") - F.col("previous_us")) / SECOND_US
    inside = F.floor(F.col("previous_us") / (policy.window_s * SECOND_US)) * policy.window_s == F.col("window_start_s")
    rows = rows.withColumn("step_s", F.when(inside & (step > 0), step))
    lo, hi = policy.pressure
    cold, hot = policy.temperature
    running = token(F.col("module_status")).isin(*policy.running_tokens) & token(F.col("global_status")).isin(*policy.running_tokens)
    faults = {
        "NON_FINITE_SENSOR": ~_all(SENSORS, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))),
        "SENTINEL_VALUE": ~_all(TEMPERATURES, lambda c: F.coalesce(c != policy.sentinel, F.lit(True))),
        "PRESSURE_OUT_OF_RANGE": ~_all(PRESSURES, lambda c: (c >= lo) & (c <= hi)),
        "TEMPERATURE_OUT_OF_RANGE": ~_all(TEMPERATURES, lambda c: (c > cold) & (c < hot)),
        "NEGATIVE_VALVE": F.coalesce(F.col("valve") < 0, F.lit(False)),
        "DUPLICATE_TIMESTAMP": F.col("repeated"),
        "OUT_OF_ORDER_TIMESTAMP": F.col("out_of_order"),
    }
    agg = rows.groupBy(*GROUP, "window_start_s").agg(
        F.count("*").alias("point_count"),
        *[F.percentile(c, F.lit(0.5)).alias(c) for c in (*SENSORS, "busy")],
        F.coalesce(F.mode(F.trim("sv"), True), F.lit("<blank>")).alias("sv"),
        F.coalesce(F.mode(F.trim("module_status"), True), F.lit("<blank>")).alias("module_status"),
        F.percentile("step_s", F.lit(0.5)).alias("median_step_s"),
        F.coalesce(F.max("step_s"), F.lit(0.0)).alias("max_gap_s"),
        F.bool_and(F.coalesce(running, F.lit(False))).alias("running"),
        F.bool_or(F.col("transition") | F.col("settling")).alias("unsettled"),
        *[F.bool_or(test).alias(f"_{name}") for name, test in faults.items()],
    )
    expected = F.when(F.col("median_step_s") > 0, F.greatest(F.lit(1.0), F.floor(policy.window_s / F.col("median_step_s")).cast("double"))).otherwise(F.lit(float(policy.least_points)))
    agg = agg.withColumn("coverage", F.col("point_count") / expected)
    bad = F.filter(F.array(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in faults]), lambda x: x.isNotNull())
    short = F.when(F.col("point_count") < policy.least_points, "TOO_FEW_POINTS").when(F.col("max_gap_s") > policy.max_gap_s, "TIME_GAP_EXCEEDED").when(F.col("coverage") < policy.least_coverage, "COVERAGE_BELOW_MINIMUM")
    off = F.filter(F.array(F.when(~F.col("running"), F.lit("OFF_OR_NON_RUNNING_STATE")), F.when(F.col("unsettled"), F.lit("TRANSITION_OR_SETTLING"))), lambda x: x.isNotNull())
    agg = agg.withColumn("_bad", bad).withColumn("_short", short).withColumn("_off", off)
    status = F.when(F.size("_bad") > 0, "DATA_QUALITY_REVIEW").when(F.col("_short").isNotNull(), "INCOMPLETE_WINDOW").when(F.size("_off") > 0, "OFF_OR_TRANSITION").otherwise("ELIGIBLE")
    reasons = F.when(F.size("_bad") > 0, F.col("_bad")).when(F.col("_short").isNotNull(), F.array("_short")).otherwise(F.col("_off"))
    hp2, lp2 = F.col("hp2"), F.col("lp2")
    return agg.withColumn("window_status", status).withColumn("quality_reasons", reasons).withColumn("pressure_gap", hp2 - lp2).withColumn("pressure_ratio", ratio(hp2, lp2, 0.1)).withColumn("temperature_span", F.col("temphi") - F.col("templo")).withColumn("operating_mode", operating_mode(F.col("sv"), F.col("valve"), policy)).drop(*[f"_{n}" for n in faults], "_bad", "_short", "_off")
