"""Dual profiles: scoring by golden and adaptive baselines, bounded candidates, guardrails and their validation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType

from fleetvane.config import GROUP, AdaptivePolicy
from fleetvane.functions.scalar import combined_risk, feature_deviation, risk_health, risk_status
from fleetvane.operators.percentiles import percentiles
from fleetvane.operators.profiles import relation_distance, shrunk_inverse_of
from fleetvane.operators.robust import center_scale
from fleetvane.shared import written

EPS = 1e-8


def bounded(old: Column, target: Column, rate: float, fraction: float) -> Column:
    """old moved towards target by rate, by no more than the fraction of old."""
    a, b = old * (1 - fraction), old * (1 + fraction)
    return F.least(F.greatest(old + rate * (target - old), F.least(a, b)), F.greatest(a, b))


def bounded_candidate(profiles: DataFrame, targets: DataFrame, by: list[str], policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """New centers and scales of the profiles (center, scale, golden_scale, threshold arrays) from targets (t_center, t_scale, t_threshold)."""
    j = profiles.join(targets, by)
    step = F.zip_with(F.zip_with("center", "t_center", lambda o, t: policy.rate * (t - o)), "golden_scale", lambda d, g: F.least(F.greatest(d, -policy.center_step_mad * F.greatest(g, F.lit(EPS))), policy.center_step_mad * F.greatest(g, F.lit(EPS))))
    scale = F.zip_with("scale", "t_scale", lambda o, t: F.least(F.greatest(o + policy.rate * (t - o), o * (1 - policy.scale_change)), o * (1 + policy.scale_change)))
    return j.select(*by, F.zip_with("center", step, lambda o, s: o + s).alias("center"), scale.alias("scale"), bounded(F.col("threshold"), F.col("t_threshold"), policy.rate, policy.threshold_change).alias("threshold"))


def dual_scores(summaries: DataFrame, profiles: DataFrame, by: list[str], policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """Risks, health, status, drift and eligibility of rows (summary, error) by their group's two baselines."""
    j = summaries.join(profiles, by)
    out = j
    for kind in ("golden", "adaptive"):
        c, s = F.col(f"{kind}_center"), F.col(f"{kind}_scale")
        out = out.withColumn(f"{kind}_deviation", feature_deviation(F.col("summary"), c, s)).withColumn(f"{kind}_distance", relation_distance(F.col("summary"), c, s, F.col(f"{kind}_inverse")))
        out = out.withColumn(f"{kind}_risk", F.greatest(F.col("error") / F.col(f"{kind}_error_threshold"), F.col(f"{kind}_deviation") / F.col(f"{kind}_deviation_threshold"), F.col(f"{kind}_distance") / F.col(f"{kind}_distance_threshold")))
    op, gold = F.col("adaptive_risk"), F.col("golden_risk")
    out = out.withColumn("risk", combined_risk(op, gold, policy)).withColumn("health", risk_health(F.col("risk"))).withColumn("condition", risk_status(F.col("risk"), policy))
    return out.withColumn("baseline_drift", gold >= 1).withColumn("eligible", (op < policy.eligible_operational) & (gold < policy.eligible_golden))


def synthetic_challenge(rows: DataFrame, by: list[str], order: str, threshold: str, policy: AdaptivePolicy = AdaptivePolicy(), rotated: int = 7) -> DataFrame:
    """Row i of a group with feature i mod 7 moved from the golden center, away from it, by the threshold and the margin in scales."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    j = F.pmod(i, F.least(F.lit(rotated), F.size("summary")))
    g = rows.withColumn("_j", j.cast("int"))
    away = lambda x, k: F.when(k == F.col("_j"), F.col("golden_center")[k] + F.when(x >= F.col("golden_center")[k], 1.0).otherwise(-1.0) * (F.col(threshold) + policy.synthetic_shift_mad) * F.greatest(F.col("golden_scale")[k], F.lit(EPS))).otherwise(x)
    return g.withColumn("summary", F.transform("summary", away)).drop("_j")


_ONE = "{0}_center array<double>, {0}_scale array<double>, {0}_inverse array<array<double>>, {0}_error_threshold double, {0}_deviation_threshold double, {0}_distance_threshold double"
DUAL_PROFILE = f"machine_id string, module_id int, windows long, {_ONE.format('golden')}, {_ONE.format('adaptive')}"


def covariances(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., windows, covariance): population covariance of the arrays z of each group, from sums of outer products that tasks make; the identity for a group of one. No nulls in by."""
    schema = rows.select(*by).schema.add("i", IntegerType()).add("n", LongType()).add("total", DoubleType()).add("products", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(c).type for c in by]
            keys, last = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)), batch.column(len(by))
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                z = np.array(last.take(pa.array(at)).to_pylist(), np.float64)
                sums = [len(z), z.sum(axis=0), z.T @ z]
                found[k] = [a + b for a, b in zip(found[k], sums, strict=True)] if k in found else sums
        for k, (n, total, products) in found.items():
            d = len(total)
            keys = [pa.array([v] * d, t) for v, t in zip(k, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total), pa.array(list(products), pa.list_(pa.float64()))], [f.name for f in schema])

    parts = rows.select(*by, F.col("z")).mapInArrow(run, schema)
    sums = parts.select(*by, "i", "n", "total", F.posexplode("products").alias("j", "p")).groupBy(*by, "i", "j").agg(F.sum("p").alias("p"), F.sum("total").alias("t"), F.sum("n").alias("n"))
    lines = sums.groupBy(*by, "i").agg(F.sort_array(F.collect_list(F.struct("j", "p"))).alias("line"), F.first("t").alias("t"), F.first("n").alias("n"))
    tables = lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "t", "line"))).alias("lines"), F.first("n").alias("windows"))
    means = F.transform("lines", lambda x: x["t"] / F.col("windows"))
    of = F.transform("lines", lambda x: F.transform(x["line"], lambda y: F.when(F.col("windows") > 1, y["p"] / F.col("windows") - F.get("means", x["i"]) * F.get("means", y["j"])).otherwise((x["i"] == y["j"]).cast("double"))))
    return tables.withColumn("means", means).select(*by, "windows", of.alias("covariance"))


def build_golden(summaries: DataFrame, policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """Profiles whose adaptive baseline begins as the golden one. summaries: machine_id, module_id, summary, error of training windows.

    Centers, scales and the three thresholds are percentiles, covariances partial sums; only the inversion of one matrix a
    group is Python's. A group's windows never meet in a task.
    """
    key = list(GROUP)
    rows = summaries.select("machine_id", F.col("module_id").cast("int").alias("module_id"), F.col("summary").cast("array<double>").alias("summary"), F.col("error").cast("double").alias("error"))
    features = rows.select(*key, F.posexplode("summary").alias("pos", "x"))
    spread = center_scale(features, [*key, "pos"], ["x"])
    baseline = written(spread.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "center", "scale"))).alias("b")).select(*key, F.col("b.center").alias("center"), F.col("b.scale").alias("scale")), "baseline")
    z = F.zip_with(F.zip_with("summary", "center", lambda x, c: x - c), "scale", lambda d, s: d / F.greatest(s, F.lit(EPS)))
    moments = covariances(rows.join(baseline, key).select(*key, z.alias("z")), key).join(baseline, key)

    def invert(frames):
        for f in frames:
            yield f[key].assign(windows=f["windows"], center=f["center"], scale=f["scale"], inverse=[shrunk_inverse_of(np.stack(c), policy.shrinkage).tolist() for c in f["covariance"]])

    one = written(moments.mapInPandas(invert, "machine_id string, module_id int, windows long, center array<double>, scale array<double>, inverse array<array<double>>"), "golden")
    judged = rows.join(one, key).select(*key, "error", feature_deviation(F.col("summary"), F.col("center"), F.col("scale")).alias("deviation"), relation_distance(F.col("summary"), F.col("center"), F.col("scale"), F.col("inverse")).alias("distance"))
    for name in ("error", "deviation", "distance"):
        limit = percentiles(judged, key, name, {f"{name}_threshold": 0.99})
        one = one.join(limit, key).withColumn(f"{name}_threshold", F.greatest(f"{name}_threshold", F.lit(EPS)))
    names = ("center", "scale", "inverse", "error_threshold", "deviation_threshold", "distance_threshold")
    return one.select(*key, "windows", *[F.col(n).alias(f"{k}_{n}") for k in ("golden", "adaptive") for n in names])


def alert_rates(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg((F.col("adaptive_risk") >= 1).cast("double")).alias("alert_rate"))


@dataclass(frozen=True)
class Rates:
    """What a candidate is judged by."""

    windows: int
    days: int
    champion_reference: float
    candidate_reference: float
    candidate_recent: float
    champion_synthetic: float
    candidate_synthetic: float
    center_step: float
    scale_change: float
    threshold_change: float


SHORT = {"insufficient_candidate_windows", "insufficient_candidate_days"}


def validate_candidate(r: Rates, policy: AdaptivePolicy = AdaptivePolicy()) -> tuple[str, list[str]]:
    """SHADOW if all gates pass; REVIEW_REQUIRED if only data is missing, else AUTO_REJECTED, with the reasons."""
    #: The reasons' names.
    tests = {
        "insufficient_candidate_windows": r.windows < policy.least_windows,
        "insufficient_candidate_days": r.days < policy.least_days,
        "reference_false_alert_rate_regressed": r.candidate_reference > max(policy.reference_alert, r.champion_reference + 0.02),
        "candidate_does_not_fit_eligible_recent_data": r.candidate_recent > policy.reference_alert,
        "synthetic_detection_below_guardrail": r.candidate_synthetic < policy.synthetic_detection,
        "synthetic_detection_regressed": r.candidate_synthetic + policy.synthetic_drop < r.champion_synthetic,
        "center_step_exceeded": r.center_step > policy.center_step_mad + 1e-9,
        "scale_step_exceeded": r.scale_change > policy.scale_change + 1e-9,
        "threshold_step_exceeded": r.threshold_change > policy.threshold_change + 1e-9,
    }
    reasons = [k for k, failed in tests.items() if failed]
    return ("SHADOW", ["all_validation_gates_passed"]) if not reasons else ("REVIEW_REQUIRED" if SHORT.issuperset(reasons) else "AUTO_REJECTED", reasons)


def self_test(alert_rate: float, detection: float, baseline_alert: float, baseline_detection: float, policy: AdaptivePolicy = AdaptivePolicy()) -> tuple[str, list[str]]:
    """A champion is healthy while its reference alerts and detections stay near those at its deployment."""
    reasons = []
    if alert_rate > max(policy.reference_alert, baseline_alert + 0.02):
        reasons.append("reference_false_alert_rate_regressed")
    if detection < min(policy.synthetic_detection, max(0.0, baseline_detection - policy.synthetic_drop)):
        reasons.append("synthetic_detection_regressed")
    return ("AUTO_ROLLED_BACK" if reasons else "CHAMPION_HEALTHY"), reasons


def rollback_target(history: DataFrame, by: list[str]) -> DataFrame:
    """(by, version, saved_at): the profile that a group falls back to, the last one saved; of equals the largest version. Groups without a history have no row."""
    return history.groupBy(*by).agg(F.max(F.struct("saved_at", "version")).alias("r")).select(*by, "r.version", "r.saved_at")


def bounded_buffer(arrivals: DataFrame, by: list[str], order: str, policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """The last rows to arrive, and total_seen of the group."""
    w = Window.partitionBy(*by)
    return arrivals.withColumn("total_seen", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(order).desc()))).where(F.col("_r") <= policy.buffer).drop("_r")


@dataclass
class Candidate:
    observations: int = 0
    validated_total: int = -1


def advance(candidate: Candidate | None, champion_total: int, total_seen: int, validate, policy: AdaptivePolicy = AdaptivePolicy()) -> tuple[str, Candidate | None]:
    """One step of a group's candidate: validate() is asked only when there is new data; it returns an outcome and reasons."""
    if candidate is not None and total_seen <= candidate.validated_total:
        return "SHADOW_WAIT", candidate
    if candidate is None:
        if total_seen - champion_total < policy.least_windows:
            return "NO_CANDIDATE", None
        candidate = Candidate()
    outcome, _ = validate()
    if outcome == "AUTO_REJECTED":
        return outcome, None
    if outcome == "REVIEW_REQUIRED":
        return outcome, Candidate(candidate.observations, total_seen)
    seen = candidate.observations + 1
    return ("AUTO_APPROVED", None) if seen >= policy.shadow_observations else ("SHADOW", Candidate(seen, total_seen))
