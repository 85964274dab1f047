"""Validation of candidate baselines and self-tests of deployed ones, as jobs over reference, recent and synthetic rows.

All groups are judged in one pass: each row is scored by its group's champion and candidate, and counts of alerts and
detections are what is left of a group. Versions are files of their own, one per group and number, that are written only if
there is none yet, so of two validators one wins and the other is told.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.config import AdaptivePolicy
from fleetvane.functions.scalar import feature_deviation
from fleetvane.operators.adaptive import EPS, synthetic_challenge
from fleetvane.operators.profiles import relation_distance
from fleetvane.shared import put_if_absent

#: What one baseline of a group is: its operational side, which adapts, and the golden side that never does.
BASELINE = ("adaptive_center", "adaptive_scale", "adaptive_inverse", "adaptive_error_threshold", "adaptive_deviation_threshold", "adaptive_distance_threshold")
RATES = ("windows", "days", "champion_reference", "candidate_reference", "candidate_recent", "champion_synthetic", "candidate_synthetic", "center_step", "scale_change", "threshold_change")


def operational_risk(prefix: str = "") -> Column:
    """The adaptive side's risk of a row (summary, error) by a baseline whose columns have this prefix."""
    center, scale, inverse, error, deviation, distance = (F.col(prefix + c) for c in BASELINE)
    summary = F.col("summary")
    return F.greatest(F.col("error") / error, feature_deviation(summary, center, scale) / deviation, relation_distance(summary, center, scale, inverse) / distance)


def challenged(reference: DataFrame, champions: DataFrame, by: list[str], order: str, policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """The reference rows, each with one feature moved beyond its champion's golden limit."""
    golden = champions.select(*by, "golden_center", "golden_scale", "golden_deviation_threshold")
    return synthetic_challenge(reference.join(golden, by), by, order, "golden_deviation_threshold", policy).drop("golden_center", "golden_scale", "golden_deviation_threshold")


def _rate(kind: str, alert: str) -> Column:
    """Share of alerts among a kind's rows; 0 without any."""
    return F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col(alert).cast("double"))), F.lit(0.0))


def candidate_rates(champions: DataFrame, candidates: DataFrame, reference: DataFrame, recent: DataFrame, by: list[str], order: str, policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """(by..., RATES): the ten figures that a candidate is judged by, of every group that has one.

    champions have both sides of a profile, candidates their adaptive one; reference and recent rows are (by..., order,
    summary, error), recent ones with day. Groups without recent rows have none of these, and 0 days.
    """
    one = reference.select(*by, order, "summary", "error")
    rows = one.withColumn("kind", F.lit("reference")).unionByName(challenged(one, champions, by, order, policy).withColumn("kind", F.lit("synthetic")))
    rows = rows.withColumn("day", F.lit(None).cast("string")).unionByName(recent.select(*by, order, "summary", "error", F.lit("recent").alias("kind"), F.col("day").cast("string").alias("day")))
    old = champions.select(*by, "golden_scale", *[F.col(c).alias(f"old_{c}") for c in BASELINE])
    profiles = old.join(candidates.select(*by, *[F.col(c).alias(f"new_{c}") for c in BASELINE]), by)
    judged = rows.join(profiles, by).select(*by, "kind", "day", (operational_risk("old_") >= 1).alias("old_alert"), (operational_risk("new_") >= 1).alias("new_alert"))
    rates = judged.groupBy(*by).agg(
        F.count(F.when(F.col("kind") == "recent", 1)).alias("windows"),
        F.count_distinct(F.when(F.col("kind") == "recent", F.col("day"))).alias("days"),
        _rate("reference", "old_alert").alias("champion_reference"),
        _rate("reference", "new_alert").alias("candidate_reference"),
        _rate("recent", "new_alert").alias("candidate_recent"),
        _rate("synthetic", "old_alert").alias("champion_synthetic"),
        _rate("synthetic", "new_alert").alias("candidate_synthetic"),
    )
    step = F.array_max(F.zip_with(F.zip_with("new_adaptive_center", "old_adaptive_center", lambda n, o: F.abs(n - o)), "golden_scale", lambda d, s: d / F.greatest(s, F.lit(EPS))))
    scale = F.array_max(F.zip_with("new_adaptive_scale", "old_adaptive_scale", lambda n, o: F.abs(n / F.greatest(o, F.lit(EPS)) - 1)))
    threshold = F.abs(F.col("new_adaptive_error_threshold") / F.greatest("old_adaptive_error_threshold", F.lit(EPS)) - 1)
    moved = profiles.select(*by, step.alias("center_step"), scale.alias("scale_change"), threshold.alias("threshold_change"))
    return rates.join(moved, by).select(*by, *RATES)


def verdicts(rates: DataFrame, policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """rates with outcome and reasons: SHADOW if all gates pass, REVIEW_REQUIRED if only data is missing, else AUTO_REJECTED."""
    c = F.col
    #: The reasons' names.
    short = {"insufficient_candidate_windows": c("windows") < policy.least_windows, "insufficient_candidate_days": c("days") < policy.least_days}
    gates = {
        "reference_false_alert_rate_regressed": c("candidate_reference") > F.greatest(F.lit(policy.reference_alert), c("champion_reference") + 0.02),
        "candidate_does_not_fit_eligible_recent_data": c("candidate_recent") > policy.reference_alert,
        "synthetic_detection_below_guardrail": c("candidate_synthetic") < policy.synthetic_detection,
        "synthetic_detection_regressed": c("candidate_synthetic") + policy.synthetic_drop < c("champion_synthetic"),
        "center_step_exceeded": c("center_step") > policy.center_step_mad + 1e-9,
        "scale_step_exceeded": c("scale_change") > policy.scale_change + 1e-9,
        "threshold_step_exceeded": c("threshold_change") > policy.threshold_change + 1e-9,
    }
    failed = lambda tests: F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    out = rates.withColumn("_short", failed(short)).withColumn("_failed", failed(gates))
    outcome = F.when(F.size("_failed") > 0, "AUTO_REJECTED").when(F.size("_short") > 0, "REVIEW_REQUIRED").otherwise("SHADOW")
    reasons = F.concat("_short", "_failed")
    return out.withColumn("outcome", outcome).withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("all_validation_gates_passed")))).drop("_short", "_failed")


def self_tests(champions: DataFrame, frozen: DataFrame, history: DataFrame, by: list[str], order: str, policy: AdaptivePolicy = AdaptivePolicy()) -> DataFrame:
    """(by..., alert_rate, detection, outcome, reasons, restored_version) of every deployed profile on its frozen rows.

    champions also have deployed_alert_rate and deployed_detection, what they showed when they were deployed (null: what
    they show now). history: (by..., version, saved_at), the profiles that were champions before. A failing one falls back
    to the last saved of these; without any it needs a review. Live anomalies play no part.
    """
    one = frozen.select(*by, order, "summary", "error")
    rows = one.withColumn("kind", F.lit("reference")).unionByName(challenged(one, champions, by, order, policy).withColumn("kind", F.lit("synthetic")))
    judged = rows.join(champions.select(*by, *BASELINE), by).select(*by, "kind", (operational_risk() >= 1).alias("alert"))
    rates = judged.groupBy(*by).agg(_rate("reference", "alert").alias("alert_rate"), _rate("synthetic", "alert").alias("detection"))
    tested = rates.join(champions.select(*by, "deployed_alert_rate", "deployed_detection"), by)
    allowed = F.greatest(F.lit(policy.reference_alert), F.coalesce("deployed_alert_rate", "alert_rate") + 0.02)
    required = F.least(F.lit(policy.synthetic_detection), F.greatest(F.lit(0.0), F.coalesce("deployed_detection", "detection") - policy.synthetic_drop))
    failed = F.array_compact(F.array(F.when(F.col("alert_rate") > allowed, F.lit("deployed_reference_alert_rate_failed")), F.when(F.col("detection") < required, F.lit("deployed_synthetic_detection_failed"))))
    last = history.groupBy(*by).agg(F.max(F.struct("saved_at", "version"))["version"].alias("last_version"))
    out = tested.withColumn("_failed", failed).join(last, by, "left")
    bad, known = F.size("_failed") > 0, F.col("last_version").isNotNull()
    outcome = F.when(~bad, "CHAMPION_HEALTHY").when(known, "AUTO_ROLLED_BACK").otherwise("REVIEW_REQUIRED")
    more = F.when(~bad, F.lit("frozen_self_test_passed")).when(known, F.lit("restored_previous_champion")).otherwise(F.lit("no_rollback_profile_available"))
    return out.select(*by, "alert_rate", "detection", outcome.alias("outcome"), F.concat("_failed", F.array(more)).alias("reasons"), F.when(bad, F.col("last_version")).alias("restored_version"))


class Conflict(RuntimeError):
    """Someone else has written the next number first."""


class Versions:
    """A group's champions as numbered files: {version, outcome, reasons, saved_at}. The last number is deployed."""

    SCHEMA = "group string, number long, version string, outcome string, reasons array<string>, saved_at long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", True).json(self.path).where("number is not null")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def deployed(self) -> DataFrame:
        return self.all().groupBy("group").agg(F.max_by(F.struct("number", "version", "outcome", "reasons", "saved_at"), "number").alias("v")).select("group", "v.*")

    def put(self, group: str, expected: int, version: str, outcome: str, reasons: list[str], saved_at: int) -> int:
        """Writes the number after the expected one (-1: none yet); raises Conflict if there is one by now."""
        number = expected + 1
        row = {"group": group, "number": number, "version": version, "outcome": outcome, "reasons": reasons, "saved_at": saved_at}
        if not put_if_absent(self.spark, f"{self.path}/{group}/{number:09d}.json", json.dumps(row)):
            raise Conflict(f"{group} has a version {number} already")
        return number

    def roll_back(self, tests: DataFrame, group: Column, now: int) -> list[tuple[str, str]]:
        """Deploys what failing champions fall back to, once each; (group, version) of those. tests: as self_tests gives them, a row per group."""
        failing = tests.where("outcome = 'AUTO_ROLLED_BACK'").select(group.alias("group"), "restored_version", "reasons").join(self.deployed().select("group", "number"), "group").collect()
        for r in failing:
            self.put(r["group"], r.number, r.restored_version, "AUTO_ROLLED_BACK", list(r.reasons), now)
        return sorted((r["group"], r.restored_version) for r in failing)
