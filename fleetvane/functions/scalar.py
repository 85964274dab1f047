"""Scalar operators as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetvane.config import AdaptivePolicy, MonitorPolicy


def number(x: Column) -> Column:
    """A double, null where it can't be read, is NaN or infinite."""
    d = x.cast("double") if not isinstance(x, str) else F.col(x).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def parsed_number(x: Column) -> Column:
    """The same of text, which may hold anything."""
    return number(x.try_cast("double"))


def gap(hp: Column, lp: Column) -> Column:
    return hp - lp


def ratio(hp: Column, lp: Column, least: float = 1e-6) -> Column:
    """hp over |lp|, which counts as `least` at least; null if either is."""
    return F.when(lp.isNotNull(), hp / F.greatest(F.abs(lp), F.lit(least)))


def token(x: Column) -> Column:
    return F.lower(F.trim(x))


def text_or(x: Column, missing: str = "nan") -> Column:
    return F.coalesce(F.trim(x), F.lit(missing))


def operating_mode(sv: Column, valve: Column, policy: MonitorPolicy = MonitorPolicy()) -> Column:
    """SV_ON or SV_OFF, and the valve's bin; bins are closed on the left."""
    b1, b2, b3 = policy.valve_bins
    on = F.when(token(sv).isin(*policy.sv_on_tokens), F.lit("SV_ON")).otherwise(F.lit("SV_OFF"))
    bin_ = F.when(valve < b1, 0).when(valve < b2, 1).when(valve < b3, 2).otherwise(3)
    return F.concat(on, F.lit("_VALVE_B"), bin_.cast("string"))


def group_name(machine: Column, module: Column) -> Column:
    return F.concat(F.regexp_replace(machine, "[^A-Za-z0-9_-]+", "_"), F.lit("__M"), F.when(module < 10, F.concat(F.lit("0"), module.cast("string"))).otherwise(module.cast("string")))


def machine_name(x: Column) -> Column:
    """MX and at least three digits, of an id like "7" or "mx007"; null for anything else."""
    digits = F.regexp_extract(F.trim(x), r"^(?i:MX)?([0-9]{1,20})$", 1)
    return F.when(digits != "", F.concat(F.lit("MX"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)))


def anomaly_score(error: Column, threshold: Column) -> Column:
    """In [0, 1); null without a positive threshold."""
    return F.when(threshold > 0, 1 - F.exp(-F.greatest(error, F.lit(0.0)) / threshold))


def raw_health(score: Column) -> Column:
    return 100 * (1 - F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def health_label(health: Column) -> Column:
    return F.when(health >= 80, "Normal").when(health >= 60, "Watch").when(health >= 40, "Warning").otherwise("Critical")


def combined_risk(operational: Column, golden: Column, policy: AdaptivePolicy = AdaptivePolicy()) -> Column:
    return F.greatest(operational, policy.golden_weight * golden)


def risk_health(risk: Column) -> Column:
    return F.least(F.greatest(100 - 40 * risk, F.lit(0.0)), F.lit(100.0))


def risk_status(risk: Column, policy: AdaptivePolicy = AdaptivePolicy()) -> Column:
    a, b, c = policy.bands
    return F.when(risk < a, "Normal").when(risk < b, "Watch").when(risk < c, "Warning").otherwise("Critical")


def threshold_ratio(score: Column, threshold: Column) -> Column:
    """Null without a threshold other than 0."""
    return F.when(threshold.isNotNull() & (threshold != 0), score / threshold)


def feature_deviation(summary: Column, center: Column, scale: Column) -> Column:
    """The largest |z| over the features of arrays."""
    z = F.zip_with(F.zip_with(summary, center, lambda x, c: x - c), scale, lambda d, s: F.abs(d) / F.greatest(s, F.lit(1e-8)))
    return F.array_max(z)


def first_argmax(names: Column, values: Column) -> Column:
    """The name of the largest value; the first of equals."""
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def mean_absolute_error(x: Column, y: Column) -> Column:
    """Over all elements of two arrays of arrays."""
    a, b = F.flatten(x), F.flatten(y)
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.abs(u.cast("double") - v.cast("double"))), F.lit(0.0), lambda s, e: s + e) / F.size(a)


def feature_errors(x: Column, y: Column) -> Column:
    """Of each feature (inner position), the mean absolute error over time (outer position)."""
    zero = F.transform(x[0], lambda _: F.lit(0.0))
    rows = F.zip_with(x, y, lambda u, v: F.zip_with(u, v, lambda p, q: F.abs(p.cast("double") - q.cast("double"))))
    total = F.aggregate(rows, zero, lambda s, r: F.zip_with(s, r, lambda p, q: p + q))
    return F.transform(total, lambda t: t / F.size(x))


def coverage_percent(coverage: Column) -> Column:
    return coverage * 100


#: What a monitor shows a level or state as.
TONES = {"danger": ("P1_REVIEW", "REJECTED"), "warning": ("P2_REVIEW", "APPROVAL_REQUIRED"), "info": ("SHADOW", "SHADOW_VALIDATION"), "success": ("NORMAL", "ACTIVE")}


def tone(level: Column) -> Column:
    found = F
    for name, levels in TONES.items():
        found = found.when(level.isin(*levels), name)
    return found.otherwise("neutral")
