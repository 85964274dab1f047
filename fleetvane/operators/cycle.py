"""One scoring cycle: event windows meet the profiles of their machine, module, mode and regime.

Every window stays. One that isn't eligible keeps its status; an eligible one without a profile, of an unknown mode or
regime, or without a context gets the status and the reason that say so; the others get evidence, its persistence and a
review level. Profiles are joined without a broadcast hint: their number grows with the fleet, and AQE knows their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvane.config import MonitorPolicy
from fleetvane.operators import evidence
from fleetvane.operators.forests import forest_scores
from fleetvane.operators.profiles import RIDGE_FEATURES, resolve_regimes

KEY = ("machine_id", "module_id", "operating_mode", "regime")
UNKNOWN = "UNKNOWN_REGIME"
VECTOR = ("z_hp2", "z_lp2", "z_gap", "z_span")


def look_up(windows: DataFrame, modules: DataFrame, regimes: DataFrame, contexts: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """Windows with profile_version, regime, their context's columns (null without one), missing (the reason, or null), window_status.

    modules: (machine_id, module_id, profile_version); regimes and contexts as profiles.fit_regimes and fit_contexts make
    them. A context's forest isn't joined.
    """
    j = windows.join(modules.select("machine_id", "module_id", "profile_version"), ["machine_id", "module_id"], "left")
    j = resolve_regimes(j, regimes, policy)
    known = contexts.select(*KEY, "intercept", "coefficients", "centers", "scales", "residual_center", "residual_scale", "forest_entry", "forest_exit")
    j = j.join(known, list(KEY), "left")
    eligible, profiled = F.col("window_status") == "ELIGIBLE", F.col("profile_version").isNotNull()
    missing = F.when(~eligible, None).when(~profiled, "PROFILE_NOT_ACTIVE").when(F.col("regime") == UNKNOWN, F.col("regime_reason")).when(F.col("intercept").isNull(), "CONTEXT_PROFILE_NOT_AVAILABLE")
    status = F.when(~eligible, F.col("window_status")).when(~profiled, "PROFILE_NOT_ACTIVE").when(F.col("missing").isNotNull(), UNKNOWN).otherwise("ELIGIBLE")
    looked = j.withColumn("missing", missing).withColumn("window_status", status)
    # Mode and regime are told only where they were asked for.
    asked = profiled & F.col("window_status").isin("ELIGIBLE", UNKNOWN)
    return looked.withColumns({c: F.when(asked, F.col(c)) for c in ("operating_mode", "regime", "posterior", "log_likelihood")})


def scores(looked: DataFrame) -> DataFrame:
    """predicted_lp2, lp2_residual and the four z scores of the windows that have a context; null elsewhere."""
    at = lambda c: F.col("coefficients")[c]
    predicted = F.col("intercept") + sum((at(i) * F.col(c) for i, c in enumerate(RIDGE_FEATURES)), F.lit(0.0))
    z = lambda x, center, scale: (x - center) / F.greatest(scale, F.lit(1e-6))
    of = lambda c: z(F.col(c), F.col("centers")[c], F.col("scales")[c])
    scored = F.col("window_status") == "ELIGIBLE"
    out = looked.withColumn("predicted_lp2", F.when(scored, predicted)).withColumn("lp2_residual", F.col("lp2") - F.col("predicted_lp2"))
    return out.withColumns({"z_hp2": F.when(scored, of("hp2")), "z_lp2": z(F.col("lp2_residual"), F.col("residual_center"), F.col("residual_scale")), "z_gap": F.when(scored, of("pressure_gap")), "z_span": F.when(scored, of("temperature_span"))}).drop("coefficients", "centers", "scales")


def _when_scored(c: Column | str) -> Column:
    return F.when(F.col("_scored"), F.col(c) if isinstance(c, str) else c)


def with_second(scored: DataFrame, second: DataFrame | None) -> DataFrame:
    """Scored windows with the second evidence, and _scored: whether they take part in evidence at all."""
    if second is None:
        scored = scored.withColumns({"second_active": F.lit(False), "second_score": F.lit(None).cast("double"), "second_threshold": F.lit(None).cast("double"), "second_reason": F.lit(None).cast("string")})
    else:
        scored = scored.join(second, ["machine_id", "module_id", "window_start_s"], "left")
    return scored.withColumn("_scored", F.col("window_status") == "ELIGIBLE").withColumn("second_active", F.col("_scored") & F.coalesce("second_active", F.lit(False)))


def decided(out: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """Windows with both evidences (active, persistent_s, second_s, reason_codes, trend, score) get their review level; those without evidence have none."""
    out = out.withColumns({"active": F.coalesce(_when_scored("active"), F.lit(False)), "persistent_s": F.coalesce(_when_scored("persistent_s"), F.lit(0)), "score": _when_scored("score"), "trend": _when_scored("trend")})
    level = evidence.review_level(F.col("window_status"), F.col("active"), F.col("persistent_s"), F.col("second_active"), F.col("second_s"), policy)
    codes = F.concat(F.col("quality_reasons"), F.array("missing"), F.when(F.col("_scored"), F.col("reason_codes")).otherwise(F.array()), F.array(F.when(F.col("_scored"), F.col("second_reason"))))
    out = out.withColumn("reason_codes", F.array_sort(F.array_distinct(F.array_compact(codes)))).withColumn("review_level", level)
    return out.withColumn("unknown_regime", F.col("window_status") == UNKNOWN).drop("_scored")


def score_windows(windows: DataFrame, modules: DataFrame, regimes: DataFrame, contexts: DataFrame, second: DataFrame | None = None, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """All windows with both evidences, seconds of persistence, reason_codes and review_level.

    second: (machine_id, module_id, window_start_s, second_active, second_score, second_threshold, second_reason), the
    shadow model's evidence per window; windows that it lacks have none.
    """
    scored = scores(look_up(windows, modules, regimes, contexts, policy))
    scored = forest_scores(scored, contexts.where("forest is not null").select(*KEY, "forest"), list(KEY), list(VECTOR))
    # Windows without evidence form groups of their own, so that one pass does for all.
    key = (*KEY, "_scored")
    out = evidence.latched_evidence(with_second(scored, second), policy, key)
    return decided(evidence.persistence(out, "second_active", policy, "second_s", key), policy)


def clean_windows(eligible: DataFrame, ratios: DataFrame, fit, policy: MonitorPolicy = MonitorPolicy(), most_ratio: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The two passes that choose the windows of a first profile: (after the first, after both).

    First, windows whose shadow score is at most most_ratio of its threshold (ratios: machine_id, module_id,
    window_start_s, ratio; a window without one is left out). Then those that a preliminary profile, fit on these, doesn't
    flag; a window of unknown mode, regime or context counts as flagged. Hysteresis plays no part here. fit(windows) gives
    (regimes, contexts).
    """
    first = eligible.join(ratios.where(F.col("ratio") <= most_ratio).select("machine_id", "module_id", "window_start_s"), ["machine_id", "module_id", "window_start_s"], "left_semi")
    regimes, contexts = fit(first)
    modules = first.select("machine_id", "module_id").distinct().withColumn("profile_version", F.lit("preliminary"))
    scored = scores(look_up(first, modules, regimes, contexts, policy))
    scored = forest_scores(scored, contexts.where("forest is not null").select(*KEY, "forest"), list(KEY), list(VECTOR))
    a = policy.entry_z
    flagged = (F.col("window_status") != "ELIGIBLE") | (F.abs("z_hp2") >= a) | (F.col("z_lp2") <= -a) | (F.abs("z_gap") >= a) | (F.abs("z_span") >= a) | F.coalesce(F.col("forest_score") >= F.col("forest_entry"), F.lit(False))
    return first, scored.where(~flagged).select(*eligible.columns)


def flat_decisions(scored: DataFrame) -> DataFrame:
    """One flat point per decision, with numbers that aren't finite as null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    ratio = F.when(F.col("second_threshold") != 0, finite("second_score") / F.col("second_threshold"))
    return scored.select(
        "machine_id", "module_id", "window_start_s", "window_status", "review_level", "operating_mode", "regime", "profile_version", "reason_codes", "point_count", "unknown_regime",
        *[finite(c).alias(c) for c in ("posterior", "log_likelihood", "coverage", "predicted_lp2", "lp2_residual", *VECTOR, "forest_score", "forest_entry", "forest_exit", "trend", "score")],
        F.col("active").alias("first_active"), F.col("persistent_s").alias("first_s"), "second_active", "second_s", finite("second_score").alias("second_score"), "second_threshold", ratio.alias("second_ratio"),
    )
