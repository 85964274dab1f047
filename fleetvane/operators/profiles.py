"""Fits per context: regimes by Gaussian mixtures, ridge residuals, outlier forests, shrunk covariances and reconstructors.

Groups are fit from partial sums, percentiles and drawn samples, all groups in the same passes; no task holds one's rows.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fleetvane.config import MonitorPolicy
from fleetvane.operators.forests import forest_scores, forests
from fleetvane.operators.mixtures import fit_groups, log_densities, log_sum
from fleetvane.operators.percentiles import percentiles
from fleetvane.operators.robust import center_scale
from fleetvane.shared import written

REGIME_FEATURES = ("hp2", "lp2", "valve", "temphi", "templo")
RIDGE_FEATURES = ("hp2", "valve", "temphi", "templo")
CONTEXT_FEATURES = ("hp1", "lp1", "hp2", "lp2", "valve", "temphi", "templo", "pressure_gap", "pressure_ratio", "temperature_span")
LEAST_REGIME, SEED = 40, 42


REGIMES = "machine_id string, module_id int, operating_mode string, weights array<double>, means array<array<double>>, covariances array<array<array<double>>>, likelihood_floor double, fallback boolean, windows long, bic double"


def fit_regimes(eligible: DataFrame) -> DataFrame:
    """A mixture per machine, module and mode; components ordered by valve, then second-stage pressure.

    Groups of fewer than LEAST_REGIME windows have one component about their medians. The likelihood floor is the first
    percentile of the group's own log likelihoods. Windows with a null feature don't count.
    """
    key = ["machine_id", "module_id", "operating_mode"]
    rows = eligible.select(*key, F.array(*[F.col(c).cast("double") for c in REGIME_FEATURES]).alias("x")).where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c)))
    rows = written(rows.withColumn("gid", F.xxhash64(*key)), "regime-rows")
    sizes = rows.groupBy("gid", *key).agg(F.count("*").alias("windows"))
    few = rows.join(sizes.where(F.col("windows") < LEAST_REGIME).select("gid"), "gid", "left_semi")
    at = range(len(REGIME_FEATURES))
    x = [F.col("x")[i] for i in at]
    # One window has no spread of its own: it gets a variance of 1.
    spread = F.array(*[F.array(*[F.when(F.count("*") > 1, F.covar_pop(x[i], x[j])).otherwise(float(i == j)) for j in at]) for i in at])
    small = few.groupBy(*key).agg(F.array(F.lit(1.0)).alias("weights"), F.array(F.array(*[F.percentile(c, F.lit(0.5)) for c in x])).alias("means"), F.array(spread).alias("covariances"), F.lit(float("-inf")).alias("likelihood_floor"), F.lit(True).alias("fallback"), F.count("*").alias("windows"), F.lit(None).cast("double").alias("bic"))
    many = rows.join(sizes.where(F.col("windows") >= LEAST_REGIME).select("gid"), "gid", "left_semi").select("gid", "x")
    fitted = []
    for gid, n, m, bic in fit_groups(many, SEED):
        order = np.lexsort((m.means[:, 0], m.means[:, 2]))
        fitted.append((gid, m.weights[order].tolist(), m.means[order].tolist(), m.covariances[order].tolist(), n, float(bic)))
    spark = eligible.sparkSession
    models = spark.createDataFrame(fitted, "gid long, weights array<double>, means array<array<double>>, covariances array<array<array<double>>>, windows long, bic double")
    if not fitted:
        return small.select(*[f.split()[0] for f in REGIMES.split(", ")])
    floors = percentiles(_likelihoods(many, models), ["gid"], "likelihood", {"likelihood_floor": 0.01})
    large = models.join(floors, "gid").join(sizes.select("gid", *key), "gid").withColumn("fallback", F.lit(False))
    names = [f.split()[0] for f in REGIMES.split(", ")]
    return written(small.select(*names).union(large.select(*names)), "regimes")


def _likelihoods(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(gid, likelihood) of the rows by their group's mixture."""
    joined = rows.join(models.select("gid", "weights", "means", "covariances"), "gid")

    def run(frames):
        for f in frames:
            out = np.empty(len(f))
            for _, at in f.reset_index(drop=True).groupby("gid").groups.items():
                m = f.iloc[at[0]]
                x = np.stack(f["x"].iloc[at])
                out[at] = log_sum(log_densities(x, np.stack(m["means"]), np.stack([np.stack(c) for c in m["covariances"]])) + np.log(np.asarray(m["weights"])))
            yield f[["gid"]].assign(likelihood=out)

    return joined.mapInPandas(run, "gid long, likelihood double")


def resolve_regimes(windows: DataFrame, regimes: DataFrame, policy: MonitorPolicy = MonitorPolicy(), policy_floor: bool = True) -> DataFrame:
    """Windows with regime, posterior and log likelihood; a low posterior is told before a low likelihood, a missing mode before both."""
    joined = windows.join(regimes.select("machine_id", "module_id", "operating_mode", "weights", "means", "covariances", "likelihood_floor", "fallback"), ["machine_id", "module_id", "operating_mode"], "left")
    keep = [c for c in windows.columns]

    def run(frames):
        for f in frames:
            out = f[keep].copy()
            out["regime"], out["posterior"], out["log_likelihood"], out["regime_reason"] = "UNKNOWN_REGIME", np.nan, np.nan, "MODE_NOT_IN_PROFILE"
            for _, part in f[f["means"].notna()].groupby(["machine_id", "module_id", "operating_mode"]):
                m, x = part.iloc[0], part[list(REGIME_FEATURES)].to_numpy(np.float64)
                if m["fallback"]:
                    p, ll, best = np.ones(len(x)), np.zeros(len(x)), np.zeros(len(x), int)
                    reason = np.full(len(x), "", object)
                else:
                    logs = log_densities(x, np.stack(m["means"]), np.stack([np.stack(c) for c in m["covariances"]])) + np.log(np.asarray(m["weights"]))
                    ll = log_sum(logs)
                    post = np.exp(logs - ll[:, None])
                    best, p = post.argmax(axis=1), post.max(axis=1)
                    floor = max(m["likelihood_floor"], policy.likelihood_floor) if policy_floor else m["likelihood_floor"]
                    reason = np.where(p < policy.least_posterior, "LOW_POSTERIOR", np.where(ll < floor, "LOW_LIKELIHOOD", ""))
                out.loc[part.index, "regime"] = np.where(reason == "", np.char.add("R", best.astype(str)), "UNKNOWN_REGIME")
                out.loc[part.index, "posterior"], out.loc[part.index, "log_likelihood"], out.loc[part.index, "regime_reason"] = p, ll, reason
            yield out

    schema = windows.select(*keep).schema.add("regime", "string").add("posterior", "double").add("log_likelihood", "double").add("regime_reason", "string")
    return joined.mapInPandas(run, schema)


def ridge_of(n: int, mean_x: np.ndarray, mean_y: float, xx: np.ndarray, xy: np.ndarray, median_y: float, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from a context's moments (xx and xy: population covariances); the median alone with fewer than 25 rows or a design of rank under 2."""
    spread = np.sqrt(np.maximum(np.linalg.eigvalsh(xx), 0))
    if n < 25 or (spread > 1e-7 * max(spread.max(), 1e-300)).sum() < 2:
        return median_y, np.zeros(len(mean_x))
    b = np.linalg.solve(n * xx + alpha * np.eye(len(mean_x)), n * xy)
    return float(mean_y - mean_x @ b), b


PROFILES = "machine_id string, module_id int, operating_mode string, regime string, windows long, intercept double, coefficients array<double>, centers map<string,double>, scales map<string,double>, residual_center double, residual_scale double, forest_entry double, forest_exit double, forest binary"


def ridges(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, windows, intercept, coefficients) of lp2 by RIDGE_FEATURES, from moments; rows have no nulls. Only the solution of four equations a context is Python's."""
    x, y = [F.col(c).cast("double") for c in RIDGE_FEATURES], F.col("lp2").cast("double")
    moments = rows.groupBy(*key).agg(F.count("*").alias("windows"), F.array(*map(F.avg, x)).alias("mx"), F.avg(y).alias("my"), F.array(*[F.covar_pop(a, b) for a in x for b in x]).alias("xx"), F.array(*[F.covar_pop(a, y) for a in x]).alias("xy"))
    medians = percentiles(rows, key, "lp2", {"median": 0.5})

    width = len(RIDGE_FEATURES)

    def solve(frames):
        for f in frames:
            found = [ridge_of(int(n), np.asarray(mx), my, np.reshape(xx, (width, width)), np.asarray(xy), m) for n, mx, my, xx, xy, m in zip(f["windows"], f["mx"], f["my"], f["xx"], f["xy"], f["median"], strict=True)]
            yield f[[*key, "windows"]].assign(intercept=[a for a, _ in found], coefficients=[b.tolist() for _, b in found])

    schema = rows.select(*key).schema.add("windows", "long").add("intercept", "double").add("coefficients", ArrayType(DoubleType()))
    return moments.join(medians, key).mapInPandas(solve, schema)


def fit_contexts(resolved: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """A profile per machine, module, mode and regime with 25 windows at least; windows of unknown regime or with a null feature are left out.

    Coefficients come from moments, centers, scales and the forest's levels from percentiles, and the forest's trees from
    drawn samples: no task holds a context's windows.
    """
    key = ["machine_id", "module_id", "operating_mode", "regime"]
    rows = resolved.where("regime <> 'UNKNOWN_REGIME'").select(*key, *[F.col(c).cast("double").alias(c) for c in CONTEXT_FEATURES]).dropna(subset=list(CONTEXT_FEATURES))
    enough = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= policy.least_context)
    rows = written(rows.join(enough.select(*key), key, "left_semi"), "context-rows")
    lines = written(ridges(rows, key), "ridges")
    spread = center_scale(rows, key, list(CONTEXT_FEATURES), floor=1e-6).groupBy(*key)
    entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", c))))
    stats = written(spread.agg(entries("center").alias("centers"), entries("scale").alias("scales")), "spreads")
    predicted = F.col("intercept") + sum((F.col("coefficients")[i] * F.col(c) for i, c in enumerate(RIDGE_FEATURES)), F.lit(0.0))
    residuals = written(rows.join(lines, key).withColumn("residual", F.col("lp2") - predicted).drop("intercept", "coefficients", "windows"), "residuals")
    of_residual = written(center_scale(residuals, key, ["residual"], floor=1e-6).select(*key, F.col("center").alias("residual_center"), F.col("scale").alias("residual_scale")), "residual-spreads")
    z = lambda c: (F.col(c) - F.col("centers")[c]) / F.col("scales")[c]
    vectors = residuals.join(stats, key).join(of_residual, key).select(*key, z("hp2").alias("z_hp2"), ((F.col("residual") - F.col("residual_center")) / F.col("residual_scale")).alias("z_lp2"), z("pressure_gap").alias("z_gap"), z("temperature_span").alias("z_span"))
    vectors, names = written(vectors, "vectors"), ["z_hp2", "z_lp2", "z_gap", "z_span"]
    grown = written(forests(vectors, key, names), "forests")
    levels = percentiles(forest_scores(vectors, grown, key, names), key, "forest_score", {"forest_entry": 0.99, "forest_exit": 0.95})
    out = lines.join(stats, key).join(of_residual, key).join(levels, key).join(grown, key)
    return written(out.select(*[f.split()[0] for f in PROFILES.split(", ")]), "contexts")


def fit_bundle(eligible: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> tuple[DataFrame, DataFrame]:
    """Regimes and context profiles; the policy's likelihood floor is off while fitting."""
    regimes = fit_regimes(eligible)
    return regimes, fit_contexts(resolve_regimes(eligible, regimes, policy, policy_floor=False), policy)


def shrunk_inverse_of(covariance: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    """Pseudo-inverse of a population covariance of standardised rows, shrunk towards its diagonal."""
    c = np.atleast_2d(covariance)
    return np.linalg.pinv((1 - shrinkage) * c + shrinkage * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c)), hermitian=True)


def relation_distance(summary: Column, center: Column, scale: Column, inverse: Column) -> Column:
    """sqrt(max(z' S z, 0) / p) of arrays."""
    z = F.zip_with(F.zip_with(summary, center, lambda x, c: x - c), scale, lambda d, s: d / F.greatest(s, F.lit(1e-8)))
    rows = F.transform(inverse, lambda r: F.aggregate(F.zip_with(r, z, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    q = F.aggregate(F.zip_with(rows, z, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(q, F.lit(0.0)) / F.size(summary))


class Reconstructor(Protocol):
    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        """Of (windows, time, features) the same shape."""


class Scaled:
    """Returns its input times a factor."""

    def __init__(self, factor: float = 0.95):
        self.factor = factor

    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        return batch * self.factor


class Components:
    """Principal components over time steps: what the leading ones keep of a row."""

    def __init__(self, mean: np.ndarray, basis: np.ndarray):
        self.mean, self.basis = mean, basis

    @classmethod
    def fit(cls, rows: np.ndarray, k: int) -> Components:
        mean = rows.mean(axis=0)
        return cls(mean, np.linalg.svd(rows - mean, full_matrices=False)[2][:k])

    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        return (batch - self.mean) @ self.basis.T @ self.basis + self.mean


def reconstruction_errors(windows: DataFrame, model: Reconstructor, names: tuple[str, ...]) -> DataFrame:
    """error, feature_errors and top_feature of each window's seq."""
    keep = [c for c in windows.columns if c != "seq"]

    def run(frames):
        for f in frames:
            x = np.stack([np.stack(s) for s in f["seq"]]).astype(np.float64)
            e = np.abs(x - model.reconstruct(x))
            by = e.mean(axis=1)
            yield f[keep].assign(error=e.mean(axis=(1, 2)), feature_errors=list(by), top_feature=[names[i] for i in by.argmax(axis=1)])

    schema = windows.select(*keep).schema.add("error", "double").add("feature_errors", ArrayType(DoubleType())).add("top_feature", "string")
    return windows.mapInPandas(run, schema)


def bucket_evidence(errors: DataFrame, by: list[str], threshold: float, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """Per bucket: the error quantile against the threshold; fewer than three sequences are no evidence."""
    agg = errors.groupBy(*by).agg(F.count("*").alias("sequences"), F.percentile("error", F.lit(policy.error_quantile)).alias("score"), F.avg((F.col("error") >= threshold).cast("double")).alias("exceedance"))
    enough = F.col("sequences") >= policy.least_sequences
    return agg.withColumn("active", enough & (F.col("score") >= threshold)).withColumn("reason", F.when(~enough, "LSTM_SHADOW_INSUFFICIENT_SEQUENCES").when(F.col("score") >= threshold, "LSTM_RECONSTRUCTION_ERROR"))
