"""Profiles from partial sums against the same fits by numpy on whole groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetvane.operators import adaptive, mixtures, percentiles, profiles
from fleetvane.operators.forests import Forest, mean_path
from fleetvane.shared import written


def slow_mixture(x, means):
    """Expectation maximisation on a whole group, about its components' means."""
    n, d = x.shape
    k = len(means)
    resp, last = np.eye(k)[((x[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)], -np.inf
    for _ in range(200):
        size = resp.sum(axis=0) + 1e-9
        weights, means = size / n, (resp.T @ x) / size[:, None]
        covs = np.stack([((resp[:, j, None] * (x - means[j])).T @ (x - means[j])) / size[j] + 1e-5 * np.eye(d) for j in range(k)])
        logs = mixtures.log_densities(x, means, covs) + np.log(weights)
        total = mixtures.log_sum(logs)
        resp = np.exp(logs - total[:, None])
        if abs(total.mean() - last) < 1e-3:
            break
        last = total.mean()
    return float(total.sum()), weights, means, covs


def test_mixture_equals_a_whole_fit(spark):
    rng = np.random.default_rng(4)
    groups = {g: np.concatenate([rng.normal(m, s, (n, 3)) for m, s, n in parts]) for g, parts in {1: [(0, 1, 150), (6, 2, 90)], 2: [(100, 0.5, 70)], 3: [(-3, 1, 60), (0, 1, 60), (4, 0.3, 60)]}.items()}
    rows = [(g, x.tolist()) for g, xs in groups.items() for x in xs]
    df = written(spark.createDataFrame(rows, "gid long, x array<double>").repartition(5), "rows")
    models = {g: [mixtures.Mixture(xs[: k + 1].copy()) for k in range(3)] for g, xs in groups.items()}
    mixtures.iterate(df, models, {g: len(xs) for g, xs in groups.items()})
    for g, xs in groups.items():
        for k, m in enumerate(models[g]):
            likelihood, weights, means, covs = slow_mixture(xs, xs[: k + 1].copy())
            assert m.done and abs(m.likelihood - likelihood) < 1e-6 * abs(likelihood)
            assert np.allclose(m.weights, weights, atol=1e-6) and np.allclose(m.means, means, atol=1e-6) and np.allclose(m.covariances, covs, atol=1e-6)
    best = {g: m for g, _, m, _ in mixtures.fit_groups(df)}
    assert len(best[2].weights) == 1 and len(best[1].weights) >= 2 and len(best[3].weights) == 3
    assert all(np.allclose(m.weights @ m.means, groups[g].mean(axis=0), atol=1e-6) for g, m in best.items())


def test_regimes_of_groups(spark):
    rng = np.random.default_rng(5)
    parts = [("A", 20.0, 120), ("A", 60.0, 100), ("B", 40.0, 12), ("C", 10.0, 1)]
    f = pd.concat([pd.DataFrame({"machine_id": m, "module_id": 1, "operating_mode": "X", "hp2": rng.normal(200, 2, n), "lp2": rng.normal(50, 1, n), "valve": rng.normal(v, 1, n), "temphi": rng.normal(70, 1, n), "templo": rng.normal(20, 1, n)}) for m, v, n in parts])
    df = spark.createDataFrame(f).withColumn("module_id", F.col("module_id").cast("int")).repartition(4)
    got = {r.machine_id: r for r in profiles.fit_regimes(df.unionByName(df.limit(1).withColumn("hp2", F.lit(None).cast("double")))).collect()}
    a = got["A"]
    assert (a.windows, a.fallback, len(a.weights)) == (220, False, 2) and a.means[0][2] < 30 < 50 < a.means[1][2]
    x = f[f.machine_id == "A"][list(profiles.REGIME_FEATURES)].to_numpy()
    logs = mixtures.log_sum(mixtures.log_densities(x, np.array(a.means), np.array(a.covariances)) + np.log(a.weights))
    assert abs(a.likelihood_floor - np.quantile(logs, 0.01)) < 1e-9
    b = f[f.machine_id == "B"][list(profiles.REGIME_FEATURES)].to_numpy()
    assert got["B"].fallback and np.allclose(got["B"].means, [np.median(b, axis=0)]) and np.allclose(got["B"].covariances, [np.cov(b, rowvar=False, ddof=0)])
    assert np.allclose(got["C"].covariances, [np.eye(5)])
    assert profiles.fit_regimes(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [30, 10**6])
def test_golden_profiles_equal_a_whole_fit(spark, monkeypatch, few):
    monkeypatch.setattr(percentiles, "FEW", few)
    rng = np.random.default_rng(6)
    groups = {("M1", 1): rng.normal(3, 2, (90, 5)) @ rng.normal(0, 1, (5, 5)), ("M1", 2): np.column_stack([rng.normal(0, 1, (40, 4)), np.full(40, 7.0)]), ("M2", 1): np.ones((1, 5))}
    rows = [(*k, x.tolist(), float(abs(x).sum())) for k, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "machine_id string, module_id int, summary array<double>, error double").repartition(5)
    got = {(r.machine_id, r.module_id): r for r in adaptive.build_golden(df).collect()}
    assert len(got) == 3
    for k, x in groups.items():
        g, center = got[k], np.median(x, axis=0)
        mad, std = 1.4826 * np.median(np.abs(x - center), axis=0), x.std(axis=0)
        scale = np.where(mad > 1e-8, mad, np.where(std > 1e-8, std, 1.0))
        z = (x - center) / scale
        inverse = profiles.shrunk_inverse_of(np.cov(z, rowvar=False, ddof=0) if len(x) > 1 else np.eye(5))
        distance = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, inverse, z), 0) / 5)
        limits = [max(float(np.percentile(v, 99)), 1e-8) for v in (np.abs(x).sum(axis=1), np.abs(z).max(axis=1), distance)]
        assert g.windows == len(x) and np.allclose(g.golden_center, center) and np.allclose(g.adaptive_scale, scale)
        assert np.allclose(g.golden_inverse, inverse, rtol=1e-5, atol=1e-6 * np.abs(inverse).max())
        assert np.allclose([g.golden_error_threshold, g.golden_deviation_threshold, g.adaptive_distance_threshold], limits, rtol=1e-6)


@pytest.mark.parametrize("few", [30, 10**6])
def test_contexts_equal_a_whole_fit(spark, monkeypatch, few):
    monkeypatch.setattr(percentiles, "FEW", few)
    rng = np.random.default_rng(7)
    frames = []
    for mode, n in (("A", 700), ("B", 60), ("C", 20)):
        f = pd.DataFrame({c: rng.normal(50, 5, n) for c in profiles.CONTEXT_FEATURES}).assign(machine_id="M", module_id=1, operating_mode=mode, regime="R0")
        frames.append(f.assign(lp2=3 + 0.2 * f.hp2 - 0.1 * f.valve + rng.normal(0, 0.2, n)))
    whole = pd.concat(frames)
    df = spark.createDataFrame(whole).withColumn("module_id", F.col("module_id").cast("int")).repartition(5)
    df = df.unionByName(df.limit(3).withColumn("regime", F.lit("UNKNOWN_REGIME"))).unionByName(df.limit(2).withColumn("hp1", F.lit(float("nan"))))
    got = {r.operating_mode: r for r in profiles.fit_contexts(df).collect()}
    assert set(got) == {"A", "B"}
    for mode, g in got.items():
        f = whole[whole.operating_mode == mode]
        x, y = f[list(profiles.RIDGE_FEATURES)].to_numpy(), f.lp2.to_numpy()
        dx = x - x.mean(axis=0)
        b = np.linalg.solve(dx.T @ dx + np.eye(4), dx.T @ (y - y.mean()))
        a = y.mean() - x.mean(axis=0) @ b
        assert g.windows == len(f) and np.allclose(g.coefficients, b) and abs(g.intercept - a) < 1e-6
        residual = y - a - x @ b
        center = float(np.median(residual))
        assert abs(g.residual_center - center) < 1e-9 and abs(g.residual_scale - 1.4826 * np.median(np.abs(residual - center))) < 1e-9
        for c in profiles.CONTEXT_FEATURES:
            assert abs(g.centers[c] - f[c].median()) < 1e-9 and abs(g.scales[c] - 1.4826 * (f[c] - f[c].median()).abs().median()) < 1e-9
        z = lambda c: (f[c].to_numpy() - g.centers[c]) / g.scales[c]  # noqa: B023, E731
        v = np.column_stack([z("hp2"), (residual - g.residual_center) / g.residual_scale, z("pressure_gap"), z("temperature_span")])
        forest = Forest.from_bytes(g.forest)
        score = forest.score(v)
        assert forest.size == min(256, len(f)) and len(forest.roots) == 200
        assert abs(g.forest_entry - np.quantile(score, 0.99)) < 1e-9 and abs(g.forest_exit - np.quantile(score, 0.95)) < 1e-9
        assert forest.score(np.full((1, 4), 9.0))[0] > g.forest_entry


def test_forest_scores_are_those_of_walks():
    """Each point walked down each tree by itself."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    f = Forest.fit(x, trees=7)

    def path(p, at):
        while f.feature[at] >= 0:
            at = f.low[at] if p[f.feature[at]] < f.cut[at] else f.high[at]
        return f.path[at]

    want = [sum(path(p, r) for r in f.roots) for p in x]
    assert np.allclose(f.score(x), 2.0 ** (-np.array(want) / 7 / mean_path(f.size)))
