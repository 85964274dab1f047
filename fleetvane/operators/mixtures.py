"""Gaussian mixtures of groups of any size, by expectation maximisation on partial sums.

A round is one pass over the rows. A task weighs its rows by the present components of their group and adds up what the
next components need: weights, first and second moments, and the log likelihood. One row per group and model leaves a task;
the sums of all tasks make the next components. So a group's rows never meet, and all groups, numbers of components and
starts are fit in the same passes. What reaches the driver are models, in chunks of a bounded number of groups.

Starts are drawn by hashed priorities: the row of a group with the least hash for a start and a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvane.shared import written

MOST_COMPONENTS, STARTS, MOST_ROUNDS, LEAST_GAIN, RIDGE = 3, 5, 200, 1e-3, 1e-5
#: Rows of a group for each component of its mixture.
ROWS_A_COMPONENT = 20
#: Groups whose models are held at a time: 15 models of some 31 numbers each.
CHUNK = 2000
SUMS = "gid long, model int, sums array<double>"


def log_densities(x: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """(rows, components); a covariance that isn't positive is widened."""
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covariances, strict=True)):
        c = np.asarray(c) + 1e-6 * np.eye(x.shape[1])
        sign, logdet = np.linalg.slogdet(c)
        if sign <= 0:
            c = c + 1e-3 * np.eye(x.shape[1])
            logdet = np.linalg.slogdet(c)[1]
        d = x - m
        out[:, k] = -0.5 * (x.shape[1] * np.log(2 * np.pi) + logdet + np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T))
    return out


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


@dataclass
class Mixture:
    """Of one group and start. Before the first round, weights are None, and rows belong to the nearest mean."""

    means: np.ndarray
    weights: np.ndarray | None = None
    covariances: np.ndarray | None = None
    last: float = -np.inf
    likelihood: float = -np.inf
    done: bool = False

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood, and per component weight, first and second moments, of some rows."""
        if self.weights is None:
            near = ((x[:, None] - self.means) ** 2).sum(axis=2).argmin(axis=1)
            resp, total = np.eye(len(self.means))[near], 0.0
        else:
            logs = log_densities(x, self.means, self.covariances) + np.log(self.weights)
            each = log_sum(logs)
            resp, total = np.exp(logs - each[:, None]), float(each.sum())
        second = np.einsum("nk,ni,nj->kij", resp, x, x)
        return np.concatenate([[total], resp.sum(axis=0), (resp.T @ x).ravel(), second.ravel()])

    def next(self, sums: np.ndarray, n: int) -> None:
        """Takes the sums over all rows of the group; done once the mean log likelihood has hardly changed."""
        k, d = self.means.shape
        if self.weights is not None:
            self.likelihood = float(sums[0])
            if abs(self.likelihood / n - self.last) < LEAST_GAIN:
                self.done = True
                return
            self.last = self.likelihood / n
        weight, first, second = sums[1 : 1 + k], sums[1 + k : 1 + k + k * d].reshape(k, d), sums[1 + k + k * d :].reshape(k, d, d)
        size = weight + 1e-9
        self.weights, self.means = size / n, first / size[:, None]
        outer = np.einsum("ki,kj->kij", self.means, first)
        spread = second - outer - outer.transpose(0, 2, 1) + weight[:, None, None] * np.einsum("ki,kj->kij", self.means, self.means)
        self.covariances = spread / size[:, None, None] + RIDGE * np.eye(d)


def _pass(rows: DataFrame, models: dict[int, list[Mixture]]) -> dict[tuple[int, int], np.ndarray]:
    """Sums of all models that aren't done, over all rows (gid, x)."""
    open_ = {g: [(i, m) for i, m in enumerate(ms) if not m.done] for g, ms in models.items()}
    held = rows.sparkSession.sparkContext.broadcast({g: ms for g, ms in open_.items() if ms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            gid, x = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            order = np.argsort(gid, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(gid[order])) + 1):
                for i, m in held.value.get(int(gid[at[0]]), ()) if len(at) else ():
                    key = (int(gid[at[0]]), i)
                    found[key] = found[key] + m.sums(x[at]) if key in found else m.sums(x[at])
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.int64()), pa.array([i for _, i in keys], pa.int32()), pa.array([found[k].tolist() for k in keys], pa.list_(pa.float64()))], ["gid", "model", "sums"])

    parts = rows.mapInArrow(run, SUMS).select("gid", "model", F.posexplode("sums")).groupBy("gid", "model", "pos").agg(F.sum("col").alias("total"))
    out = {}
    for r in parts.groupBy("gid", "model").agg(F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("s")).collect():
        out[r.gid, r.model] = np.array([x.total for x in r.s])
    held.destroy()
    return out


def iterate(rows: DataFrame, models: dict[int, list[Mixture]], sizes: dict[int, int]) -> None:
    """Rounds over rows (gid, x), a written table, until every model is done."""
    for _ in range(MOST_ROUNDS):
        if all(m.done for ms in models.values() for m in ms):
            return
        for (g, i), sums in _pass(rows, models).items():
            models[g][i].next(sums, sizes[g])


def starts(rows: DataFrame, seed: int, most: int = MOST_COMPONENTS, n: int = STARTS) -> DataFrame:
    """(gid, means): for start s and component c, at place s * most + c, the row with the least hash."""
    least = [F.min(F.struct(F.xxhash64("x", F.lit(seed), F.lit(i)).alias("h"), "x"))["x"] for i in range(most * n)]
    return rows.groupBy("gid").agg(F.array(*least).alias("means"))


def information(m: Mixture, n: int) -> float:
    """Bayesian information criterion, less is better."""
    k, d = m.means.shape
    return -2 * m.likelihood + (k * (d + d * (d + 1) / 2) + k - 1) * np.log(n)


def fit_groups(rows: DataFrame, seed: int = 42) -> Iterator[tuple[int, int, Mixture, float]]:
    """(gid, rows, mixture, criterion) of every group of rows (gid, x): the best of MOST_COMPONENTS sizes and STARTS starts. x has no nulls and differs from none in length."""
    center = written(rows.groupBy("gid").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(_dim(rows))]).alias("center")), "centers")
    # Moments are taken about the group's mean, so that nothing cancels.
    moved = written(rows.join(center, "gid").select("gid", F.zip_with("x", "center", lambda a, b: a - b).alias("x")), "moved")
    first = written(starts(moved, seed).join(center, "gid"), "starts")
    chunks = -(-first.count() // CHUNK)
    for c in range(chunks):
        mine = F.pmod(F.xxhash64("gid"), F.lit(chunks)) == c
        groups = first.where(mine).collect()
        models, sizes = {}, {r.gid: r.n for r in groups}
        for r in groups:
            means = np.array(r.means)
            models[r.gid] = [Mixture(means[s * MOST_COMPONENTS : s * MOST_COMPONENTS + k].copy()) for k in range(1, min(MOST_COMPONENTS, max(1, r.n // ROWS_A_COMPONENT)) + 1) for s in range(STARTS if k > 1 else 1)]
        iterate(moved.where(mine) if chunks > 1 else moved, models, sizes)
        for r in groups:
            scored = [(information(m, r.n), i) for i, m in enumerate(models[r.gid])]
            best, i = min(scored)
            m = models[r.gid][i]
            yield r.gid, r.n, Mixture(m.means + np.array(r.center), m.weights, m.covariances, m.last, m.likelihood, m.done), best


def _dim(rows: DataFrame) -> int:
    one = rows.select(F.size("x")).first()
    return one[0] if one else 0
