"""Isolation forests as flat arrays: grown on subsamples, stored with a profile as bytes, and scored beside the windows.

A node is a row of the arrays: the feature it splits (or -1), the cut, its two children, and, at a leaf, the path length
that reaching it stands for.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

TREES, SUBSAMPLE, SEED = 200, 256, 42
#: A context's windows are scored in so many tasks at most; its forest (some 100 kB) goes to each.
SALTS = 8


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The nodes (feature, cut, low, high, path) of a tree of a sample's points, level by level."""
    most = int(np.ceil(np.log2(max(len(x), 2))))
    levels, first = [], 0
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)  # of the level
    count = 1
    for depth in range(most + 1):
        out = np.tile([-1.0, 0.0, -1.0, -1.0, 0.0], (count, 1))
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        sizes = np.bincount(node, minlength=count)
        at = np.cumsum(sizes) - sizes
        split = np.zeros(count, bool)
        if len(rows) and depth < most:
            some = np.flatnonzero(sizes)
            low, high = (f.reduceat(x[rows], at[some], axis=0) for f in (np.minimum, np.maximum))
            spread = high > low
            which = np.flatnonzero(spread.any(axis=1))
            if len(which):
                feature = (rng.random(spread[which].shape) * spread[which]).argmax(axis=1)
                cut = low[which, feature] + rng.random(len(which)) * (high[which, feature] - low[which, feature])
                cut = np.where(cut > low[which, feature], cut, high[which, feature])
                split[some[which]] = True
                out[some[which], 0], out[some[which], 1] = feature, cut
        out[~split, 4] = depth + np.array([mean_path(n) for n in sizes[~split]])
        children = first + count + 2 * np.arange(int(split.sum()))
        out[split, 2], out[split, 3] = children, children + 1
        levels.append(out)
        goes = split[node]
        rows, node = rows[goes], node[goes]
        right = x[rows, out[node, 0].astype(np.int64)] >= out[node, 1]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        first, count = first + count, 2 * int(split.sum())
        if not count:
            break
    return np.concatenate(levels)


class Forest:
    def __init__(self, roots: np.ndarray, feature: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray, path: np.ndarray, size: int):
        self.roots, self.feature, self.cut, self.low, self.high, self.path, self.size = roots, feature, cut, low, high, path, size

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
        """Of points that one task holds; forests() draws the samples of large contexts where their rows lie."""
        rng, n = np.random.default_rng(seed), min(SUBSAMPLE, len(x))
        return cls.of_trees([grow(x[rng.choice(len(x), n, replace=False)], rng) for _ in range(trees)], n)

    @classmethod
    def of_trees(cls, trees: list[np.ndarray], size: int) -> Forest:
        starts = np.cumsum([0, *map(len, trees)])
        nodes = np.concatenate(trees)
        inner = nodes[:, 0] >= 0
        nodes[inner, 2:4] += np.repeat(starts[:-1], list(map(len, trees)))[inner, None]
        f, cut, low, high, path = nodes.T
        return cls(starts[:-1], f.astype(np.int16), cut, low.astype(np.int32), high.astype(np.int32), path, size)

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1), higher the easier a point is to isolate."""
        total = np.zeros(len(x))
        # A high child follows its low one; at a leaf the step stays, as no value reaches an infinite cut.
        leaf = self.feature < 0
        feature, cut, low = np.where(leaf, 0, self.feature).astype(np.int64), np.where(leaf, np.inf, self.cut), np.where(leaf, np.arange(len(leaf)), self.low)
        flat, first = np.ascontiguousarray(x, np.float64).ravel(), np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                after = low[at] + (flat[first + feature[at]] >= cut[at])
                if np.array_equal(after, at):
                    break
                at = after
            total += self.path[at]
        return 2.0 ** (-total / max(len(self.roots), 1) / max(mean_path(self.size), 1e-9))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, roots=self.roots, feature=self.feature, cut=self.cut, low=self.low, high=self.high, path=self.path, size=np.array(self.size))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Forest:
        a = np.load(io.BytesIO(data))
        return cls(a["roots"], a["feature"], a["cut"], a["low"], a["high"], a["path"], int(a["size"]))


def forest_scores(rows: DataFrame, forests: DataFrame, key: list[str], vector: list[str], out: str = "forest_score") -> DataFrame:
    """rows with the score of their vector by the forest of their key; null without one, or with a null in the vector.

    forests: (key, forest). Forests travel as rows of their own, ahead of the windows of their key in the same partition,
    so none is copied into each window, and a key with many windows is dealt to several tasks.
    """
    salt = F.pmod(F.xxhash64(*vector), F.lit(SALTS)).cast("int")
    windows = rows.withColumns({"_salt": salt, "_is": F.lit(1), "_forest": F.lit(None).cast("binary")})
    carried = forests.select(*key, F.col("forest").alias("_forest"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt")).withColumn("_is", F.lit(0))
    both = windows.unionByName(carried, allowMissingColumns=True).repartition(*key, "_salt").sortWithinPartitions(*key, "_salt", "_is")

    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        forest = None
        for frame in frames:
            score = np.full(len(frame), np.nan)
            keys = list(frame[[*key, "_salt"]].itertuples(index=False, name=None))
            start = 0
            while start < len(frame):
                stop = start + 1
                if frame["_is"].iat[start] == 0:
                    held, forest = keys[start], Forest.from_bytes(frame["_forest"].iat[start])
                else:
                    while stop < len(frame) and keys[stop] == keys[start]:
                        stop += 1
                    if held == keys[start]:
                        x = frame[vector].iloc[start:stop].to_numpy(np.float64, na_value=np.nan)
                        score[start:stop] = np.where(np.isfinite(x).all(axis=1), forest.score(np.nan_to_num(x)), np.nan)
                start = stop
            keep = frame["_is"].to_numpy() == 1
            yield frame.loc[keep, names].assign(**{out: score[keep]})

    return both.mapInPandas(run, schema).withColumn(out, F.when(~F.isnan(out), F.col(out)))


def forests(rows: DataFrame, key: list[str], vector: list[str], trees: int = TREES, sample: int = SUBSAMPLE, seed: int = SEED) -> DataFrame:
    """(key, forest) of the rows' vectors, without nulls.

    Each tree's sample is the rows of least hash for that tree: some twice as many are drawn where they lie, the least of
    them are kept. Trees are grown apart from one another; a task holds a tree's sample, or the trees of one forest.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    u = lambda t: F.pmod(F.xxhash64(*vector, F.lit(seed), t), F.lit(1 << 40))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), u(t).alias("u")))
    share = F.least(F.lit(1.0), 2.0 * sample / F.col("_n")) * float(1 << 40)
    drawn = rows.select(*key, *vector).join(sizes, key).withColumn("_share", share).select(*key, *vector, "_n", F.explode(F.filter(draws, lambda d: d["u"] < F.col("_share"))).alias("d"))
    drawn = drawn.select(*key, *vector, "_n", "d.tree", "d.u").withColumn("_place", F.row_number().over(Window.partitionBy(*key, "tree").orderBy("u", *vector))).where(F.col("_place") <= sample)
    fields = [f for f in rows.select(*key).schema.fields]

    # The rows of a tree follow one another, in the order of their draw.
    placed = drawn.select(*key, "tree", "_n", F.xxhash64(*key, "tree").alias("_g"), *vector)

    def of_samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def trees_of(frame: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
            x, tree = frame[vector].to_numpy(np.float64), frame["tree"].to_numpy()
            nodes = [grow(x[a:b], np.random.default_rng([seed, int(tree[a])])).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return frame.iloc[bounds[:-1]][[*key, "tree", "_n"]].assign(nodes=nodes)

        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            bounds = np.flatnonzero(np.diff(frame["_g"].to_numpy(), prepend=frame["_g"].iloc[0] + 1)) if len(frame) else np.zeros(0, np.int64)
            if len(bounds) > 1:
                yield trees_of(frame, bounds)
                frame = frame.iloc[bounds[-1] :]
            rest = frame
        if rest is not None and len(rest):
            yield trees_of(rest.reset_index(drop=True), np.array([0, len(rest)]))

    grown = placed.mapInPandas(of_samples, StructType([*fields, *drawn.select("tree", "_n").schema.fields, StructField("nodes", BinaryType())]))
    together = grown.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("tree", "nodes"))).alias("trees"), F.first("_n").alias("_n"))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [Forest.of_trees([np.frombuffer(t["nodes"], np.float64).reshape(-1, 5).copy() for t in ts], min(sample, int(n))).to_bytes() for ts, n in zip(f["trees"], f["_n"], strict=True)]
            yield f[key].assign(forest=made)

    return together.select(*key, "trees", "_n").mapInPandas(joined, StructType([*fields, StructField("forest", BinaryType())]))
