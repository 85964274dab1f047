"""Reconstructors of windows: a recurrent encoder and decoder from given weights, and principal components that are fit here.

Both plug into profiles.reconstruction_errors and so into thresholds and evidence. Weights of the recurrent one are trained
elsewhere and come as arrays; the fit of components adds up outer products where the rows lie, and only the decomposition of
one small matrix a group is Python's.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from fleetvane.operators.adaptive import covariances


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Lstm:
    """One layer. kernel: (inputs, 4 units), recurrent: (units, 4 units), bias: 4 units; gates in the order input, forget, cell, output."""

    kernel: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        units = len(self.recurrent)
        if self.recurrent.shape != (units, 4 * units) or self.kernel.shape[1:] != (4 * units,) or self.bias.shape != (4 * units,):
            raise ValueError("the shapes of a layer's weights don't belong together")

    def run(self, x: np.ndarray) -> np.ndarray:
        """(windows, time, inputs) to (windows, time, units)."""
        n, steps, _ = x.shape
        units = len(self.recurrent)
        h, c = np.zeros((n, units)), np.zeros((n, units))
        out = np.empty((n, steps, units))
        given = x @ self.kernel + self.bias  # of all steps at once
        for t in range(steps):
            i, f, g, o = np.split(given[:, t] + h @ self.recurrent, 4, axis=1)
            c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
            h = _sigmoid(o) * np.tanh(c)
            out[:, t] = h
        return out


@dataclass(frozen=True)
class Recurrent:
    """Encoder layers, whose last state is repeated over all steps, decoder layers, and a linear layer on each step."""

    encoder: tuple[Lstm, ...]
    decoder: tuple[Lstm, ...]
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        layers = [*self.encoder, *self.decoder]
        sizes = [len(x.recurrent) for x in layers]
        if not self.encoder or not self.decoder or [len(x.kernel) for x in layers[1:]] != sizes[:-1] or self.weights.shape[0] != sizes[-1] or self.weights.shape[1] != len(layers[0].kernel):
            raise ValueError("the layers don't fit one another")

    def reconstruct(self, batch: np.ndarray) -> np.ndarray:
        x = np.asarray(batch, np.float64)
        steps = x.shape[1]
        for layer in self.encoder:
            x = layer.run(x)
        x = np.repeat(x[:, -1:], steps, axis=1)
        for layer in self.decoder:
            x = layer.run(x)
        return x @ self.weights + self.bias

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{side}{i}_{name}": getattr(layer, name) for side in ("encoder", "decoder") for i, layer in enumerate(getattr(self, side)) for name in ("kernel", "recurrent", "bias")}
        np.savez_compressed(out, weights=self.weights, bias=self.bias, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Recurrent:
        a = np.load(io.BytesIO(data))
        side = lambda s: tuple(Lstm(*(a[f"{s}{i}_{name}"] for name in ("kernel", "recurrent", "bias"))) for i in range(sum(k.startswith(s) and k.endswith("kernel") for k in a.files)))
        return cls(side("encoder"), side("decoder"), a["weights"], a["bias"])


def fit_components(windows: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., mean, basis): the k leading principal components of the rows of seq, per group. windows: (by..., seq), without nulls.

    A component's largest weight is positive. Groups with fewer features than k have as many components as features.
    """
    rows = windows.select(*by, F.explode("seq").alias("z")).select(*by, F.transform("z", lambda v: v.cast("double")).alias("z"))
    means = rows.select(*by, F.posexplode("z").alias("pos", "v")).groupBy(*by, "pos").agg(F.avg("v").alias("m")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("ms")).select(*by, F.col("ms.m").alias("mean"))
    centered = rows.join(means, by).select(*by, F.zip_with("z", "mean", lambda a, b: a - b).alias("z"))
    moments = covariances(centered, by).join(means, by)

    def decompose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bases = []
            for c in f["covariance"]:
                vectors = np.linalg.eigh(np.stack(c))[1][:, ::-1][:, :k].T
                top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], 1)
                bases.append((vectors * np.sign(top)).tolist())
            yield f[[*by, "mean"]].assign(basis=bases)

    schema = StructType([*windows.select(*by).schema.fields, StructField("mean", ArrayType(DoubleType())), StructField("basis", ArrayType(ArrayType(DoubleType())))])
    return moments.mapInPandas(decompose, schema)


def component_errors(windows: DataFrame, models: DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    """error, feature_errors and top_feature of each window by its group's components; windows of groups without any are left out."""
    keep = [c for c in windows.columns if c != "seq"]
    joined = windows.join(models.select(*by, "mean", "basis"), by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.reset_index(drop=True)
            error, each = np.empty(len(f)), [None] * len(f)
            for _, at in f.groupby(by, dropna=False).groups.items():
                mean, basis = np.asarray(f["mean"][at[0]]), np.stack(f["basis"][at[0]])
                for i in at:
                    x = np.stack(f["seq"][i]).astype(np.float64) - mean
                    e = np.abs(x - x @ basis.T @ basis)
                    error[i], each[i] = e.mean(), e.mean(axis=0)
            yield f[keep].assign(error=error, feature_errors=each, top_feature=[names[int(v.argmax())] for v in each])

    schema = StructType([*windows.select(*keep).schema.fields, StructField("error", DoubleType()), StructField("feature_errors", ArrayType(DoubleType())), StructField("top_feature", StringType())])
    return joined.mapInPandas(run, schema)
