"""Reconstructors: a recurrent one against values worked out by hand and a plain loop, components against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetvane.operators import profiles, reconstruct
from fleetvane.operators.reconstruct import Lstm, Recurrent


def test_one_unit_by_hand():
    layer = Lstm(np.array([[0.5, -0.25, 1.0, 0.0]]), np.array([[0.1, 0.2, -0.3, 0.4]]), np.array([0.0, 1.0, 0.0, -0.5]))
    s = lambda v: 1 / (1 + math.exp(-v))
    c1 = s(1.0) * math.tanh(2.0)
    h1 = s(-0.5) * math.tanh(c1)
    c2 = s(0.25 + 1 + 0.2 * h1) * c1 + s(-0.5 + 0.1 * h1) * math.tanh(-1 - 0.3 * h1)
    h2 = s(-0.5 + 0.4 * h1) * math.tanh(c2)
    assert np.allclose(layer.run(np.array([[[2.0], [-1.0]]])), [[[h1], [h2]]])


def plain(layers, x):
    """One window by loops over units."""
    s = lambda v: 1 / (1 + math.exp(-v))
    for kernel, recurrent, bias in layers:
        units, out = len(recurrent), []
        h, c = [0.0] * units, [0.0] * units
        for row in x:
            z = [bias[g] + sum(row[i] * kernel[i][g] for i in range(len(row))) + sum(h[u] * recurrent[u][g] for u in range(units)) for g in range(4 * units)]
            c = [s(z[units + u]) * c[u] + s(z[u]) * math.tanh(z[2 * units + u]) for u in range(units)]
            h = [s(z[3 * units + u]) * math.tanh(c[u]) for u in range(units)]
            out.append(h)
        x = out
    return x


def test_encoder_and_decoder(spark):
    rng = np.random.default_rng(2)
    make = lambda i, u: (rng.normal(0, 0.5, (i, 4 * u)), rng.normal(0, 0.5, (u, 4 * u)), rng.normal(0, 0.5, 4 * u))
    enc, dec = [make(3, 4), make(4, 2)], [make(2, 2), make(2, 4)]
    w, b = rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3)
    model = Recurrent(tuple(Lstm(*x) for x in enc), tuple(Lstm(*x) for x in dec), w, b)
    x = rng.normal(0, 1, (5, 6, 3))
    want = [np.array(plain(dec, [plain(enc, one.tolist())[-1]] * 6)) @ w + b for one in x]
    again = Recurrent.from_bytes(model.to_bytes())
    assert np.allclose(model.reconstruct(x), want) and np.array_equal(again.reconstruct(x), model.reconstruct(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, seq array<array<double>>")
    got = {r.i: r.error for r in profiles.reconstruction_errors(df, again, ("a", "b", "c")).collect()}
    assert np.allclose([got[i] for i in range(5)], [np.abs(v - y).mean() for v, y in zip(x, want, strict=True)])
    with pytest.raises(ValueError):
        Recurrent((Lstm(*make(3, 4)),), (Lstm(*make(5, 2)),), w, b)
    with pytest.raises(ValueError):
        Lstm(np.zeros((3, 8)), np.zeros((2, 4)), np.zeros(8))


def test_components(spark):
    rng = np.random.default_rng(3)
    data = {g: rng.normal(0, 1, (30, 5, 4)) @ rng.normal(0, 1, (4, 4)) + 7 for g in ("a", "b")}
    rows = [(g, i, x.tolist()) for g, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, i int, seq array<array<double>>").repartition(4)
    models = reconstruct.fit_components(df, ["g"], 2)
    errors = {(r.g, r.i): (r.error, r.top_feature) for r in reconstruct.component_errors(df, models, ["g"], ("w", "x", "y", "z")).collect()}
    for g, xs in data.items():
        flat = xs.reshape(-1, 4)
        basis = np.linalg.svd(flat - flat.mean(axis=0), full_matrices=False)[2][:2]
        for i, x in enumerate(xs):
            d = x - flat.mean(axis=0)
            e = np.abs(d - d @ basis.T @ basis)
            assert abs(errors[g, i][0] - e.mean()) < 1e-9 and errors[g, i][1] == "wxyz"[e.mean(axis=0).argmax()]
    whole = reconstruct.component_errors(df, reconstruct.fit_components(df, ["g"], 9), ["g"], ("w", "x", "y", "z"))
    assert whole.agg(F.max("error")).first()[0] < 1e-9
