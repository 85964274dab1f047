"""Local calibration against numpy, which calibration holds, and the stores of metrics."""

import numpy as np
from pyspark.sql import functions as F

from fleetvane.operators import adaptive, profiles, serving, shadow
from fleetvane.sources import stores

NAMES = ("a", "b", "c")
SCHEMA = "machine_id string, start_s long, seq array<array<float>>"


def windows_of(spark, groups):
    rng = np.random.default_rng(4)
    data = {g: rng.normal(3, 2, (n, 4, 3)).astype(np.float32) for g, n in groups.items()}
    for x in data.values():
        x[:, :, 2] = 7  # a feature that never changes
    rows = [(g, i, x[i].tolist()) for g, x in data.items() for i in range(len(x))]
    return data, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_local_calibration(spark):
    data, w = windows_of(spark, {"A": 20, "B": 19, "C": 33})
    got = {r.machine_id: r for r in shadow.local_calibration(w, profiles.Scaled(0.5), NAMES, ["machine_id"], ["start_s"]).collect()}
    assert set(got) == {"A", "C"}
    for g, r in got.items():
        x, n = data[g], len(data[g])
        train, valid = int(n * 0.7), int(n * 0.85)
        flat = x[:train].reshape(-1, 3).astype(np.float64)
        scale = np.where(flat.std(axis=0) < 1e-8, 1, flat.std(axis=0))
        z = ((x[train:valid] - flat.mean(axis=0)) / scale).astype(np.float32)
        errors = np.abs(z * 0.5).mean(axis=(1, 2))
        assert (r.training_windows, r.validation_windows) == (train, valid - train)
        assert np.allclose(r.scaler_mean, flat.mean(axis=0)) and np.allclose(r.scaler_scale, scale)
        assert np.isclose(r.threshold, max(np.quantile(errors, 0.99), 1e-8), rtol=1e-5)
    assert shadow.local_calibration(w.limit(0), profiles.Scaled(), NAMES, ["machine_id"], ["start_s"]).count() == 0


def test_which_calibration_holds(spark):
    data, w = windows_of(spark, {"A": 6, "B": 6, "C": 6, "D": 2})
    scalers = shadow.fit_scalers(w, ["machine_id"])
    trained = scalers.where("machine_id in ('A', 'B')").withColumn("threshold", F.lit(0.001))
    local = scalers.where("machine_id = 'A'").withColumn("threshold", F.lit(99.0))
    out = {(r.machine_id, r.bucket): r for r in shadow.shadow_evidence(w, trained, local, profiles.Scaled(0.5), NAMES, ["machine_id"], F.lit(0)).collect()}
    assert {k[0]: r.calibration_source for k, r in out.items()} == {"A": "LOCAL_BOOTSTRAP", "B": "TRAINED_GROUP", "C": None, "D": None}
    assert {k[0]: r.active for k, r in out.items()} == {"A": False, "B": True, "C": False, "D": False}
    assert {k[0]: r.reason for k, r in out.items() if k[0] in "CD"} == {"C": "LSTM_SHADOW_GROUP_NOT_CONFIGURED", "D": "LSTM_SHADOW_INSUFFICIENT_SEQUENCES"}
    assert {k[0]: r.sequences for k, r in out.items()} == {"A": 6, "B": 6, "C": 6, "D": 2}


def test_group_metrics_store(spark, tmp_path):
    rows = [("MX000", 1, 0.1, 0.2, 0.3, 0.4, 0.5), ("MX000", 2, float("nan"), None, float("inf"), 0.4, 0.0)]
    stores.write_group_metrics(spark.createDataFrame(rows, stores.GROUP_METRICS), str(tmp_path / "m"))
    assert stores.read_group_metrics(spark, str(tmp_path / "m")).count() == 2
    one = stores.read_group_metrics(spark, str(tmp_path / "m"), "MX000", 2).collect()
    assert [tuple(r) for r in one] == [("MX000", 2, None, None, None, 0.4, 0.0)]
    assert stores.read_group_metrics(spark, str(tmp_path / "m"), "MX001").count() == 0


def test_status_and_rollback(spark):
    champions = spark.createDataFrame([("A", "v1"), ("B", "v2")], "g string, champion_version string")
    candidates = spark.createDataFrame([("B", "v3")], "g string, candidate_version string")
    buffers = spark.createDataFrame([("A", 5), ("A", 5)], "g string, total_seen long")
    got = {r.g: tuple(r)[1:] for r in serving.runtime_status(champions, candidates, buffers, ["g"]).collect()}
    assert got == {"A": ("v1", None, 2, 5), "B": ("v2", "v3", 0, 0)}
    history = spark.createDataFrame([("A", "v1", 1), ("A", "v2", 3), ("A", "v3", 3)], "g string, version string, saved_at long")
    assert [tuple(r) for r in adaptive.rollback_target(history, ["g"]).collect()] == [("A", "v3", 3)]
