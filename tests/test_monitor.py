"""The monitor's operators: each query against its SQL, and the semantics that the tables don't show."""

import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fleetvane.config import AdaptivePolicy, MonitorPolicy
from fleetvane.functions import scalar
from fleetvane.operators import adaptive, cycle, evidence, forests, lifecycle, profiles, sequences, windows
from fleetvane.plans import catalog, cycle_queries  # noqa: F401
from fleetvane.sources import logs, stores
from fleetvane.streaming import monitor


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(df):
    def one(v):
        if isinstance(v, float) and math.isnan(v) or v is None or v is pd.NaT or v is pd.NA:
            return "None"
        if isinstance(v, (float, np.floating)):
            return str(int(v)) if float(v).is_integer() else f"{v:.8g}"  # pandas turns integers beside nulls into floats
        return str(v)[:10] if hasattr(v, "year") else str(v).removesuffix(".0")

    cols = sorted(df.columns)
    return cols, sorted(tuple(one(v).removesuffix(".0") for v in row) for row in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [k for k, q in catalog.ALL.items() if q.sql])
def test_query_equals_sql(spark, duck, name):
    assert plain(catalog.ALL[name].run(spark, SF).toPandas()) == plain(duck.execute(catalog.ALL[name].sql).df())


def rows(spark, data, start=0):
    base = {"machine_id": "MX1", "module_id": 1, "global_status": "Run", "module_status": "On", "busy": 0.0, "sv": "On", "hp1": 145.0, "lp1": 28.0, "hp2": 195.0, "lp2": 17.0, "valve": 80.0, "temphi": 90.0, "templo": -30.0}
    made = [{**base, "s": start + i, "us": (start + i) * 1_000_000, "source_order": i, **x} for i, x in enumerate(data)]
    return spark.createDataFrame(pd.DataFrame(made)).withColumn("module_id", F.col("module_id").cast("int"))


def test_four_bad_rows_are_rejected(spark):
    data = [{} for _ in range(70)]
    data[5], data[6], data[7], data[8] = {"module_status": "ChangeValve"}, {"busy": 1.0}, {"valve": -200.0}, {"templo": -200.0}
    assert sequences.row_flags(rows(spark, data)).where("not is_active").count() == 4


def test_gap_filling_reaches_five_seconds_into_a_long_gap(spark):
    data = [{"s": s} for s in (*range(0, 10), 15, 40)]
    filled = sequences.segments(sequences.fill_short_gaps(sequences.active_runs(sequences.row_flags(rows(spark, data)))))
    got = [r.s for r in filled.orderBy("s").collect()]
    assert got == [*range(0, 21), 40] and filled.select("segment_id").distinct().count() == 2


def test_windows_of_a_long_segment(spark):
    w = sequences.sliding_windows(sequences.features(sequences.segments(sequences.fill_short_gaps(sequences.active_runs(sequences.row_flags(rows(spark, [{}] * 180)))))))
    assert w.count() == 13 and w.where("end_s - start_s <> 59").count() == 0


@pytest.mark.parametrize("change, status, reason", [({}, "ELIGIBLE", ""), ({"templo": -200.0}, "DATA_QUALITY_REVIEW", "SENTINEL_VALUE,TEMPERATURE_OUT_OF_RANGE"), ({"valve": -1.0}, "DATA_QUALITY_REVIEW", "NEGATIVE_VALVE"), ({"module_status": "ChangeValve"}, "OFF_OR_TRANSITION", "OFF_OR_NON_RUNNING_STATE,TRANSITION_OR_SETTLING"), ({"lp2": None}, "DATA_QUALITY_REVIEW", "NON_FINITE_SENSOR,PRESSURE_OUT_OF_RANGE"), ({"us": 99_000_000}, "DATA_QUALITY_REVIEW", "DUPLICATE_TIMESTAMP")])
def test_window_status(spark, change, status, reason):
    data = [{} for _ in range(300)]
    data[100] = change
    got = windows.event_windows(rows(spark, data)).first()
    assert (got.window_status, ",".join(got.quality_reasons)) == (status, reason) and got.point_count == 300 and abs(got.coverage - 1) < 1e-9


def test_short_windows(spark):
    one = windows.event_windows(rows(spark, [{}] * 10)).first()
    gap = windows.event_windows(rows(spark, [{"us": (i + 20 * (i > 150)) * 1_000_000} for i in range(270)])).first()
    assert one.quality_reasons == ["TOO_FEW_POINTS"] and gap.quality_reasons == ["TIME_GAP_EXCEEDED"]


def test_evidence_equals_a_fold(spark):
    rng, policy, data = random.Random(3), MonitorPolicy(), []
    for mode in range(4):
        t = 0
        for _ in range(150):
            t += rng.choice([300, 300, 300, 900, 1200])
            data.append(("MX1", 1, f"m{mode}", t, *(rng.gauss(0, 2.5) for _ in range(4))))
    df = spark.createDataFrame(data, "machine_id string, module_id int, operating_mode string, window_start_s long, z_hp2 double, z_lp2 double, z_gap double, z_span double")
    got = {(r.operating_mode, r.window_start_s): (r.reason_codes, r.persistent_s) for r in evidence.latched_evidence(df, policy).collect()}
    for mode in range(4):
        on, last, began, history = set(), None, None, []
        for row in (r for r in data if r[2] == f"m{mode}"):
            t, z = row[3], dict(zip(("HP2_ROBUST_Z", "LP2", "PRESSURE_GAP_ANOMALY", "TEMPERATURE_SPAN_ANOMALY"), row[4:], strict=True))
            now = {k for k in z if k != "LP2" and abs(z[k]) >= (policy.exit_z if k in on else policy.entry_z)}
            if z["LP2"] <= -(policy.exit_z if "LP2_NEGATIVE_RESIDUAL" in on else policy.entry_z):
                now.add("LP2_NEGATIVE_RESIDUAL")
            if last is not None and t - last > policy.reset_s:
                began, history = None, []
                on.discard("LP2_DOWNWARD_TREND")
            history = [(u, v) for u, v in history if u >= t - policy.trend_s] + [(t, z["LP2"])]
            trend = z["LP2"] - history[0][1]
            if abs(trend) >= policy.trend_exit if "LP2_DOWNWARD_TREND" in on else trend <= policy.trend_entry:
                now.add("LP2_DOWNWARD_TREND")
            began = (t if began is None else began) if now else None
            assert got[f"m{mode}", t] == (sorted(now), t - began + 300 if now else 0)
            on, last = now, t


def test_review_level(spark):
    level = evidence.review_level(F.col("st"), F.col("a"), F.col("sa"), F.col("b"), F.col("sb"))
    cases = [("ELIGIBLE", True, 900, True, 900, "P1_REVIEW"), ("ELIGIBLE", True, 1800, False, 0, "P2_REVIEW"), ("ELIGIBLE", False, 0, True, 300, "SHADOW"), ("ELIGIBLE", False, 0, False, 0, "NORMAL"), ("UNKNOWN_REGIME", True, 9999, True, 9999, "UNKNOWN_REGIME")]
    df = spark.createDataFrame([c[:5] for c in cases], "st string, a boolean, sa long, b boolean, sb long").select(level.alias("l"))
    assert [r.l for r in df.collect()] == [c[5] for c in cases]


def context_frame(n=120):
    rng = np.random.default_rng(12)
    hp2, valve, hi, lo = (rng.normal(m, s, n) for m, s in ((210, 3), (60, 2), (70, 1), (20, 1)))
    lp2 = 10 + 0.1 * hp2 + 0.2 * valve + rng.normal(0, 0.3, n)
    f = pd.DataFrame({"machine_id": "MX1", "module_id": 1, "operating_mode": "SV_ON_VALVE_B2", "window_start_s": np.arange(n) * 300, "hp1": 140.0 + rng.normal(0, 1, n), "lp1": 28.0 + rng.normal(0, 1, n), "hp2": hp2, "lp2": lp2, "valve": valve, "temphi": hi, "templo": lo})
    return f.assign(pressure_gap=f.hp2 - f.lp2, pressure_ratio=f.hp2 / f.lp2, temperature_span=f.temphi - f.templo)


def test_regimes_resolve_and_abstain(spark):
    f = context_frame()
    df = spark.createDataFrame(f).withColumn("module_id", F.col("module_id").cast("int"))
    regimes = profiles.fit_regimes(df)
    far = df.limit(1).withColumns({"hp2": F.lit(900.0), "lp2": F.lit(900.0), "valve": F.lit(900.0)})
    assert profiles.resolve_regimes(df, regimes).where("regime like 'R%'").count() > 110
    assert profiles.resolve_regimes(far, regimes).first().regime == "UNKNOWN_REGIME"
    fitted = profiles.fit_bundle(df)[1].collect()
    assert fitted and all(r.forest_exit <= r.forest_entry and r.residual_scale < 1 for r in fitted)


def test_fitted_profiles_score_windows(spark):
    """A fitted bundle scores the windows it was fit on, and an outlier by its forest; without a profile a window isn't NORMAL."""
    f = context_frame()
    df = spark.createDataFrame(f).withColumn("module_id", F.col("module_id").cast("int")).withColumns({"window_status": F.lit("ELIGIBLE"), "quality_reasons": F.array().cast("array<string>"), "point_count": F.lit(300), "coverage": F.lit(1.0)})
    regimes, contexts = (x.persist() for x in profiles.fit_bundle(df))
    modules = spark.createDataFrame([("MX1", 1, "v1")], "machine_id string, module_id int, profile_version string")
    scored = cycle.score_windows(df, modules, regimes, contexts).collect()
    known = [r for r in scored if r.window_status == "ELIGIBLE"]
    assert len(scored) == len(f) and len(known) > 60 and all(0 < r.forest_score < 1 for r in known) and all(r.review_level == r.window_status for r in scored if r not in known)
    first, both = cycle.clean_windows(df, df.select("machine_id", "module_id", "window_start_s", F.lit(0.5).alias("ratio")), lambda w: (regimes, contexts))
    assert first.count() == len(f) and 0 < both.count() < len(f)
    assert {r.review_level for r in cycle.score_windows(df, modules.where("false"), regimes, contexts).collect()} == {"PROFILE_NOT_ACTIVE"}
    assert cycle.flat_decisions(cycle.score_windows(df, modules, regimes, contexts)).count() == len(f)


def test_ridge_equals_normal_equations():
    f = context_frame()
    x, y = f[list(profiles.RIDGE_FEATURES)].to_numpy(), f.lp2.to_numpy()
    dx, dy = x - x.mean(0), y - y.mean()
    a, b = profiles.ridge_of(len(x), x.mean(0), y.mean(), dx.T @ dx / len(x), dx.T @ dy / len(x), float(np.median(y)))
    assert abs((y - a - x @ b).mean()) < 1e-9 and np.allclose(dx.T @ (y - a - x @ b), b)
    assert profiles.ridge_of(24, x.mean(0), y.mean(), dx.T @ dx / len(x), dx.T @ dy / len(x), 7.0) == (7.0, *[pytest.approx(np.zeros(4))])
    line = np.outer(np.arange(4.0), np.arange(4.0))
    assert profiles.ridge_of(99, x.mean(0), y.mean(), line, line[0], 7.0)[0] == 7.0


def test_forest_isolates_outliers():
    x = np.random.default_rng(0).normal(size=(300, 4))
    forest = forests.Forest.from_bytes(forests.Forest.fit(x).to_bytes())
    assert forest.score(np.full((1, 4), 9.0))[0] > np.quantile(forest.score(x), 0.99)


def test_candidate_states():
    ok, bad = lambda: ("SHADOW", []), lambda: ("AUTO_REJECTED", ["x"])
    assert adaptive.advance(None, 0, 100, ok)[0] == "NO_CANDIDATE"
    outcome, c = adaptive.advance(None, 0, 200, ok)
    assert outcome == "SHADOW" and adaptive.advance(c, 0, 200, ok)[0] == "SHADOW_WAIT"
    outcome, c = adaptive.advance(c, 0, 201, ok)
    assert adaptive.advance(c, 0, 202, ok) == ("AUTO_APPROVED", None) and adaptive.advance(c, 0, 202, bad)[0] == "AUTO_REJECTED"
    rates = adaptive.Rates(10, 1, 0, 0, 0, 1, 1, 0, 0, 0)
    assert adaptive.validate_candidate(rates)[0] == "REVIEW_REQUIRED"
    assert adaptive.self_test(0.2, 0.9, 0.0, 1.0)[0] == "AUTO_ROLLED_BACK" and adaptive.self_test(0.0, 0.9, 0.0, 1.0)[0] == "CHAMPION_HEALTHY"


def test_shifted_summaries_drift(spark):
    rng = np.random.default_rng(42)
    data = [("MX1", 1, rng.normal(size=4).tolist(), float(abs(rng.normal(0.5, 0.1)))) for _ in range(300)]
    df = spark.createDataFrame(data, "machine_id string, module_id int, summary array<double>, error double")
    golden = adaptive.build_golden(df)
    shifted = df.withColumn("summary", F.transform("summary", lambda x: x + 10))
    assert adaptive.dual_scores(shifted, golden, ["machine_id", "module_id"]).where("not baseline_drift").count() == 0
    assert adaptive.dual_scores(df, golden, ["machine_id", "module_id"], AdaptivePolicy()).where("baseline_drift").count() < 20


def test_lifecycle(spark, tmp_path):
    life = lifecycle.Lifecycle(spark, str(tmp_path / "events"))
    life.move("MX1", "COLLECTING_DATA", "start")
    with pytest.raises(ValueError):
        life.approve("MX1", "me")
    life.move("MX1", "APPROVAL_REQUIRED", "shadow passed", candidate_version="v1")
    life.approve("MX1", "me")
    assert (life.state("MX1").state, life.state("MX1").active_version, life.events().count()) == ("ACTIVE", "v1", 3)


def test_logs(spark, tmp_path):
    (tmp_path / "a_2026_07_12.csv").write_text("preamble\nTime, Status, Hp_1st_1, Status_1\n10:00:00, Run, 145, On\n10:00:01, Run, x, On\nbad, Run, 1, On\n")
    (tmp_path / "b_2026_07_13.csv").write_text("no header here\n")
    (tmp_path / "static_2026_07_13.csv").write_text("Time\n")
    paths = [r.path for r in logs.discover(spark, str(tmp_path)).collect()]
    long, errors = logs.read_logs(spark, paths, "MX1", (1, 2))
    got = sorted((str(r.timestamp), r.module_id, r.hp1, r.module_status, r.sv) for r in long.collect())
    assert len(paths) == 2 and errors.count() == 1
    assert got == [("2026-07-12 10:00:00", 1, 145.0, "On", "<blank>"), ("2026-07-12 10:00:00", 2, None, "<blank>", "<blank>"), ("2026-07-12 10:00:01", 1, None, "On", "<blank>"), ("2026-07-12 10:00:01", 2, None, "<blank>", "<blank>")]


def test_machines(tmp_path):
    m = stores.Machines(str(tmp_path / "m.json"))
    assert m.put("7", "10.0.0.7", password="x")["name"] == "MX007" and "password" not in m.all()[0]
    for name, ip in (("8", "10.0.0.7"), ("x; drop", "10.0.0.8"), ("9", "10.0.0")):
        with pytest.raises(ValueError):
            m.put(name, ip)


def test_scores(spark):
    r = spark.range(1).select(scalar.machine_name(F.lit("mx12")).alias("a"), scalar.machine_name(F.lit("12x")).alias("b"), scalar.operating_mode(F.lit("Off"), F.lit(85.0)).alias("c"), scalar.anomaly_score(F.lit(1.0), F.lit(0.0)).alias("d")).first()
    assert tuple(r) == ("MX012", None, "SV_OFF_VALVE_B3", None)


def test_stream_equals_batch(spark, tmp_path):
    rng, data = random.Random(5), []
    for mode in range(3):
        t = 0
        for _ in range(60):
            t += rng.choice([300, 300, 900])
            data.append(("MX1", 1, f"m{mode}", t, rng.random() < 0.7))
    schema = "machine_id string, module_id int, operating_mode string, window_start_s long, active boolean"
    df = spark.createDataFrame(data, schema)
    for i, part in enumerate((df.where("window_start_s < 9000"), df.where("window_start_s >= 9000"))):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = monitor.persistence_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    w = evidence.KEY
    from pyspark.sql import Window

    t = F.col("window_start_s")
    withgap = df.withColumn("_b", F.coalesce((t - F.lag(t).over(Window.partitionBy(*w).orderBy(t)) > 600).cast("int"), F.lit(0))).withColumn("island", F.sum("_b").over(Window.partitionBy(*w).orderBy(t))).drop("_b")
    want = {tuple(r) for r in evidence.persistence(withgap, "active").select("operating_mode", "window_start_s", "active", "persistent_s").collect()}
    assert got == want
