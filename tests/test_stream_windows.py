"""Windows of a stream against the batch operator over the whole history."""

import random

from pyspark.sql import functions as F

from fleetvane.config import MonitorPolicy
from fleetvane.operators.windows import event_windows
from fleetvane.streaming.windows import WindowStream

SCHEMA = "source_order long, us long, machine_id string, module_id int, global_status string, module_status string, busy double, sv string, hp1 double, lp1 double, hp2 double, lp2 double, valve double, temphi double, templo double"


def history(rng):
    rows = []
    for machine in ("A", "B"):
        t = 0
        for i in range(900):
            t += rng.choice([5, 5, 5, 6, 20]) if i % 90 else rng.choice([5, 700])
            us = (t - rng.choice([0] * 150 + [8])) * 1_000_000
            change = rng.random() < 0.005
            rows.append((i, us, machine, 1, "Run", "ChangeValve" if change else "On", float(rng.random() < 0.002), "On", 120.0, 30.0, 200 + rng.random(), 60.0, 50.0, 70.0, -200.0 if rng.random() < 0.002 else 20.0))
    return rows


def test_stream_equals_batch(spark, tmp_path):
    policy, rng = MonitorPolicy(least_points=10, max_gap_s=60.0, least_coverage=0.4), random.Random(4)
    rows = history(rng)
    parts = [[r for r in rows if r[0] // 180 == k] for k in range(5)]
    parts[2] += parts[1][-20:]  # rows that come again in time
    late = [(10_000, 1_000_000, "A", 1, "Run", "On", 0.0, "On", *([1.0] * 7))]
    parts[4] += late
    stream = WindowStream(spark, str(tmp_path / "store"), policy, late_s=300.0)
    killed = []

    def sink(df, batch):
        if batch == 3 and not killed:
            killed.append(1)
            write = stream._write
            stream._write = lambda df, name, b: write(df, name, b) if name != "bounds" else (_ for _ in ()).throw(RuntimeError("killed"))
            try:
                stream.sink()(df, batch)
            finally:
                stream._write = write
        stream.sink()(df, batch)

    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # a batch that dies is repeated after a restart
            q = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception as e:
                assert "killed" in str(e) and k == 3
    want = event_windows(spark.createDataFrame(rows, SCHEMA), policy)
    end = {m: max(r[1] for r in rows if r[2] == m) for m in "AB"}
    plain = lambda df: {(r.machine_id, r.window_start_s): str(r) for r in df.select(*sorted(df.columns)).collect()}
    all_windows = plain(want)
    due = {k: v for k, v in all_windows.items() if (k[1] + 300) * 1_000_000 <= (end[k[0]] - 300_000_000) // 300_000_000 * 300_000_000}
    got = plain(stream.windows())
    assert got == due and stream.windows().count() == len(due) > 30 and killed
    assert {s for (s,) in want.select("window_status").distinct().collect()} >= {"ELIGIBLE", "DATA_QUALITY_REVIEW", "OFF_OR_TRANSITION"}
    assert [r.source_order for r in stream.late().collect()] == [10_000]
    assert stream.windows().where(F.array_contains("quality_reasons", "OUT_OF_ORDER_TIMESTAMP")).take(1)
