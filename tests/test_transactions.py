"""File transactions, versions, lifecycle events and stores: repeats, crashes and several writers."""

import os

import pytest
from pyspark.sql import functions as F

from fleetvane.config import MonitorPolicy
from fleetvane.operators import lifecycle, validation
from fleetvane.sources import logs, stores
from fleetvane.streaming import files
from fleetvane.streaming.monitor import upsert

HEAD = "Time,Status,Status_1,Hp_1st_1,Lp_1st_1,Hp_2nd_1,Lp_2nd_1,Valve_1,TempHi_1,TempLo_1,Busy_1,SV_1\n"


def log(path, rows, start=0, head=HEAD):
    lines = [f"{(start + i) // 3600:02d}:{(start + i) // 60 % 60:02d}:{(start + i) % 60:02d},Run,On,120,30,210,60,50,70,20,0,On" for i in range(rows)]
    path.write_text("some preamble\n" + head + "\n".join(lines) + "\n")


class Once(RuntimeError):
    pass


def test_files_are_scored_once(spark, tmp_path):
    """Over batches: a boundary, a bad file, a missing one, a crash between output and ledger, a repeat, and a file that has grown."""
    folder, notices = tmp_path / "logs", tmp_path / "notices"
    folder.mkdir()
    log(folder / "m_2026_01_01.csv", 600)
    ledger = files.FileLedger(spark, str(tmp_path / "store"))
    ledger.begin(files.notice(spark, str(folder), "MX1"))
    assert ledger.decisions() is None or ledger.decisions().count() == 0
    score = lambda long: files.file_windows(long, MonitorPolicy()).where("module_id = 1").select("machine_id", "module_id", "file", "window_start_s", "window_status")
    crash = []

    def sink(df, batch):
        real = ledger.commit
        if crash:
            ledger.commit = lambda *_: (_ for _ in ()).throw(Once("killed"))
        try:
            files.file_sink(ledger, score, (1, 2))(df, batch)
        finally:
            ledger.commit = real

    def run():
        source = spark.readStream.schema(files.NOTICES).json(str(notices))
        q = source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:
            if "killed" not in str(e):
                raise

    def notice():
        files.notice(spark, str(folder), "MX1").coalesce(1).write.mode("append").json(str(notices))

    log(folder / "m_2026_01_02.csv", 900)
    (folder / "m_2026_01_03.csv").write_text("no header at all\n")
    notice()
    spark.createDataFrame([("MX1", f"file:{folder}/m_2026_01_09.csv", 1, 1)], files.NOTICES).coalesce(1).write.mode("append").json(str(notices))
    crash.append(1)
    run()
    assert ledger.decisions() is None or ledger.decisions().count() == 0  # output is there, the ledger isn't
    crash.clear()
    run()
    seen = sorted((r.file[-8:], r.window_start_s % 86400) for r in ledger.decisions().collect())
    assert seen == [("1_02.csv", 0), ("1_02.csv", 300), ("1_02.csv", 600)]
    assert sorted(r.file[-8:] for r in ledger.errors().collect()) == ["1_03.csv", "1_09.csv"]
    assert [(r.rows, r.rejected, r.decisions) for r in ledger.current().where("status = 'processed'").collect()] == [(1800, 0, 3)]
    notice()  # the same versions again: nothing is scored anew
    run()
    assert ledger.decisions().count() == 3
    log(folder / "m_2026_01_02.csv", 1500)
    os.utime(folder / "m_2026_01_02.csv", (2e9, 2e9))
    notice()
    run()
    assert sorted(r.window_start_s % 86400 for r in ledger.decisions().collect()) == [0, 300, 600, 900, 1200]
    files.file_sink(ledger, score, (1, 2))(spark.read.schema(files.NOTICES).json(str(notices)), 2)  # a batch by hand, repeated
    files.file_sink(ledger, score, (1, 2))(spark.read.schema(files.NOTICES).json(str(notices)), 2)
    assert ledger.decisions().count() == 5 and not ledger.decisions().where("file like '%01_01%'").take(1)


def test_quoted_cells_and_rejected_lines(spark, tmp_path):
    (tmp_path / "q_2026_02_01.csv").write_text('Time,Status,"Hp_1st_1",Status_1\n10:00:00,"Run, slowly",145,"On ""hot"""\nnever,Run,1,On\n10:00:01,Run,"14,5",On\n')
    long, errors, rejected = logs.read_logs(spark, [str(tmp_path / "q_2026_02_01.csv")], "MX1", (1,), with_rejected=True)
    got = [(r.global_status, r.hp1, r.module_status) for r in long.orderBy("source_order").collect()]
    assert got[0] == ("Run, slowly", 145.0, 'On "hot"') and len(got) == 2 and errors.count() == 0
    assert [r.value for r in rejected.collect()] == ["never,Run,1,On"]


def test_source_order_over_splits(spark, tmp_path):
    rows = 4000
    log(tmp_path / "s_2026_03_01.csv", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        long, _ = logs.read_logs(spark, [str(tmp_path / "s_2026_03_01.csv")], "MX1", (1,))
        times = [r.timestamp for r in long.orderBy("source_order").collect()]
        assert long.select("source_order.block").distinct().count() > 5 and len(times) == rows and times == sorted(times)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_of_two_movers_one_wins(spark, tmp_path):
    one, other = (lifecycle.Lifecycle(spark, str(tmp_path / "events")) for _ in range(2))
    one.move("MX1", "COLLECTING_DATA", "start")
    at = other.state("MX1").seq
    one.move("MX1", "LEARNING", "enough", after=at)
    with pytest.raises(lifecycle.Conflict):
        other.move("MX1", "REJECTED", "too late", after=at)
    other.move("MX2", "COLLECTING_DATA", "another machine")
    assert one.state("MX1").state == "LEARNING" and [r.seq for r in one.events().where("machine_id = 'MX1'").orderBy("seq").collect()] == [0, 1]


def test_versions_and_roll_back(spark, tmp_path):
    v = validation.Versions(spark, str(tmp_path / "versions"))
    assert v.deployed().count() == 0
    assert (v.put("MX1", -1, "v1", "AUTO_APPROVED", [], 10), v.put("MX1", 0, "v2", "AUTO_APPROVED", ["ok"], 20), v.put("MX2", -1, "w1", "AUTO_APPROVED", [], 5)) == (0, 1, 0)
    with pytest.raises(validation.Conflict):
        v.put("MX1", 0, "v9", "AUTO_APPROVED", [], 30)
    tests = spark.createDataFrame([("MX1", "AUTO_ROLLED_BACK", ["bad"], "v1"), ("MX2", "CHAMPION_HEALTHY", ["fine"], None)], "machine_id string, outcome string, reasons array<string>, restored_version string")
    assert v.roll_back(tests, F.col("machine_id"), 40) == [("MX1", "v1")]
    assert {(r.group, r.number, r.version, r.outcome) for r in v.deployed().collect()} == {("MX1", 2, "v1", "AUTO_ROLLED_BACK"), ("MX2", 0, "w1", "AUTO_APPROVED")}


def test_a_failing_champion_falls_back(spark):
    """A champion that alerts on its own frozen rows, one that detects nothing, one that is healthy and one without a history."""
    eye = [[1.0, 0.0], [0.0, 1.0]]
    base = lambda m, limit, scale=1.0: (m, [0.0, 0.0], [1.0, 1.0], 2.0, [0.0, 0.0], [scale, scale], eye, 1.0, limit, limit, 0.01, 1.0)
    schema = "m string, golden_center array<double>, golden_scale array<double>, golden_deviation_threshold double, adaptive_center array<double>, adaptive_scale array<double>, adaptive_inverse array<array<double>>, adaptive_error_threshold double, adaptive_deviation_threshold double, adaptive_distance_threshold double, deployed_alert_rate double, deployed_detection double"
    champions = spark.createDataFrame([base("tight", 0.1), base("blind", 99.0), base("good", 3.0), base("alone", 0.1)], schema)
    frozen = spark.createDataFrame([(m, i, [0.5, -0.5 + 0.01 * i], 0.1) for m in ("tight", "blind", "good", "alone") for i in range(40)], "m string, i int, summary array<double>, error double")
    history = spark.createDataFrame([(m, f"{m}{i}", i) for m in ("tight", "blind", "good") for i in range(3)], "m string, version string, saved_at long")
    got = {r.m: (r.outcome, r.restored_version, r.reasons[0]) for r in validation.self_tests(champions, frozen, history, ["m"], "i").collect()}
    assert got == {"tight": ("AUTO_ROLLED_BACK", "tight2", "deployed_reference_alert_rate_failed"), "blind": ("AUTO_ROLLED_BACK", "blind2", "deployed_synthetic_detection_failed"), "good": ("CHAMPION_HEALTHY", None, "frozen_self_test_passed"), "alone": ("REVIEW_REQUIRED", None, "deployed_reference_alert_rate_failed")}


def test_stores(spark, tmp_path):
    windows = spark.createDataFrame([("MX1", 1, "train", [[1.0, 2.0]])], "machine_id string, module_id int, split string, seq array<array<double>>")
    stores.write_prepared(windows, str(tmp_path / "prepared"), ("a", "b"))
    assert stores.read_prepared(spark, str(tmp_path / "prepared"), ("a", "b")).count() == 1
    with pytest.raises(ValueError):
        stores.read_prepared(spark, str(tmp_path / "prepared"), ("b", "a"))
    decisions = spark.createDataFrame([("MX1", i, "NORMAL") for i in range(5)], "machine_id string, window_start_s long, review_level string")
    stores.append_decisions(decisions.where("window_start_s < 3"), str(tmp_path / "decisions"))
    stores.append_decisions(decisions.where("window_start_s >= 3"), str(tmp_path / "decisions"))
    last = stores.read_decisions(spark, str(tmp_path / "decisions"), "window_start_s long, review_level string, machine_id string", 2)
    assert sorted(r.window_start_s for r in last.collect()) == [3, 4]
    (tmp_path / "t.json").write_text('{"MX1_1": {"machine_id": "MX1", "module_id": "1", "percentile": 99, "value": 0.5}}')
    assert [tuple(r) for r in stores.read_thresholds(spark, str(tmp_path / "t.json")).collect()] == [("MX1_1", "MX1", "1", 99.0, 0.5)]
    again = upsert(decisions.withColumn("at", F.lit(1)), decisions.where("window_start_s < 2").withColumns({"review_level": F.lit("OLD"), "at": F.lit(0)}), ["machine_id", "window_start_s"], "at")
    assert again.count() == 5 and not again.where("review_level = 'OLD'").take(1)


def test_prepared_set(spark, tmp_path):
    from fleetvane.sources import prepared

    flags = spark.createDataFrame([("a", 1, True)] * 5 + [("a", 1, False)] * 2 + [("a", 2, None)] + [("b", 1, True)], "file string, module_id int, is_active boolean")
    windows = spark.createDataFrame([("MX1", 1, "train", "a", [[1.0]]), ("MX1", 1, "test", "a", [[2.0]])], "machine_id string, module_id int, split string, file string, seq array<array<double>>")
    files_ = spark.createDataFrame([("a",), ("b",), ("empty",), ("bad",)], "file string")
    audit = prepared.file_audit(flags, windows, files_, (1, 2), spark.createDataFrame([("a",), ("a",)], "file string"), spark.createDataFrame([("bad", "No tabular header found")], "file string, error string"))
    got = {(r.file, r.module_id): tuple(r)[2:] for r in audit.collect()}
    assert got[("a", 1)] == (7, 5, 2, 2, 2, None) and got[("a", 2)] == (1, 0, 1, 0, 2, None) and got[("empty", 2)] == (0, 0, 0, 0, 0, None) and got[("bad", 1)][5] and len(got) == 8
    config = {"window": 60}
    manifest = prepared.write_set(windows, audit, str(tmp_path / "set"), ("x",), config)
    w, a, again = prepared.read_set(spark, str(tmp_path / "set"), config)
    assert again == manifest and w.count() == 2 and a.count() == 8 and manifest["totals"] == {"raw_rows": 9, "accepted_rows": 6, "rejected_rows": 3, "windows": 2, "files": 4}
    with pytest.raises(ValueError):
        prepared.read_set(spark, str(tmp_path / "set"), {"window": 61})
    windows.limit(1).write.mode("append").partitionBy("machine_id", "module_id", "split").parquet(str(tmp_path / "set/windows"))
    with pytest.raises(ValueError):
        prepared.read_set(spark, str(tmp_path / "set"))
