"""The stream of windows against the batch operator, over batches and a restart."""

import tempfile

from pyspark.sql import functions as F

from fleetvane.config import GROUP, SPARSE
from fleetvane.operators import cycle
from fleetvane.plans.catalog import _windows
from fleetvane.plans.cycle_queries import given
from fleetvane.streaming.cycle import History, score_stream, use_rocksdb

COMPARED = [*GROUP, "window_start_s", "window_status", "regime", "reason_codes", "active", "persistent_s", "second_active", "second_s", "review_level", "trend", "score", "forest_score"]


def rows_of(df):
    rounded = {c: F.round(c, 9) for c in ("trend", "score", "forest_score")}
    return sorted(map(str, df.withColumns(rounded).withColumn("second_s", F.when(F.col("window_status") == "ELIGIBLE", F.col("second_s")).otherwise(0).cast("long")).select(*COMPARED).collect()))


def test_stream_equals_batch_over_restarts(spark):
    use_rocksdb(spark)
    base = tempfile.mkdtemp(prefix="stream-")
    w = _windows(spark, "/root/testdata/sf0.01").withColumn("part", F.ntile(3).over(cycle_order()))
    w.write.parquet(f"{base}/all")
    w = spark.read.parquet(f"{base}/all")
    profiles = given(w.drop("part"))
    for i, df in enumerate(profiles):
        df.write.parquet(f"{base}/profile{i}")
    modules, regimes, contexts, second = (spark.read.parquet(f"{base}/profile{i}") for i in range(4))
    want = cycle.score_windows(w.drop("part"), modules, regimes, contexts, second, SPARSE)
    assert want.where("active").count() > 10 and want.select("review_level").distinct().count() > 3
    for part in (1, 2, 3):
        w.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(w.drop("part").schema).parquet(f"{base}/in")
        out = score_stream(source, modules, regimes, contexts, second, SPARSE)
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.parquet(f"{base}/out")
    assert not got.where("late").take(1) and rows_of(got) == rows_of(want)


def cycle_order():
    from pyspark.sql import Window

    return Window.orderBy("window_start_s")


def test_history_rules():
    z = lambda lp2=0.0, hp2=0.0: {"z_hp2": hp2, "z_lp2": lp2, "z_gap": 0.0, "z_span": None}
    none = (None, None, None)
    h = History(SPARSE, [], {}, None, None, None)
    day = SPARSE.window_s
    assert h.evidence(0, z(hp2=4.0), none, False)[1:4] == (["HP2_ROBUST_Z"], True, day)
    assert h.evidence(day, z(hp2=3.0), none, True)[2:5] == (True, 2 * day, day)  # the latch holds between the two levels
    late = day + SPARSE.reset_s + 1
    assert h.evidence(int(late), z(hp2=3.0), none, True)[2:5] == (True, day, day)  # latches outlast a gap, runs don't
    assert h.evidence(int(late) + day, z(lp2=-3.2, hp2=1.0), (0.9, 0.8, 0.5), False)[:3] == (-3.2, ["LP2_DOWNWARD_TREND", "PRESSURE_PATTERN_ANOMALY"], True)
    assert len(h.hour) == 2 and h.second_began is None
