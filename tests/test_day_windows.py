"""Event-time windows by days and runs of source order against one sort of each history."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetvane.config import GROUP, MonitorPolicy
from fleetvane.functions.scalar import token
from fleetvane.operators import windows


def whole(long, policy):
    """The same columns by windows over whole histories."""
    by_source, by_time = Window.partitionBy(*GROUP).orderBy("source_order"), Window.partitionBy(*GROUP).orderBy("us", "source_order")
    t = F.coalesce(token(F.col("module_status")).isin(*policy.transition_tokens), F.lit(False)) | F.coalesce(F.col("busy") == 1, F.lit(False))
    rows = long.withColumn("out_of_order", F.coalesce(F.col("us") < F.lag("us").over(by_source), F.lit(False))).withColumn("transition", t)
    since = (F.col("us") - F.last(F.when(F.col("transition"), F.col("us")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))) / 1_000_000
    rows = rows.withColumn("settling", F.coalesce((since >= 0) & (since < policy.settling_s), F.lit(False))).withColumn("previous_us", F.lag("us").over(by_time))
    return rows.withColumn("repeated", F.coalesce((F.col("us") == F.lag("us").over(by_time)) | (F.col("us") == F.lead("us").over(by_time)), F.lit(False)))


@pytest.fixture
def rows(spark):
    rng, data = random.Random(2), []
    for machine in ("A", "B", None):
        t = 0
        for i in range(1500):
            t += rng.choice([1, 5, 60, 600, 20_000, 0])
            us = (t - rng.choice([0, 0, 0, 0, 90_000])) * 1_000_000
            data.append((machine, i % 2, i * 7, us, rng.choice(["On", "On", "On", "ChangeValve"]), float(rng.random() < 0.02)))
    return spark.createDataFrame(data, "machine_id string, module_id int, source_order long, us long, module_status string, busy double").repartition(4)


@pytest.mark.parametrize("lines", [16, 1 << 16])
@pytest.mark.parametrize("nested", [False, True])
def test_carries(rows, monkeypatch, lines, nested):
    monkeypatch.setattr(windows, "BUCKET_LINES", lines)
    policy = MonitorPolicy(settling_s=50_000.0)
    if nested:
        rows = rows.withColumn("source_order", F.struct(F.floor(F.col("source_order") / 3000).alias("block"), F.col("source_order").alias("line")))
    columns = ["machine_id", "module_id", F.col("source_order").cast("string").alias("source_order"), "us", "out_of_order", "transition", "settling", "previous_us", "repeated"]
    got, want = (sorted(map(str, df.select(*columns).collect())) for df in (windows.prepared(rows, policy), whole(rows, policy)))
    assert got == want and any("out_of_order=True" in r for r in got) and any("settling=False" in r for r in got)


def test_no_window_over_whole_histories(rows):
    """Rows are only sorted by machine, module and day or run; windows by machine and module alone see one row a day or run."""
    plan = windows.prepared(rows)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "source_order" in line.split("windowspecdefinition", 1)[1]:
            assert "_run" in line or "_day" in line
