"""Runs, segments and places in source order over edges of spans, against windows over whole groups."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetvane.config import GROUP
from fleetvane.operators import sequences
from fleetvane.sources import telemetry


def test_spans_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sequences, "SPAN_S", 7)
    monkeypatch.setattr(telemetry, "RUN_LINES", 16)
    rng = random.Random(2)
    data, s = [], 0
    for i in range(600):
        s += rng.choice([0, 1, 1, 1, 2, 30])
        data.append(("a" if i % 3 else None, i % 2, s, i, rng.random() < 0.7))
    rows = spark.createDataFrame(data, "machine_id string, module_id int, s long, source_order long, is_active boolean").repartition(5)
    w = Window.partitionBy(*GROUP).orderBy("s", "source_order")
    before = F.lag("is_active").over(w)
    plain = rows.withColumn("_new", F.when(before.isNull() | (before != F.col("is_active")), 1).otherwise(0)).withColumn("since_s", F.col("s") - F.lag("s").over(w)).withColumn("run_id", F.sum("_new").over(w))
    got = sequences.active_runs(rows)
    names = [*GROUP, "s", "source_order", "run_id", "since_s"]
    table = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert table(got, names) == table(plain, names)

    one = rows.dropDuplicates([*GROUP, "s"])
    w = Window.partitionBy(*GROUP).orderBy("s")
    plain = one.withColumn("segment_break", F.coalesce(F.col("s") - F.lag("s").over(w) != 1, F.lit(True))).withColumn("segment_id", F.sum(F.col("segment_break").cast("int")).over(w))
    names = [*GROUP, "s", "segment_break", "segment_id"]
    found = sequences.segments(one)
    assert table(found, names) == table(plain, names)

    n = F.row_number().over(Window.partitionBy(*GROUP).orderBy("source_order")).cast("long") - 1
    plain = rows.withColumn("s", n + 3 * F.floor(n / 50) + 20 * F.floor(n / 400))
    assert table(telemetry.dense(rows), [*GROUP, "source_order", "s"]) == table(plain, [*GROUP, "source_order", "s"])

    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_span" in plan  # windows of rows end at a span's edge
