"""Telemetry from the benchmark's events, as a stand-in for machine logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetvane.operators.percentiles import small_table
from fleetvane.operators.windows import with_carries
from fleetvane.shared import written

#: Places of source order that are sorted together.
RUN_LINES = 1 << 18

MODULES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(events: DataFrame) -> DataFrame:
    """One row per event in the canonical long form; us is event time in microseconds since 1970, whatever the session's zone."""
    k = F.get_json_object("props", "$.k").cast("int")
    module = F.coalesce(*[F.when(F.col("event_type") == name, F.lit(i)) for name, i in MODULES.items()])
    e = events.select("event_id", "user_id", "value", k.alias("k"), module.alias("module_id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("us"))
    hp2 = 180 + F.col("value") / 5 + F.col("k") * 0.1
    i = F.col("event_id")
    return e.select(
        i.alias("source_order"), "us", F.concat(F.lit("MX"), F.lpad((F.col("user_id") % 3).cast("string"), 3, "0")).alias("machine_id"), "module_id",
        F.lit("Run").alias("global_status"), F.when(i % 101 == 0, "ChangeValve").otherwise("On").alias("module_status"), F.when(i % 103 == 0, 1.0).otherwise(0.0).alias("busy"), F.when(F.col("k") % 2 == 0, "On").otherwise("Off").alias("sv"),
        (120 + i % 11).cast("double").alias("hp1"), (28 + i % 5).cast("double").alias("lp1"), hp2.alias("hp2"), (10 + 0.18 * hp2 + 0.05 * F.col("k") + (i % 7) * 0.1).alias("lp2"),
        F.col("k").cast("double").alias("valve"), (70 + F.col("k") % 10).cast("double").alias("temphi"), F.when(i % 211 == 0, -200.0).otherwise((20 - i % 6).cast("double")).alias("templo"),
    )


def dense(long: DataFrame) -> DataFrame:
    """The same at one row a second (s), with gaps of 3 seconds after each 50 rows and of 20 after each 400, in source order."""
    runs = long.withColumn("_run", F.floor(F.col("source_order") / RUN_LINES))
    before = Window.partitionBy("machine_id", "module_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    earlier = runs.groupBy("machine_id", "module_id", "_run").agg(F.count("*").alias("_rows")).withColumn("_earlier", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    place = F.row_number().over(Window.partitionBy("machine_id", "module_id", "_run").orderBy("source_order")).cast("long") - 1
    earlier = written(earlier, "earlier")  # a small row per machine, module and run of source order
    placed = with_carries(runs.withColumn("_place", place), small_table(earlier, earlier.count()), "_run")
    n = F.col("_earlier") + F.col("_place")
    return placed.withColumn("s", n + 3 * F.floor(n / 50) + 20 * F.floor(n / 400)).drop("_run", "_place", "_earlier")


#: The same two views in SQL.
SQL = """
ev AS (SELECT event_id AS i, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, epoch_us(ts) AS us FROM events),
e2 AS (SELECT *, 180 + value / 5 + k * 0.1::DOUBLE AS hp2_ FROM ev),
tel AS (SELECT i AS source_order, us, 'MX' || lpad(CAST(user_id % 3 AS VARCHAR), 3, '0') AS machine_id,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS module_id, 'Run' AS global_status,
  CASE WHEN i % 101 = 0 THEN 'ChangeValve' ELSE 'On' END AS module_status, CASE WHEN i % 103 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS busy, CASE WHEN k % 2 = 0 THEN 'On' ELSE 'Off' END AS sv,
  CAST(120 + i % 11 AS DOUBLE) AS hp1, CAST(28 + i % 5 AS DOUBLE) AS lp1, hp2_ AS hp2, 10 + 0.18::DOUBLE * hp2_ + 0.05::DOUBLE * k + (i % 7) * 0.1::DOUBLE AS lp2,
  CAST(k AS DOUBLE) AS valve, CAST(70 + k % 10 AS DOUBLE) AS temphi, CASE WHEN i % 211 = 0 THEN -200.0::DOUBLE ELSE CAST(20 - i % 6 AS DOUBLE) END AS templo FROM e2),
num AS (SELECT *, row_number() OVER (PARTITION BY machine_id, module_id ORDER BY source_order) - 1 AS n0 FROM tel),
den AS (SELECT *, n0 + 3 * (n0 // 50) + 20 * (n0 // 400) AS s FROM num)
"""
