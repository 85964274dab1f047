"""Queries of a monitor: fleet, machine, comparison, alignment and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def tail(rows: DataFrame, order: str, n: int = 576) -> DataFrame:
    return rows.orderBy(F.col(order).desc()).limit(n)


def aligned(a: DataFrame, b: DataFrame, on: list[str], value: str, how: str = "inner") -> DataFrame:
    """Two series by equal time; a full join keeps the times of either."""
    x, y = a.select(*on, F.col(value).alias("a")), b.select(*on, F.col(value).alias("b"))
    return x.join(y, on, how)


def overlay(signal: DataFrame, model: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Both by time; where both have a value the model's is taken."""
    j = signal.alias("s").join(model.alias("m"), on, "full_outer")
    return j.select(*on, *[F.coalesce(F.col(f"m.{c}"), F.col(f"s.{c}")).alias(c) for c in columns])


def as_of(rows: DataFrame, events: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Each row with the last event of its group at or before it, by one union and one window; of events at one time, the largest value's."""
    names = [c for c in rows.columns if c not in (*by, time)]
    both = rows.withColumn("_is", F.lit(1)).withColumn(value, F.lit(None).cast(events.schema[value].dataType)).unionByName(events.select(*by, time, value).withColumn("_is", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_is", value).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_is = 1").select(*by, time, *names, value)


def pending(files: DataFrame, registry: DataFrame, limit: int | None = None, newest: bool = True) -> DataFrame:
    """Files that aren't registered with their present signature; the newest or the oldest `limit` of them."""
    new = files.join(registry.select("path", "signature"), ["path", "signature"], "left_anti")
    return new.orderBy(F.col("path").desc() if newest else F.col("path")).limit(limit) if limit else new


def signature(files: DataFrame) -> DataFrame:
    return files.withColumn("signature", F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modified").cast("string")), 256))


def fleet(machines: DataFrame, states: DataFrame, decisions: DataFrame) -> DataFrame:
    """Machines with their lifecycle state and their latest decision; machines without either stay."""
    last = latest(decisions, ["machine_id"], "window_start_s")
    return machines.join(states, "machine_id", "left").join(last, "machine_id", "left")


def runtime_status(champions: DataFrame, candidates: DataFrame, buffers: DataFrame, by: list[str]) -> DataFrame:
    """Every champion with its group's candidate, if there is one, and how full its buffer is. buffers: rows with total_seen, as of bounded_buffer."""
    held = buffers.groupBy(*by).agg(F.count("*").alias("buffer_windows"), F.max("total_seen").alias("total_seen"))
    return champions.join(candidates, by, "left").join(held, by, "left").fillna(0, ["buffer_windows", "total_seen"])


def compare(series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Two to six series pivoted by time. series: key, time, value."""
    if not 2 <= len(keys) <= 6 or len(set(keys)) < len(keys):
        raise ValueError("two to six different series are compared")
    return series.where(F.col("key").isin(*keys)).groupBy(time).pivot("key", keys).agg(F.first(value))
