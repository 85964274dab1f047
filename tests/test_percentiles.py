"""Percentiles by refinement against the built-in ones."""

import random

import pytest
from pyspark.sql import functions as F

from fleetvane.operators import percentiles, robust

FRACTIONS = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 0.99, "f": 1.0}


def same(x, y):
    close = lambda a, b: a == b or (a is not None and b is not None and (a != a and b != b or abs(a - b) <= 1e-9 * max(1, abs(a))))
    x, y = (sorted(map(tuple, df.collect()), key=lambda r: str(r[:2])) for df in (x, y))
    return len(x) == len(y) and all(a[:2] == b[:2] and all(map(close, a[2:], b[2:])) for a, b in zip(x, y, strict=True))


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = [("one", None, rng.gauss(0, 1)) for _ in range(700)] + [("one", 2, rng.choice([1.0, 1.0, 2.0, 3.0])) for _ in range(400)]
    data += [(None, 1, rng.choice([1e308, -1e308, 1e-300, 0.0, -0.5])) for _ in range(300)] + [("inf", 1, rng.choice([float("inf"), float("-inf"), 4.0, float("nan")])) for _ in range(300)]
    data += [("equal", 1, 7.5)] * 300 + [("few", 1, float(i)) for i in range(9)] + [("none", 1, None)] * 300 + [("one", 2, None)] * 50 + [("skewed", 1, 1.0 + 2.0**-i) for i in range(50)] * 5
    return spark.createDataFrame(data, "g string, h int, x double").repartition(5)


@pytest.mark.parametrize("few,buckets", [(20, 4), (100, 1024), (10**6, 8)])
def test_percentiles(rows, monkeypatch, few, buckets):
    monkeypatch.setattr(percentiles, "BUCKETS", buckets)
    want = rows.groupBy("g", "h").agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in FRACTIONS.items()])
    assert same(percentiles.percentiles(rows, ["g", "h"], "x", FRACTIONS, few), want)


def test_no_task_holds_a_group(spark, monkeypatch):
    """Ranges of 2,000,000 different values are narrowed till few rows are left, and only these meet in a task."""
    monkeypatch.setattr(percentiles, "FEW", 5000)
    rows = spark.range(2_000_000).select(F.lit("g").alias("g"), (F.hash("id") / 7).alias("x"))
    wanted = spark.createDataFrame([("g", 1_000_000), ("g", 1_999_999), ("g", 0)], "g string, k long")
    found = percentiles.order_statistics(rows, ["g"], "x", wanted, 5000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: r.value for r in found.collect()}
    values = sorted(r.x for r in rows.select("x").collect())
    assert got == {k: values[k] for k in got} and len(got) == 3 and "percentile" not in plan


@pytest.mark.parametrize("few", [5, 10**6])
def test_robust_statistics_of_large_groups(spark, monkeypatch, few):
    rng = random.Random(1)
    df = spark.createDataFrame([(i % 3, rng.gauss(i % 3, 2), rng.random(), rng.choice(["validation", "test"])) for i in range(300)], "m int, a double, error double, split string")
    want = [df_.collect() for df_ in (robust.center_scale(df, ["m"], ["a", "error"]), robust.group_metrics(df, ["m"]), robust.group_thresholds(df, ["m"]))]
    monkeypatch.setattr(percentiles, "FEW", few)
    got = [df_.collect() for df_ in (robust.center_scale(df, ["m"], ["a", "error"]), robust.group_metrics(df, ["m"]), robust.group_thresholds(df, ["m"]))]
    flat = lambda tables: [[round(v, 9) if isinstance(v, float) else v for v in r] for t in tables for r in sorted(t)]
    assert flat(got) == flat(want)


def test_keys_of_large_groups_are_not_made_text(spark):
    """A pass over the rows neither writes keys as JSON nor leaves out the small groups by a join of its own; both ranks of a median share a range."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "g").alias("g"), (F.hash("id") / 7).alias("x"))
    found = percentiles.percentiles(rows, ["g"], "x", {"m": 0.5}, 100, also={"n": F.count("*")})
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "to_json" not in plan and "structstojson" not in plan and "leftanti" not in plan.replace(" ", "")
    want = rows.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    assert same(found, want)
