"""Robust and classical statistics per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.operators.percentiles import fits, percentiles, small_table
from fleetvane.shared import written

MAD = 1.4826


def center_scale(rows: DataFrame, by: list[str], columns: list[str], floor: float | None = None) -> DataFrame:
    """Per group and feature: median, and 1.4826 times the median absolute deviation.

    With floor that is the least scale. Without, a scale near 0 gives way to the population deviation, and that to 1.
    """
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select(*by, "c.feature", "c.x").where("x is not null and not isnan(x)")
    keys, far = [*by, "feature"], F.abs(F.col("x") - F.col("center"))
    if fits(rows, by):
        median = long.groupBy(*keys).agg(F.percentile("x", F.lit(0.5)).alias("center"), F.stddev_pop("x").alias("std"))
        mad = long.join(median, keys).groupBy(*keys).agg((MAD * F.percentile(far, F.lit(0.5))).alias("mad"), F.first("center").alias("center"), F.first("std").alias("std"))
    else:
        median = written(percentiles(long, keys, "x", {"center": 0.5}, also={"std": F.stddev_pop("x")}), "medians")
        held = small_table(median, median.count())
        mad = percentiles(long.join(held, keys).withColumn("far", far), keys, "far", {"mad": 0.5}).withColumn("mad", MAD * F.col("mad")).join(median, keys)
    scale = F.greatest("mad", F.lit(floor)) if floor is not None else F.when(F.col("mad") > 1e-8, F.col("mad")).when(F.col("std") > 1e-8, F.col("std")).otherwise(1.0)
    return mad.select(*keys, "center", scale.alias("scale"))


def standard_scaler(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation; one below 1e-8 counts as 1."""
    sigma = {c: F.stddev_pop(c) for c in columns}
    return rows.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.when(s < 1e-8, 1.0).otherwise(s).alias(f"scale_{c}") for c, s in sigma.items()])


def group_thresholds(errors: DataFrame, by: list[str], percentile: float = 0.99) -> DataFrame:
    return percentiles(errors, by, "error", {"threshold": percentile})


def group_metrics(errors: DataFrame, by: list[str]) -> DataFrame:
    """Validation p50 and p99 (the threshold), test p50 and p95 and the share of test errors above the threshold."""
    v, t = F.when(F.col("split") == "validation", F.col("error")), F.when(F.col("split") == "test", F.col("error"))
    wanted = {"validation": (v, {"validation_p50": 0.5, "validation_p99": 0.99}), "test": (t, {"test_p50": 0.5, "test_p95": 0.95})}
    if fits(errors, by):
        stats = errors.groupBy(*by).agg(*[F.percentile(c, F.lit(p)).alias(name) for c, ps in wanted.values() for name, p in ps.items()])
    else:
        one, other = (percentiles(errors.withColumn("_value", c), by, "_value", ps) for c, ps in wanted.values())
        stats = one.join(other, by)
    over = errors.where("split = 'test'").join(stats.select(*by, "validation_p99"), by).groupBy(*by).agg(F.avg((F.col("error") > F.col("validation_p99")).cast("double")).alias("test_exceedance"))
    return stats.join(over, by, "left")


def pearson(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Null with fewer than three complete pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return pairs.agg(F.count(F.when(both, 1)).alias("n"), F.when(F.count(F.when(both, 1)) >= 3, F.nanvl(F.corr(x, y), F.lit(None).cast("double"))).alias("r"))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a <= b, over the rows that have both; null with fewer than three pairs or without variance; rounded to 3 places."""
    cells = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            ok = (F.count(x) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(ok, F.round(F.corr(x, y), 3)).alias("r")))
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def balanced_weights(rows: DataFrame, by: list[str]) -> DataFrame:
    """weight: 1 / size of the row's group, scaled to a mean of 1."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    groups, total = sizes.count(), rows.count()
    return rows.join(sizes, by).withColumn("weight", F.lit(float(total)) / F.lit(float(max(groups, 1))) / F.col("_n")).drop("_n")


def standardised(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*by)
    sigma = F.stddev_pop(column).over(w)
    return rows.withColumn("z", (F.col(column) - F.avg(column).over(w)) / F.when(sigma > 0, sigma).otherwise(1.0))
