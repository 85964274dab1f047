"""Exact percentiles of groups of any size, by range histograms that are counted, narrowed and counted again.

A group's percentile needs one or two of its order statistics. Each of them is kept as a range of values and how many rows
lie below it. A turn cuts every range into buckets, counts them where the rows lie, and goes on with the bucket that holds
the wanted row, with that bucket's own least and largest value. A range ends when it holds one value or few rows; only
those few are sorted. So no task ever holds a group: what meets in one is a row per bucket and task that counted it.

Groups that have few rows to begin with take the built-in percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.shared import written

#: Rows of a group, or of a range, that one task may sort. The built-in percentile holds a group's values as objects, which is slow beyond.
FEW = 200_000
BUCKETS = 1024
#: Groups up to which the table of their ranges is broadcast; beyond, it is joined by shuffle, and AQE splits large groups.
MOST_BROADCAST_GROUPS = 50_000
INF = float("inf")


def _bucket(x: Column, lo: Column, hi: Column, buckets: Column) -> Column:
    """The bucket, of so many, of x in [lo, hi], in the order of values; infinities and NaN, which is largest, have buckets of their own."""
    share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    inside = F.when(hi > lo, F.least(buckets - 1, F.floor(share * buckets).cast("int"))).otherwise(0)
    return F.when(F.isnan(x), buckets + 1).when(x == INF, buckets).when(x == -INF, -1).otherwise(F.greatest(F.lit(0), inside))


def small_table(df: DataFrame, n: int) -> DataFrame:
    """df of n rows, to be broadcast unless that is too many."""
    return F.broadcast(df) if n <= MOST_BROADCAST_GROUPS else df


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def order_statistics(rows: DataFrame, by: list[str], column: str, wanted: DataFrame, few: int = FEW, ends: DataFrame | None = None) -> DataFrame:
    """(by..., k, value): the k-th least value, from 0, of each group's non-null values. wanted: (by..., k), each once, k within the group; no nulls in by.

    ends: (by..., _n, _lo, _hi), if they are known: how many values a group has, and bounds of the finite ones. Places that
    lie in one range are counted and sorted together.
    """
    x = F.col("_x")
    values = rows.select(*by, F.col(column).cast("double").alias("_x")).where("_x is not null")
    ends = values.groupBy(*by).agg(*_ends(x)) if ends is None else ends
    ranges = wanted.join(ends, by).select(*by, "k", F.lit(0).cast("long").alias("_before"), "_n", F.coalesce("_lo", F.lit(0.0)).alias("_lo"), F.coalesce("_hi", F.lit(0.0)).alias("_hi"), F.lit(True).alias("_whole"))
    fields = [*by, "_before", "_n", "_lo", "_hi", "_whole"]
    done = None
    inside = F.col("_whole") | ((x >= F.col("_lo")) & (x <= F.col("_hi")))
    while True:
        ranges = written(ranges, "ranges")  # a row per wanted place
        n = ranges.count()
        ended = ranges.where("not _whole and _lo = _hi").select(*by, "k", F.col("_lo").alias("value"))
        done = ended if done is None else done.union(ended)
        open_ = ranges.where("_whole or _lo <> _hi")
        if not open_.where(F.col("_n") > few).take(1):
            break
        large = open_.where(F.col("_n") > few).groupBy(*fields).agg(F.collect_list("k").alias("_ks"))
        # As many buckets as leave few rows in most of them.
        buckets = F.least(F.lit(BUCKETS), F.greatest(F.lit(16), F.ceil(16 * F.col("_n") / few))).cast("int")
        counted = values.join(small_table(large.drop("_ks"), n), by).where(inside).groupBy(*fields, _bucket(x, F.col("_lo"), F.col("_hi"), buckets).alias("_b")).agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        so_far = F.col("_before") + F.sum("_c").over(Window.partitionBy(*fields).orderBy("_b"))
        at = counted.withColumn("_so_far", so_far).join(small_table(large, n), fields).withColumn("k", F.explode(F.filter("_ks", lambda k: (F.col("_so_far") > k) & (F.col("_so_far") - F.col("_c") <= k))))
        narrowed = at.select(*by, "k", (F.col("_so_far") - F.col("_c")).alias("_before"), F.col("_c").alias("_n"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.lit(False).alias("_whole"))
        ranges = narrowed.unionByName(open_.where(F.col("_n") <= few))
    spans = open_.groupBy(*fields).agg(F.collect_list("k").alias("_ks"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*fields).orderBy("_x")) - 1
    sorted_ = values.join(small_table(spans.drop("_ks"), n), by).where(inside).withColumn("_place", place)
    sorted_ = sorted_.join(small_table(spans, n), fields).where(F.array_contains("_ks", F.col("_place"))).select(*by, F.col("_place").alias("k"), F.col("_x").alias("value"))
    return done.union(sorted_)


def _ends(x: Column) -> list[Column]:
    return [F.count(x).alias("_n"), F.min(F.when(_finite(x), x)).alias("_lo"), F.max(F.when(_finite(x), x)).alias("_hi")]


def fits(rows: DataFrame, by: list[str], few: int | None = None) -> bool:
    """Whether no group has more rows than one task may sort."""
    return not rows.groupBy(*by).count().where(F.col("count") > (FEW if few is None else few)).take(1)


def percentiles(rows: DataFrame, by: list[str], column: str, fractions: dict[str, float], few: int | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """(by..., a column per name in fractions and in also), as the built-in exact percentile gives them, interpolated.

    Nulls in column don't count; a group without values has null percentiles. NaN is the largest value. also: aggregates
    of the group's rows, taken in the pass that learns the sizes.
    """
    few = FEW if few is None else few
    also = also or {}
    built_in = [F.percentile(column, F.lit(p)).alias(name) for name, p in fractions.items()]
    # A struct tells null from every value, so that groups can be joined.
    key = F.struct(*by).alias("_key")
    x = F.col(column).cast("double")
    sizes = written(rows.groupBy(*by).agg(*_ends(x), *[c.alias(name) for name, c in also.items()]).select(key, "_n", "_lo", "_hi", *also), "sizes")
    groups, n = sizes.count(), sizes.where(F.col("_n") > few).count()
    more = [F.first(name).alias(name) for name in also]
    if not n:
        few_rows = rows.groupBy(*by).agg(*built_in)
        return few_rows if not also else few_rows.withColumn("_key", key).join(small_table(sizes.select("_key", *also), groups), "_key").select(*by, *fractions, *also)
    large = sizes.where(F.col("_n") > few)
    marked = rows.select(key, x.alias("_value"))
    at = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in fractions.items()}
    wanted = large.select("_key", F.explode(F.array_distinct(F.array(*[f(position).cast("long") for position in at.values() for f in (F.floor, F.ceil)]))).alias("k"))
    found = order_statistics(marked, ["_key"], "_value", wanted, few, large.select("_key", "_n", "_lo", "_hi"))
    values = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("_at")).join(large, "_key")

    def of(position: Column) -> Column:
        low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - position) * a + (position - low) * b)

    out = values.select(*[F.col("_key")[b].alias(b) for b in by], *[of(position).alias(name) for name, position in at.items()], *also)
    if n == groups:
        return out
    small = marked.join(small_table(sizes.where(F.col("_n") <= few).select("_key", *also), groups - n), "_key").groupBy("_key").agg(*[F.percentile("_value", F.lit(p)).alias(name) for name, p in fractions.items()], *more)
    return small.select(*[F.col("_key")[b].alias(b) for b in by], *fractions, *also).unionByName(out)
