"""Rows at one a second: gates, runs, gap filling, segments, features and sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.config import GROUP, PRESSURES, SENSORS, TEMPERATURES, SequencePolicy
from fleetvane.functions.scalar import ratio
from fleetvane.operators.percentiles import small_table
from fleetvane.operators.windows import with_carries
from fleetvane.shared import written

#: Seconds of a machine and module that are sorted together.
SPAN_S = 1 << 15


def row_flags(rows: DataFrame, policy: SequencePolicy = SequencePolicy()) -> DataFrame:
    """The row's flags and is_active. A null valve isn't homing; a null pressure or temperature is invalid."""
    f = F.lit(False)
    valid_p = valid_t = F.lit(True)
    for c in PRESSURES:
        valid_p = valid_p & F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1000), f)
    for c in TEMPERATURES:
        valid_t = valid_t & F.coalesce((F.col(c) > -150) & (F.col(c) < 250), f)
    status = F.col("module_status")
    out = rows.withColumns({
        "is_excluded": F.col("module_id").isin(*policy.excluded_modules),
        "is_transition": F.coalesce(status.isin(*policy.transition_states), f) | F.coalesce(F.col("busy") == 1, f),
        "is_homing": F.coalesce(status == "MValveHome", f) | F.coalesce(F.col("valve") < 0, f),
        "is_sentinel": F.coalesce(F.col("templo") == -200, f) | F.coalesce(F.col("temphi") == -200, f),
        "is_invalid_pressure": ~valid_p,
        "is_invalid_temperature": ~valid_t,
    })
    bad = F.col("is_excluded") | F.col("is_transition") | F.col("is_homing") | F.col("is_sentinel") | F.col("is_invalid_pressure") | F.col("is_invalid_temperature")
    return out.withColumn("is_active", F.coalesce(status == policy.normal_status, f) & F.coalesce(F.col("busy") == 0, f) & ~bad)


def islands(rows: DataFrame, order: list[str], kept: list[str], new: Callable[[Column, Column], Column], number: str) -> DataFrame:
    """rows with _before, a struct of kept of the row before (null at the first), and number: how many rows up to this one are new.

    new: of the structs of a row and of the one before; null counts as new. Rows are sorted within a machine and module's
    span of SPAN_S seconds; the last row before a span and the count so far are carried by one small row each.
    """
    w = Window.partitionBy(*GROUP, "_span").orderBy(*order)
    at, here = F.struct(*order), F.struct(*kept)
    change = lambda now, before: F.coalesce(new(now, before).cast("int"), F.lit(1))
    inner = rows.withColumn("_span", F.floor(F.col("s") / SPAN_S)).withColumn("_before", F.lag(here).over(w))
    inner = inner.withColumn("_new", F.when(F.col("_before").isNotNull(), change(here, F.col("_before"))).otherwise(0))
    spans = inner.groupBy(*GROUP, "_span").agg(F.sum("_new").alias("_news"), F.min_by(here, at).alias("_first"), F.max_by(here, at).alias("_last"))
    in_order = Window.partitionBy(*GROUP).orderBy("_span")
    spans = spans.withColumn("_carried", F.lag("_last").over(in_order))
    first = F.when(F.col("_carried").isNull(), 1).otherwise(change(F.col("_first"), F.col("_carried")))
    spans = spans.withColumn("_so_far", F.sum(F.col("_news") + first).over(in_order) - F.col("_news"))
    spans = written(spans.select(*GROUP, "_span", "_carried", "_so_far"), "spans")
    out = with_carries(inner.withColumn(number, F.sum("_new").over(w)), small_table(spans, spans.count()), "_span")
    return out.withColumns({number: F.col(number) + F.col("_so_far"), "_before": F.coalesce("_before", "_carried")}).drop("_span", "_new", "_carried", "_so_far")


def active_runs(flagged: DataFrame) -> DataFrame:
    """run_id: islands of equal is_active per machine and module; seconds since the row before and whether the time is repeated."""
    changed = lambda now, before: before["is_active"].isNull() | F.coalesce(before["is_active"] != now["is_active"], F.lit(False))
    out = islands(flagged, ["s", "source_order"], ["s", "is_active"], changed, "run_id")
    return out.withColumn("since_s", F.col("s") - F.col("_before.s")).withColumn("is_repeated", F.count("*").over(Window.partitionBy(*GROUP, "s")) > 1).drop("_before")


def fill_short_gaps(runs: DataFrame, policy: SequencePolicy = SequencePolicy()) -> DataFrame:
    """Active rows on a grid of seconds; the first max_gap missing seconds of each gap are interpolated, also of a longer one.

    Of rows of the same second the last in source order stays. An active row may lack its valve only; that is interpolated
    like a gap of its own, and a row that it can't be told for is left out. Other columns come from the row before.
    """
    w = Window.partitionBy(*GROUP, "run_id").orderBy("s")
    back = Window.partitionBy(*GROUP, "run_id").orderBy(F.col("s").desc())
    last = F.row_number().over(Window.partitionBy(*GROUP, "run_id", "s").orderBy(F.col("source_order").desc()))
    others = [c for c in SENSORS if c != "valve"]
    one = runs.where("is_active").withColumn("_last", last).where("_last = 1").drop("_last").dropna(subset=others)
    told = F.when(F.col("valve").isNotNull(), F.struct("s", "valve"))
    one = one.withColumn("_next", F.lead("s").over(w)).withColumn("_before", F.last(told, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = one.withColumn("_after", F.last(told, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    for c in others:
        one = one.withColumn(f"_{c}", F.lead(c).over(w))
    gap = F.coalesce(F.col("_next") - F.col("s"), F.lit(1))
    filled = one.withColumn("_gap", gap).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_gap") - 1, F.lit(policy.max_gap).cast("long")))))
    at, now = F.col("_k") / F.col("_gap"), F.col("s") + F.col("_k")
    values = {c: F.when(F.col("_k") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * at) for c in others}
    since, span = now - F.col("_before.s"), F.col("_after.s") - F.col("_before.s")
    valve = F.when((F.col("_k") == 0) & F.col("valve").isNotNull(), F.col("valve")).when((since <= policy.max_gap) & F.col("_after").isNotNull(), F.col("_before.valve") + (F.col("_after.valve") - F.col("_before.valve")) * (since / span))
    imputed = (F.col("_k") > 0) | F.col("valve").isNull()
    return filled.withColumns({**values, "valve": valve, "s": now, "is_imputed": imputed}).where("valve is not null").drop("_next", "_gap", "_k", "_before", "_after", *[f"_{c}" for c in others])


def segments(filled: DataFrame) -> DataFrame:
    """segment_id: rows in unbroken seconds per machine and module."""
    out = islands(written(filled, "filled"), ["s"], ["s"], lambda now, before: now["s"] - before["s"] != 1, "segment_id")
    return out.withColumn("segment_break", F.coalesce(F.col("s") - F.col("_before.s") != 1, F.lit(True))).drop("_before")


DELTAS = ("hp1", "lp1", "hp2", "lp2", "valve")
ROLLED = ("hp1", "hp2", "lp2", "templo")


def features(segmented: DataFrame, policy: SequencePolicy = SequencePolicy()) -> DataFrame:
    """Gaps, ratios, differences and rolling statistics within a segment. The rolling mean needs a full window; the deviation is 0 before."""
    w = Window.partitionBy(*GROUP, "segment_id").orderBy("s")
    roll = w.rowsBetween(1 - policy.window, 0)
    full = F.count("*").over(roll) == policy.window
    out = segmented.withColumns({
        "gap1": F.col("hp1") - F.col("lp1"), "gap2": F.col("hp2") - F.col("lp2"), "ratio1": ratio(F.col("hp1"), F.col("lp1")), "ratio2": ratio(F.col("hp2"), F.col("lp2")),
        **{f"d_{c}": F.col(c) - F.lag(c).over(w) for c in DELTAS},
        **{f"mean_{c}": F.when(full, F.avg(c).over(roll)) for c in ROLLED},
        **{f"std_{c}": F.coalesce(F.when(full, F.stddev_pop(c).over(roll)), F.lit(0.0)) for c in ROLLED},
    })
    return out.withColumn("row_in_segment", F.row_number().over(w))


MODEL_FEATURES = (*SENSORS, "gap1", "gap2", "ratio1", "ratio2", *[f"d_{c}" for c in DELTAS], *[f"mean_{c}" for c in ROLLED], *[f"std_{c}" for c in ROLLED])


def sliding_windows(featured: DataFrame, policy: SequencePolicy = SequencePolicy(), columns: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """Windows of `window` rows every `step` rows of a segment, all of whose values are there: (group, segment_id, start_s, end_s, seq)."""
    values = F.array(*[F.col(c).cast("float") for c in columns])
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    # A row is put into one block of `step` rows; a window is blocks in a row, so a row's values are held window / step times and not `window` times.
    block = next(n for n in range(policy.step, 0, -1) if policy.window % n == 0 and policy.step % n == 0)
    blocks = featured.groupBy(*GROUP, "segment_id", F.floor((F.col("row_in_segment") - 1) / block).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("s", values.alias("x")))).alias("_rows"), F.count(F.when(whole, 1)).alias("_n"), F.min("s").alias("start_s"), F.max("s").alias("_end"))
    w = Window.partitionBy(*GROUP, "segment_id").orderBy("_block").rowsBetween(0, policy.window // block - 1)
    out = blocks.withColumns({"_whole": F.sum("_n").over(w), "end_s": F.max("_end").over(w), "_seq": F.collect_list("_rows").over(w)})
    chosen = out.where((F.col("_whole") == policy.window) & (F.col("_block") % (policy.step // block) == 0))
    return chosen.select(*GROUP, "segment_id", "start_s", "end_s", F.transform(F.flatten("_seq"), lambda r: r["x"]).alias("seq"))


def window_summaries(windows: DataFrame) -> DataFrame:
    """windows with summary, each feature's median over time; null if a value of seq isn't finite."""
    features = F.sequence(F.lit(0), F.size(F.col("seq")[0]) - 1)
    half = lambda v: (v[F.floor((F.size(v) - 1) / 2).cast("int")] + v[F.floor(F.size(v) / 2).cast("int")]) / 2
    median = F.transform(features, lambda j: half(F.array_sort(F.transform("seq", lambda r: r[j].cast("double")))))
    finite = F.forall(F.flatten("seq"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return windows.withColumn("summary", F.when(finite, median))


def split(windows: DataFrame, order: str = "start_s", least: int = 10) -> DataFrame:
    """train, validation and test in time order, 70/15/15; groups with fewer than `least` rows are left out."""
    by = Window.partitionBy(*GROUP)
    n = F.count("*").over(by)
    i = F.row_number().over(by.orderBy(order))
    counted = windows.withColumn("_n", n).withColumn("_i", i).where(F.col("_n") >= least)
    train = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(0.70)))
    valid = F.greatest(train + 1, F.floor(F.col("_n") * F.lit(0.85)))
    return counted.withColumn("split", F.when(F.col("_i") <= train, "train").when(F.col("_i") <= valid, "validation").otherwise("test")).drop("_n", "_i")


def even_take(rows: DataFrame, limit: int, by: tuple[str, ...], order: str) -> DataFrame:
    """Up to `limit` rows of each group, evenly spread, first and last among them."""
    w = Window.partitionBy(*by)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    step = (F.col("_n") - 1) / F.lit(float(max(limit - 1, 1)))
    # Row i is taken if some k has floor(k * step) = i: k is i / step rounded up, or one beside it.
    near = F.ceil(F.col("_i") / step)
    hit = F.lit(False)
    for k in (near - 1, near, near + 1):
        hit = hit | ((k >= 0) & (k < limit) & (F.floor(k * step) == F.col("_i")))
    return numbered.where((F.col("_n") <= limit) | hit).drop("_i", "_n")


def smoothed_health(scored: DataFrame, health: str = "health", policy: SequencePolicy = SequencePolicy()) -> DataFrame:
    w = Window.partitionBy(*GROUP, "segment_id").orderBy("start_s").rowsBetween(1 - policy.smoothing, 0)
    return scored.withColumn("smooth_health", F.avg(health).over(w))
