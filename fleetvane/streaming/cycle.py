"""The scoring cycle on a stream of windows: look-ups against static profiles, then evidence as keyed state.

Each (machine, module, mode, regime) has a list of the last hour's residuals, a map of latches and the beginnings of its
runs, in a RocksDB store, so a key's history never has to fit in memory at once and outlives a restart. Windows of a key
have to come in the order of their beginnings over batches; inside a batch they are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from fleetvane.config import MonitorPolicy
from fleetvane.operators.cycle import KEY, VECTOR, decided, look_up, scores, with_second
from fleetvane.operators.forests import Forest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEVELS = {"hp2": ("z_hp2", "HP2_ROBUST_Z"), "gap": ("z_gap", "PRESSURE_GAP_ANOMALY"), "span": ("z_span", "TEMPERATURE_SPAN_ANOMALY")}
EVIDENCE = [
    StructField("trend", DoubleType()), StructField("reason_codes", ArrayType(StringType())), StructField("active", BooleanType()), StructField("persistent_s", LongType()),
    StructField("second_s", LongType()), StructField("score", DoubleType()), StructField("late", BooleanType()),
]


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, which these operators need; to be set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class History:
    """A key's state while its windows of one batch are worked on; the same rules as the batch operator's window functions."""

    def __init__(self, policy: MonitorPolicy, hour: list[tuple[int, float | None]], latches: dict[str, bool], last: int | None, began: int | None, second_began: int | None):
        self.policy, self.hour, self.latches, self.last, self.began, self.second_began = policy, hour, latches, last, began, second_began

    def latch(self, name: str, on: bool, off: bool) -> bool:
        if on or off:
            self.latches[name] = on
        return self.latches.get(name, False)

    def _far(self, name: str, x: float | None, on: float, off: float) -> bool:
        return self.latch(name, x is not None and abs(x) >= on, x is not None and abs(x) < off)

    def evidence(self, t: int, z: dict[str, float | None], forest: tuple[float | None, ...], second: bool) -> tuple[Any, ...]:
        """trend, reason_codes, active, persistent_s, second_s, score of the next window."""
        p = self.policy
        if self.last is not None and t - self.last > p.reset_s:
            self.hour, self.began, self.second_began = [], None, None
            self.latches["trend"] = False
        self.last = t
        codes = [code for name, (column, code) in LEVELS.items() if self._far(name, z[column], p.entry_z, p.exit_z)]
        lp2 = z["z_lp2"]
        if self.latch("lp2", lp2 is not None and lp2 <= -p.entry_z, lp2 is not None and lp2 > -p.exit_z):
            codes.append("LP2_NEGATIVE_RESIDUAL")
        self.hour = [x for x in self.hour if x[0] >= t - int(p.trend_s)] + [(t, lp2)]
        first = self.hour[0][1]
        trend = None if lp2 is None or first is None else lp2 - first
        if self.latch("trend", trend is not None and trend <= p.trend_entry, trend is not None and abs(trend) < p.trend_exit):
            codes.append("LP2_DOWNWARD_TREND")
        score, entry, leave = forest
        if self.latch("forest", None not in (score, entry) and score >= entry, None not in (score, leave) and score < leave):
            codes.append("PRESSURE_PATTERN_ANOMALY")
        self.began = (t if self.began is None else self.began) if codes else None
        self.second_began = (t if self.second_began is None else self.second_began) if second else None
        seconds = [0 if b is None else t - b + p.window_s for b in (self.began, self.second_began)]
        return trend, sorted(codes), bool(codes), *seconds, max((abs(v) for v in z.values() if v is not None), default=None)


def _number(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) else x


def named(r: Row, evidence: tuple[Any, ...]) -> Row:
    return Row(**r.asDict(True), **dict(zip((f.name for f in EVIDENCE), evidence, strict=True)))


class EvidenceProcessor(StatefulProcessor):
    def __init__(self, policy: MonitorPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hour = handle.getListState("hour", "window_start_s long, z_lp2 double")
        self.latches = handle.getMapState("latches", "name string", "on boolean")
        self.runs = handle.getValueState("runs", "last_s long, began_s long, second_began_s long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, began, second = tuple(self.runs.get()) if self.runs.exists() else (None, None, None)
        hour = [tuple(x) for x in self.hour.get()] if self.hour.exists() else []
        history = History(self.policy, hour, {k[0]: v[0] for k, v in self.latches.iterator()} if self.latches.exists() else {}, last, began, second)
        before = dict(history.latches)
        for r in sorted(rows, key=lambda r: r.window_start_s):
            if history.last is not None and r.window_start_s <= history.last:
                yield named(r, (None, [], False, 0, 0, None, True))
                continue
            z = {c: _number(r[c]) for c in VECTOR}
            yield named(r, (*history.evidence(r.window_start_s, z, tuple(_number(r[c]) for c in ("forest_score", "forest_entry", "forest_exit")), r.second_active), False))
        self.hour.put(history.hour)
        for name, on in history.latches.items():
            if before.get(name) != on:
                self.latches.updateValue((name,), (on,))
        self.runs.update((history.last, history.began, history.second_began))

    def close(self) -> None:
        pass


def forest_scores_by_row(rows: DataFrame, forests: DataFrame, out: str = "forest_score") -> DataFrame:
    """forest_scores for streams, which can't be sorted: each window carries its forest to the task that scores it."""
    joined = rows.join(forests.select(*KEY, F.col("forest").alias("_forest")), list(KEY), "left")
    schema, names = StructType([*rows.schema.fields, StructField(out, DoubleType())]), rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score, x = np.full(len(frame), np.nan), frame[list(VECTOR)].to_numpy(np.float64, na_value=np.nan)
            fine = np.isfinite(x).all(axis=1)
            for blob, at in frame.reset_index(drop=True).groupby("_forest").groups.items():
                at = at.to_numpy()[fine[at]]
                if len(at):
                    score[at] = Forest.from_bytes(blob).score(x[at])
            yield frame[names].assign(**{out: score})

    return joined.mapInPandas(run, schema).withColumn(out, F.when(~F.isnan(out), F.col(out)))


def score_stream(windows: DataFrame, modules: DataFrame, regimes: DataFrame, contexts: DataFrame, second: DataFrame | None = None, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """A stream of windows, scored as score_windows scores a table of them.

    Codes, trend, persistence and level are the same if a key's windows come in their order. One that isn't later than the
    last of its key (late is true) leaves the state alone and has no evidence of its own.
    """
    scored = scores(look_up(windows, modules, regimes, contexts, policy))
    scored = with_second(forest_scores_by_row(scored, contexts.where("forest is not null")), second)
    # The operator takes rows as they are; only nullability is widened.
    schema = StructType([StructField(f.name, f.dataType) for f in scored.schema] + EVIDENCE)
    kept = scored.where("_scored").groupBy(*KEY).transformWithState(EvidenceProcessor(policy), schema, "append", "none")
    none = {f.name: F.lit(None).cast(f.dataType) for f in EVIDENCE} | {"active": F.lit(False), "persistent_s": F.lit(0).cast("long"), "second_s": F.lit(0).cast("long"), "late": F.lit(False), "reason_codes": F.array().cast("array<string>")}
    return decided(kept.unionByName(scored.where("not _scored").withColumns(none)), policy)
