"""The batch operators on streams: tumbling windows with a watermark, idempotent upserts, and persistence as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetvane.config import SENSORS, MonitorPolicy


def streaming_windows(stream: DataFrame, policy: MonitorPolicy = MonitorPolicy(), late: str = "10 minutes") -> DataFrame:
    """Medians and counts per tumbling window; stream has ts (timestamp), machine_id, module_id and sensors."""
    w = F.window("ts", f"{policy.window_s} seconds")
    agg = stream.withWatermark("ts", late).groupBy("machine_id", "module_id", w).agg(F.count("*").alias("point_count"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in SENSORS if c in stream.columns])
    return agg.withColumn("window_start", F.col("window.start")).drop("window")


STATE = "last_s long, began_s long"
PERSISTENT = "machine_id string, module_id int, operating_mode string, window_start_s long, active boolean, persistent_s long"


def persistence_stream(decisions: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """persistent_s of each decision, as the batch operator gives it; a gap of more than reset_s or a step back begins anew."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, began = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("window_start_s")
        out = []
        for t, active in zip(rows["window_start_s"], rows["active"], strict=True):
            if last is not None and (t - last > policy.reset_s or t < last):
                began = None
            began = (t if began is None else began) if active else None
            last = int(t)
            out.append((*key, int(t), bool(active), int(t - began + policy.window_s) if active else 0))
        state.update((last, None if began is None else int(began)))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in PERSISTENT.split(", ")])

    return decisions.groupBy("machine_id", "module_id", "operating_mode").applyInPandasWithState(step, PERSISTENT, STATE, "append", GroupStateTimeout.NoTimeout)


def upsert(batch: DataFrame, existing: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the latest `order`; for use in foreachBatch, so that a repeated batch changes nothing."""
    rows = batch if existing is None else existing.unionByName(batch)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
