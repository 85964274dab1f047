"""Event-time windows of a stream of rows, with a watermark: the batch operator over what is open, batch by batch.

A window is emitted once its machine's latest time has passed its end by the allowed lateness. Until then its rows wait in a
table; with them wait the rows that later windows look back on (each module's last one in source order and in time, and its
last transition), so settling, gaps and order are judged as over the whole history. Rows that come twice count once. Rows
that come after their window was emitted go to a table of late rows. Each batch writes its own folders before it is
committed, so a batch that is repeated replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.config import GROUP, MonitorPolicy
from fleetvane.functions.scalar import token
from fleetvane.operators.windows import SECOND_US, event_windows

BOUNDS = "machine_id string, closed_us long"


class WindowStream:
    """Open rows, bounds, windows and late rows under one path of a store that every executor reaches; a folder per batch."""

    def __init__(self, spark: SparkSession, path: str, policy: MonitorPolicy = MonitorPolicy(), late_s: float = 600.0):
        self.spark, self.path, self.policy, self.late_us = spark, path.rstrip("/"), policy, int(late_s * SECOND_US)

    def _read(self, name: str, batch: int | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}" if batch is None else f"{self.path}/{name}/batch={batch}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def windows(self) -> DataFrame | None:
        found = self._read("windows")
        return found if found is None else found.drop("batch")

    def late(self) -> DataFrame | None:
        found = self._read("late")
        return found if found is None else found.drop("batch")

    def _before(self, batch: int) -> int | None:
        bounds = self._read("bounds")
        return None if bounds is None else bounds.where(F.col("batch") < batch).agg(F.max("batch")).first()[0]

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _ends(self, rows: DataFrame) -> DataFrame:
        """rows with the end of their window."""
        return rows.withColumn("_end_us", (F.floor(F.col("us") / (self.policy.window_s * SECOND_US)) + 1) * self.policy.window_s * SECOND_US)

    def _context(self, closed: DataFrame) -> DataFrame:
        """Of closed windows' rows, what later windows look back on."""
        one = F.struct(*[c for c in closed.columns if c not in ("_end_us", "_closed_us")])
        change = F.coalesce(token(F.col("module_status")).isin(*self.policy.transition_tokens), F.lit(False)) | F.coalesce(F.col("busy") == 1, F.lit(False))
        last = [F.max_by(one, "source_order"), F.max_by(one, F.struct("us", "source_order")), F.max_by(one, F.when(change, F.struct("us", "source_order")))]
        return closed.groupBy(*GROUP).agg(F.array_compact(F.array_distinct(F.array(*last))).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch over rows in the canonical long form (us, source_order, sensors and states)."""

        def each(new: DataFrame, batch: int) -> None:
            before = self._before(batch)
            names = new.columns
            bounds = self.spark.createDataFrame([], BOUNDS) if before is None else self._read("bounds", before)
            held = None if before is None else self._read("open", before)
            here = self._ends(new).join(bounds, "machine_id", "left")
            in_time = here.where("closed_us is null or _end_us > closed_us").select(*names)
            self._write(here.where("_end_us <= closed_us").select(*names), "late", batch)
            rows = in_time if held is None else held.unionByName(in_time)
            rows = self._write(rows.dropDuplicates([*GROUP, "source_order", "us"]), "rows", batch)
            marks = rows.groupBy("machine_id").agg(F.max("us").alias("latest"))
            width = self.policy.window_s * SECOND_US
            closed = (F.floor((F.col("latest") - self.late_us) / width) * width).cast("long")
            known = marks.join(bounds, "machine_id", "full").select("machine_id", F.greatest(closed, "closed_us").alias("closed_us"), F.col("closed_us").alias("_closed_us"))
            known = self._write(known, "marks", batch)
            found = event_windows(rows, self.policy).join(known, "machine_id")
            end = (F.col("window_start_s") + self.policy.window_s) * SECOND_US
            due = (end <= F.col("closed_us")) & (F.col("_closed_us").isNull() | (end > F.col("_closed_us")))
            self._write(found.where(due).drop("closed_us", "_closed_us"), "windows", batch)
            judged = self._ends(rows).join(known.select("machine_id", "closed_us"), "machine_id")
            waiting = judged.where("_end_us > closed_us").select(*names)
            self._write(waiting.unionByName(self._context(judged.where("_end_us <= closed_us").drop("closed_us")).select(*names)), "open", batch)
            self._write(known.select("machine_id", "closed_us"), "bounds", batch)  # commits the batch

        return each
