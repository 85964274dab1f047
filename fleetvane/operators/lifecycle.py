"""Lifecycle of a machine's profile as a table of events; the present state is the last event. Of two movers one wins, the other is told."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.shared import put_if_absent

#: The states' names.
STATES = ("COLLECTING_DATA", "LEARNING", "CANDIDATE_PROFILE_READY", "SHADOW_VALIDATION", "APPROVAL_REQUIRED", "ACTIVE", "REJECTED")
EVENTS = "machine_id string, seq long, state string, reason string, actor string, candidate_version string, active_version string"


def current(events: DataFrame) -> DataFrame:
    return events.groupBy("machine_id").agg(F.max_by(F.struct("state", "reason", "actor", "candidate_version", "active_version", "seq"), "seq").alias("e")).select("machine_id", "e.*")


class Conflict(RuntimeError):
    """Another mover has taken the machine's next event."""


class Lifecycle:
    """Transitions are events in files of their own, numbered per machine; a number is written by one mover only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).option("recursiveFileLookup", True).json(self.path).where("seq is not null")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENTS)

    def state(self, machine_id: str):
        return current(self.events().where(F.col("machine_id") == machine_id)).first()

    def move(self, machine_id: str, state: str, reason: str, actor: str | None = None, after: int | None = None, **versions: str | None) -> None:
        """Appends an event. after: the number of the event that the mover has decided upon; Conflict if it isn't the last any more."""
        if state not in STATES:
            raise ValueError(f"no such state: {state}")
        last = self.state(machine_id)
        number = last.seq if last else -1
        known = {k: versions.get(k, last[k] if last else None) for k in ("candidate_version", "active_version")}
        row = {"machine_id": machine_id, "seq": (number if after is None else after) + 1, "state": state, "reason": reason, "actor": actor, **known}
        if after is not None and after != number or not put_if_absent(self.spark, f"{self.path}/{machine_id}/{row['seq']:09d}.json", json.dumps(row)):
            raise Conflict(f"{machine_id} has an event {row['seq']} already")

    def approve(self, machine_id: str, actor: str, reason: str = "human_approval") -> None:
        last = self.state(machine_id)
        if last is None or last.state != "APPROVAL_REQUIRED":
            raise ValueError("a profile must be in APPROVAL_REQUIRED before it is activated")
        self.move(machine_id, "ACTIVE", reason, actor, last.seq, active_version=last.candidate_version)

    def reject(self, machine_id: str, actor: str, reason: str) -> None:
        self.move(machine_id, "REJECTED", reason, actor)

    def continue_learning(self, machine_id: str, actor: str) -> None:
        self.move(machine_id, "COLLECTING_DATA", "continue_learning", actor, candidate_version=None)


def shadow_rates(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Attempted windows (eligible or of unknown regime), the share of unknown ones, and flag rates over the known ones."""
    unknown, known = F.col("window_status") == "UNKNOWN_REGIME", F.col("window_status") == "ELIGIBLE"
    n = lambda c: F.count(F.when(c, 1))
    return decisions.where(unknown | known).groupBy(*by).agg(n(unknown | known).alias("windows"), n(known).alias("known"), (n(unknown) / F.greatest(F.lit(1), n(unknown | known))).alias("unknown_rate"), (n(known & F.col("first_active")) / F.greatest(F.lit(1), n(known))).alias("first_rate"), (n(known & F.col("second_active")) / F.greatest(F.lit(1), n(known))).alias("second_rate"))


def shadow_passed(rates: DataFrame, days: int, least_days: int = 3, least_windows: int = 100, unknown: float = 0.05, first: float = 0.05, second: float = 0.10) -> DataFrame:
    return rates.withColumn("passed", (F.lit(days) >= least_days) & (F.col("windows") >= least_windows) & (F.col("unknown_rate") <= unknown) & (F.col("first_rate") <= first) & (F.col("second_rate") <= second))
