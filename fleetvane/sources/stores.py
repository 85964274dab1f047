"""Sinks and small stores: prepared windows, decisions, artifacts and the machines' registry."""

from __future__ import annotations

import ipaddress
import json
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_prepared(windows: DataFrame, path: str, features: tuple[str, ...]) -> None:
    """Windows by machine, module and split, with the feature list as a column's comment."""
    seq = F.col("seq").alias("seq", metadata={"comment": json.dumps(features)})
    windows.withColumn("seq", seq).write.partitionBy("machine_id", "module_id", "split").mode("overwrite").parquet(path)


def read_prepared(spark: SparkSession, path: str, features: tuple[str, ...]) -> DataFrame:
    df = spark.read.parquet(path)
    if json.loads(df.schema["seq"].metadata.get("comment", "[]")) != list(features):
        raise ValueError("the prepared windows have other features")
    return df


def append_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").partitionBy("machine_id").json(path)


def read_decisions(spark: SparkSession, path: str, schema: str, last: int = 20_000) -> DataFrame:
    """The last decisions by time; lines that aren't of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.col("window_start_s").desc()).limit(last)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(group, machine_id, module_id, percentile, value) of a JSON object keyed by group."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<machine_id string, module_id string, percentile double, value double>>").alias("m"))
    return raw.select(F.explode("m").alias("group", "t")).select("group", "t.*")


GROUP_METRICS = "machine_id string, module_id int, validation_p50 double, validation_p99 double, test_p50 double, test_p95 double, test_exceedance double"


def write_group_metrics(metrics: DataFrame, path: str) -> None:
    columns = [f.split()[0] for f in GROUP_METRICS.split(", ")]
    metrics.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_group_metrics(spark: SparkSession, path: str, machine_id: str | None = None, module_id: int | None = None) -> DataFrame:
    """The metrics of all groups, or of one; values that aren't finite numbers are null."""
    out = spark.read.schema(GROUP_METRICS).option("header", True).csv(path)
    if machine_id is not None:
        out = out.where(F.col("machine_id") == machine_id)
    if module_id is not None:
        out = out.where(F.col("module_id") == module_id)
    numbers = [f.name for f in out.schema if f.dataType.typeName() == "double"]
    return out.withColumns({n: F.when(F.abs(n) < float("inf"), F.col(n)) for n in numbers})


def write_document(path: str, document: dict) -> None:
    """A small JSON file of the driver's, replaced as a whole."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2)
    os.replace(temporary, path)


class Machines:
    """The registry of machines: names of MX and digits, IPv4 addresses, both unique; passwords are never given out."""

    def __init__(self, path: str):
        self.path = path

    def all(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return [{k: v for k, v in m.items() if k != "password"} for m in json.load(f)["machines"]]

    def put(self, name: str, ip: str, **more: str | bool) -> dict:
        m = re.fullmatch(r"(?:MX)?([0-9]{1,20})", name.strip(), re.IGNORECASE)
        if not m:
            raise ValueError(f"not a machine's name: {name!r}")
        row = {"enabled": True, **more, "name": f"MX{m[1].zfill(3)}", "ip": str(ipaddress.IPv4Address(ip))}
        others = [x for x in self.all() if x["name"] != row["name"]]
        if any(x["ip"] == row["ip"] for x in others):
            raise ValueError(f"{ip} belongs to another machine")
        write_document(self.path, {"machines": sorted([*others, row], key=lambda x: x["name"])})
        return {k: v for k, v in row.items() if k != "password"}

    def remove(self, name: str) -> None:
        write_document(self.path, {"machines": [x for x in self.all() if x["name"] != name]})

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m["name"], m["ip"], bool(m["enabled"])) for m in self.all()], "machine_id string, ip string, enabled boolean")
