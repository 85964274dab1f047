"""The prepared set: windows by machine, module and split, with an audit of every file and a manifest that is read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.sources.stores import read_prepared, write_prepared

AUDIT = ("file", "module_id", "raw_rows", "accepted_rows", "rejected_rows", "windows", "unreadable_lines", "error")


def file_audit(flags: DataFrame, windows: DataFrame, files: DataFrame, modules: tuple[int, ...], unreadable: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(AUDIT) of every file and module, files without rows included; accepted and rejected rows add up to raw ones.

    flags: rows with file, module_id, is_active; windows: with file, module_id; files: (file); unreadable: (file) a line;
    errors: (file, error). A file's unreadable lines and error are told with each of its modules.
    """
    key = ["file", "module_id"]
    asked = files.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, sorted(set(modules))))).alias("module_id"))
    active = F.coalesce(F.col("is_active"), F.lit(False))
    rows = flags.groupBy(*key).agg(F.count("*").alias("raw_rows"), F.count(F.when(active, 1)).alias("accepted_rows"), F.count(F.when(~active, 1)).alias("rejected_rows"))
    made = windows.groupBy(*key).agg(F.count("*").alias("windows"))
    out = asked.join(rows, key, "left").join(made, key, "left")
    lines = unreadable.groupBy("file").agg(F.count("*").alias("unreadable_lines")) if unreadable is not None else None
    out = out.join(lines, "file", "left") if lines is not None else out.withColumn("unreadable_lines", F.lit(0).cast("long"))
    out = out.join(errors.groupBy("file").agg(F.min("error").alias("error")), "file", "left") if errors is not None else out.withColumn("error", F.lit(None).cast("string"))
    return out.fillna(0, ["raw_rows", "accepted_rows", "rejected_rows", "windows", "unreadable_lines"]).select(*AUDIT)


def write_set(windows: DataFrame, audit: DataFrame, path: str, features: tuple[str, ...], config: dict) -> dict:
    """Writes windows, audit and manifest, the manifest last: a set without one isn't complete. Returns the manifest."""
    spark = windows.sparkSession
    write_prepared(windows, f"{path}/windows", features)
    audit.write.mode("overwrite").parquet(f"{path}/audit")
    groups = spark.read.parquet(f"{path}/windows").groupBy("machine_id", "module_id", "split").agg(F.count("*").alias("windows")).orderBy("machine_id", "module_id", "split")
    totals = spark.read.parquet(f"{path}/audit").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in AUDIT[2:6]], F.count_distinct("file").alias("files")).first().asDict()
    manifest = {"features": list(features), "config": config, "totals": totals, "groups": [r.asDict() for r in groups.collect()]}  # a row per module and split
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_set(spark: SparkSession, path: str, config: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(windows, audit, manifest); an error if the windows aren't those of the manifest, or were made by another configuration."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first().value)
    if config is not None and manifest["config"] != config:
        raise ValueError("the prepared set was made by another configuration")
    windows = read_prepared(spark, f"{path}/windows", tuple(manifest["features"]))
    counted = {(r.machine_id, r.module_id, r.split): r["count"] for r in windows.groupBy("machine_id", "module_id", "split").count().collect()}
    if counted != {(g["machine_id"], g["module_id"], g["split"]): g["windows"] for g in manifest["groups"]}:
        raise ValueError("the prepared windows aren't those of the manifest")
    return windows, spark.read.parquet(f"{path}/audit"), manifest
