"""Wide daily logs of machines: discovery, header, and rows in the canonical long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetvane.functions.scalar import parsed_number

#: Columns of a log, per module, and their names here.
WIDE = {"Hp_1st": "hp1", "Lp_1st": "lp1", "Hp_2nd": "hp2", "Lp_2nd": "lp2", "Valve": "valve", "TempHi": "temphi", "TempLo": "templo"}
DAY = r"(20\d{2})_(\d{2})_(\d{2})"


def discover(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(path, length, modified) of logs named by a day; the last `most` by path. Static and temporary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,txt}").load(path).select("path", "length", F.unix_micros("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    wanted = files.where(name.rlike(DAY) & ~F.lower(name).contains("static") & ~name.contains(".tmp.") & ~name.startswith("~$"))
    return wanted.orderBy(F.col("path").desc()).limit(most) if most else wanted


#: A comma outside of quotes: an even number of quotes follows.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_cells(line: Column) -> Column:
    """The cells of a line of comma-separated values, trimmed; quoted ones may hold commas, and doubled quotes for quotes."""
    bare = lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(F.split(line, COMMA, -1), lambda c: F.trim(bare(F.trim(c))))


def read_logs(spark: SparkSession, paths: list[str], machine_id: str | Column, modules: tuple[int, ...] = tuple(range(1, 9)), with_rejected: bool = False) -> tuple[DataFrame, ...]:
    """Rows of the logs, and the files without a header; with_rejected, also the lines below a header without a readable time.

    Each file may have its own header: the first line whose first field is Time or Date. A cell that can't be read is
    null; a module's missing column is null, or "<blank>" for text. Without a Date column the day comes from the name.
    source_order is a line's place in its file, also where a large file is read in several splits.
    """
    if not modules or not set(modules) <= set(range(1, 9)):
        raise ValueError("modules are 1 to 8")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), "value", place.alias("order"))
    lines = lines.withColumn("cells", csv_cells(F.regexp_replace("value", "^﻿", "")))
    heads = lines.where(F.col("cells")[0].isin("Time", "Date")).groupBy("file").agg(F.min_by("cells", "order").alias("head"), F.min("order").alias("at"))
    errors = lines.select("file").distinct().join(heads, "file", "left_anti").withColumn("error", F.lit("No tabular header found"))
    rows = lines.join(heads, "file").where("order > at").withColumn("row", F.map_from_arrays("head", F.transform("head", lambda h, i: F.get("cells", i))))
    cell = lambda c: F.try_element_at("row", F.lit(c))
    has = lambda c: F.array_contains("head", c)
    text = lambda c: F.when(has(c), F.coalesce(F.nullif(cell(c), F.lit("")), F.lit("nan"))).otherwise("<blank>")
    day = F.when(has("Date"), cell("Date")).otherwise(F.regexp_replace(F.regexp_extract("name", DAY, 0), "_", "-"))
    ts = F.expr("try_to_timestamp(stamp)").cast("timestamp_ntz")
    module = [F.struct(F.lit(m).alias("module_id"), *[parsed_number(cell(f"{w}_{m}")).alias(n) for w, n in WIDE.items()], text(f"Status_{m}").alias("module_status"), parsed_number(cell(f"Busy_{m}")).alias("busy"), text(f"SV_{m}").alias("sv")) for m in sorted(set(modules))]
    machine = F.lit(machine_id) if isinstance(machine_id, str) else machine_id
    timed = rows.withColumn("stamp", F.concat_ws(" ", day, cell("Time"))).withColumn("timestamp", ts)
    stamped = timed.where("timestamp is not null")
    long = stamped.select("timestamp", machine.alias("machine_id"), text("Status").alias("global_status"), F.col("order").alias("source_order"), "file", F.explode(F.array(*module)).alias("m")).select("timestamp", "machine_id", "global_status", "source_order", "file", "m.*")
    return (long, errors, timed.where("timestamp is null").select("file", F.col("order").alias("source_order"), "value")) if with_rejected else (long, errors)


def first_sight(files: DataFrame, keep: int) -> DataFrame:
    """All but a machine's last files are marked as skipped."""
    r = F.row_number().over(Window.partitionBy("machine_id").orderBy(F.col("path").desc()))
    return files.withColumn("status", F.when(r > keep, "baseline_skipped").otherwise("pending"))
