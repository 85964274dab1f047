"""Log files as transactions: a stream of file notices, scored file by file, with a ledger that says which rows count.

Each batch writes the decisions of its files first, one folder per version of a file, and then its page of the ledger. Only
rows of versions that the ledger holds are read, so a batch that dies in between leaves nothing behind: it is repeated
under the same number, and overwrites its own folders and its own page. A file that has grown is a new version, and the
ledger's last one for a file is the one that counts. Files that can't be read go to a table of errors and aren't held back
when they are noticed again. What a machine had before its start boundary is marked and never scored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.config import MonitorPolicy
from fleetvane.operators.windows import event_windows
from fleetvane.sources.logs import discover, read_logs

NOTICES = "machine_id string, path string, length long, modified long"
LEDGER = "batch_id long, machine_id string, file string, signature string, status string, rows long, rejected long, decisions long"
ERRORS = "batch_id long, machine_id string, file string, signature string, error string"
#: What the ledger says of a version of a file.
PROCESSED, BOUNDARY = "processed", "boundary"


def plain_path(path: Column) -> Column:
    """Local paths are written file:/... by one source and file:///... by another."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def versions(notices: DataFrame) -> DataFrame:
    """(machine_id, file, signature): the last noticed version of each file; a signature changes with path, length and time."""
    file = plain_path(F.col("path"))
    signature = F.sha2(F.concat_ws("|", file, "length", "modified"), 256)
    rows = notices.select("machine_id", file.alias("file"), signature.alias("signature"), "modified", "length")
    return rows.groupBy("file").agg(F.max_by(F.struct("machine_id", "signature"), F.struct("modified", "length", "signature")).alias("v")).select("v.machine_id", "file", "v.signature")


def notice(spark: SparkSession, folder: str, machine_id: str) -> DataFrame:
    """Notices of a machine's logs as they lie in a folder now."""
    return discover(spark, folder).select(F.lit(machine_id).alias("machine_id"), "path", "length", "modified")


class FileLedger:
    """Decisions, pages and errors under one path of a store that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.option("recursiveFileLookup", schema is not None).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema) if schema else None

    def pages(self) -> DataFrame:
        return self._table("ledger", LEDGER)

    def errors(self) -> DataFrame:
        return self._table("errors", ERRORS)

    def current(self) -> DataFrame:
        """(file, machine_id, signature, status, rows, rejected, decisions, batch_id): the last entry of each file."""
        rest = ["machine_id", "signature", "status", "rows", "rejected", "decisions", "batch_id"]
        return self.pages().groupBy("file").agg(F.max_by(F.struct(*rest), "batch_id").alias("e")).select("file", "e.*")

    def decisions(self) -> DataFrame | None:
        """The decisions that count, or None before the first."""
        rows = self._table("decisions")
        return rows if rows is None else rows.join(self.current().where(F.col("status") == PROCESSED).select("file", "signature"), ["file", "signature"], "left_semi")

    def _put(self, name: str, batch: int, rows: DataFrame) -> None:
        """A page of one file: it is there as a whole or not at all."""
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/page={batch}")

    def begin(self, notices: DataFrame) -> None:
        """The start boundary: the present version of these files is never scored. A machine's boundary is a page of its own."""
        for (machine_id,) in notices.select("machine_id").distinct().collect():
            mine = versions(notices.where(F.col("machine_id") == machine_id))
            none = F.lit(None).cast("long")
            page = mine.select(F.lit(-1).cast("long").alias("batch_id"), "machine_id", "file", "signature", F.lit(BOUNDARY).alias("status"), none.alias("rows"), none.alias("rejected"), none.alias("decisions"))
            page.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger/boundary={machine_id}")

    def pending(self, notices: DataFrame, batch_id: int) -> DataFrame:
        """The noticed versions that no other batch has scored and no boundary excludes."""
        known = self.pages().where(F.col("batch_id") != batch_id).select("file", "signature")
        return versions(notices).join(known, ["file", "signature"], "left_anti")

    def commit(self, batch_id: int, entries: DataFrame) -> None:
        self._put("ledger", batch_id, entries.select(*[f.split()[0] for f in LEDGER.split(", ")]))


def _readable(spark: SparkSession, files: list[str]) -> tuple[list[str], dict[str, str]]:
    good, bad = [], {}
    for f in files:
        try:
            spark.read.text(f)  # looks the file up, reads nothing
            good.append(f)
        except AnalysisException as e:
            bad[f] = str(e).split("\n")[0][:300]
    return good, bad


def file_sink(ledger: FileLedger, score: Callable[[DataFrame], DataFrame], modules: tuple[int, ...] = tuple(range(1, 9))) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over notices. score gets rows of read_logs and returns decisions, which keep file.

    A batch's files are a list of bounded length (what one trigger notices); their rows are never collected.
    """

    def each(notices: DataFrame, batch_id: int) -> None:
        spark = notices.sparkSession
        todo = ledger.pending(notices, batch_id).collect()
        good, bad = _readable(spark, [r.file for r in todo])
        versions_ = spark.createDataFrame(todo, "file string, machine_id string, signature string")
        errors = spark.createDataFrame(list(bad.items()), "file string, error string")
        if good:
            long, headless, rejected = read_logs(spark, good, "", modules, with_rejected=True)
            errors = errors.union(headless.select(plain_path(F.col("file")).alias("file"), "error"))
            long = long.drop("machine_id").withColumn("file", plain_path(F.col("file"))).join(F.broadcast(versions_.select("file", "machine_id")), "file")
            decided = score(long).join(F.broadcast(versions_.select("file", "signature")), "file")
            decided.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signature").parquet(f"{ledger.path}/decisions")
            counts = long.groupBy("file").agg(F.count("*").alias("rows")).join(rejected.groupBy(plain_path(F.col("file")).alias("file")).agg(F.count("*").alias("rejected")), "file", "full")
            made = ledger._table("decisions")
            made = made.groupBy("signature").agg(F.count("*").alias("decisions")) if made is not None else spark.createDataFrame([], "signature string, decisions long")
        else:
            counts, made = spark.createDataFrame([], "file string, rows long, rejected long"), spark.createDataFrame([], "signature string, decisions long")
        number = F.lit(batch_id).cast("long").alias("batch_id")
        errors = errors.dropDuplicates(["file"]).join(versions_, "file").select(number, "machine_id", "file", "signature", "error").persist()
        if errors.take(1):
            ledger._put("errors", batch_id, errors)
        done = versions_.join(errors.select("file"), "file", "left_anti").join(counts, "file", "left").join(made, "signature", "left").fillna(0, ["rows", "rejected", "decisions"])
        ledger.commit(batch_id, done.select(number, "machine_id", "file", "signature", F.lit(PROCESSED).alias("status"), "rows", "rejected", "decisions"))
        errors.unpersist()

    return each


def file_windows(long: DataFrame, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """event_windows of each file apart: neither gaps nor settling reach from one file into another."""
    key = F.to_json(F.struct("machine_id", "file"))
    found = event_windows(long.withColumn("machine_id", key).withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', timestamp)")), policy)
    parts = F.from_json("machine_id", "machine_id string, file string")
    return found.withColumn("_of", parts).withColumn("machine_id", F.col("_of.machine_id")).withColumn("file", F.col("_of.file")).drop("_of")
