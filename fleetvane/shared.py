"""Tables written to the folder that driver and executors share: lineage ends there, and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir).

    Where that setting is empty a temporary folder takes its place in local mode; on a cluster that is an error, as
    executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one of that name already; of several writers one succeeds. False if it was another."""
    from py4j.protocol import Py4JJavaError

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = store.create(target, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception).lower():
            return False
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True
