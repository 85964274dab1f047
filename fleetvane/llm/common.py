"""What the operators share: tables, the shared folder and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


_held: dict[tuple, object] = {}


def give_back() -> None:
    """Frees what tasks of another kind left in this Python worker, so that stages in a row don't hold the memory of all of them."""
    if _held:
        _held.clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def held(make: Callable) -> Callable:
    """make, whose result a Python worker keeps from task to task; what it kept of another make, or for other arguments, is given back first."""

    @wraps(make)
    def get(*args):
        key = (make.__module__, make.__qualname__, *args)
        if key not in _held:
            give_back()
            _held[key] = make(*args)
        return _held[key]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts, in order: up to so many rows, whose texts have up to so many bytes in all (one row at least)."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        full = int(np.searchsorted(ends, ends[start] - size[start] + most_bytes, side="right"))
        stop = min(start + rows, max(start + 1, full))
        yield batch.slice(start, stop - start)
        start = stop


def by_slices(rows: int, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands slices of up to so many rows, in order, to what make() returns once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch, rows):
                out = each(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's strings; null becomes the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def raw_texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The same in UTF-8."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]
