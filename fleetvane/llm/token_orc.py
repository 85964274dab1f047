"""Operator 1: token ids as ORC, in document order.

Integer columns of ORC are run-length encoded (direct, delta and patched-base runs); a row index with minima and maxima
and a Bloom filter on doc_id stand for each stride of rows, so that a lookup by id reads the stripes that can hold it,
and stripes are the units that tasks read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.llm.common import raw_texts_of, shared_dir, slices
from fleetvane.llm.tokens import chunk_encoder, packed, tokenizer_path

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Texts that are encoded together (4 MB at most): the more, the fewer distinct words are looked up anew.
ROWS = 512
#: What a worker may remember of words: the sort of texts and the ORC writer need the rest of an executor's memory.
ENCODER_BYTES = 96 << 20
#: Up to so many files the table of file offsets (some 100 bytes a file) is broadcast; beyond, it is joined by shuffle.
MOST_BROADCAST_FILES = 100_000
ORC = {"compression": "lz4", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}
STORED = "doc_id long, offset long, n_tokens long, ids array<int>"


def encode_sorted(docs: DataFrame, path: str, end_id: int | None = END_ID, keep_space: bool = False) -> DataFrame:
    """(doc_id, offset, n_tokens, ids) in ascending doc_id order, offset counting the ids before a document in its partition.

    The texts, which are smaller than their ids, are what is shuffled. Repeated doc_ids are ordered by their text, a null
    doc_id comes first, a null text is empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.col("doc_id").asc_nulls_first(), F.crc32(text).asc(), F.col("text").asc()]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, before = chunk_encoder(path, keep_space, ENCODER_BYTES), packed([] if end_id is None else [end_id]), 0
        for whole in batches:
            for batch in slices(whole, ROWS):
                ids = encoder.encode(raw_texts_of(batch, "text"), end)
                bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
                flat = np.frombuffer(b"".join(ids), "<i4")
                arrays = [batch.column(0), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
                before += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "offset", "n_tokens", "ids"])

    return dealt.mapInArrow(encode, STORED)


def write_token_orc(encoded: DataFrame, path: str) -> None:
    """One ORC file per partition, in the partitions' order; files are named by it."""
    encoded.write.options(**ORC).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows with start, the number of ids of all documents before each. doc_ids prune stripes and strides by index and Bloom filter."""
    stored = spark.read.schema(STORED).orc(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    totals = stored.select(part.alias("part"), "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, so_far = [], 0
    for part_id, n in sorted(map(tuple, totals)):
        base.append((part_id, so_far))
        so_far += n
    bases = spark.createDataFrame(base, "part long, base long")
    rows = stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))
    joined = rows.withColumn("part", part).join(F.broadcast(bases) if len(base) <= MOST_BROADCAST_FILES else bases, "part")
    return joined.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat = np.asarray(ids.flatten()).astype("<u4", copy=False)
        at = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_orc(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the documents' ids as ORC files and returns (doc_id, start, n_tokens, ids_crc32) as read back from them.

    An empty table gives no files with rows and no result rows; an empty or null text has the end id alone.
    """
    path = path or shared_dir(spark, "token-orc")
    write_token_orc(encode_sorted(docs, tokenizer_path(TOKENIZER)), path)
    return read_token_orc(spark, path).mapInArrow(_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")
