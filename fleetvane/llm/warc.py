"""Operator 4: WARC archives in which equal payloads are kept once.

Headers (id, address, length, digest), not payloads, are shuffled by payload digest. Of the records with equal payloads of
a least length the one with the largest page_id is the response; the others are joined to it and become revisit records,
which have headers only. Responses are then written from the pages, revisits from the headers.

Each record is a gzip member of its own, as readers of WARC files expect. A task puts members together to files of bounded
size, each a row of Spark's text writer and begun by a warcinfo record. The writer ends a row with one byte, zero here,
which is the last byte of an empty gzip member at the end of each file.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.llm.common import shared_dir, slices, written

LEAST_BYTES = 1000
#: Up to so many keys of revisits and repeated rows, some 100 bytes each, are broadcast to where responses are written; beyond, the pages are shuffled by id.
MOST_BROADCAST_KEYS = 1_000_000
#: A file is closed at so many bytes, and the last record may be as long as it likes.
FILE_BYTES = 32 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: An empty gzip member without its last byte, which is zero.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)[:-1]


def headers_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, digest) of every page; null html is empty."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.octet_length(html).cast("long").alias("payload_bytes"), F.unhex(F.sha1(html)).alias("digest"))


def revisits_of(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload_bytes, digest, original, original_url, one) of the headers that repeat the payload of a larger page_id; one: a single row has the original's id."""
    long = headers.where(F.col("payload_bytes") >= least_bytes)
    # Rows of the same page_id are counted before digests are gathered, so the copies of one page weigh as one.
    pages = long.groupBy("digest", "page_id").agg(F.max("url").alias("url"), F.count("*").alias("n"))
    originals = pages.groupBy("digest").agg(F.max(F.struct("page_id", "url", "n")).alias("o"), F.count("*").alias("pages")).where("pages > 1")
    found = long.join(originals.select("digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"), (F.col("o.n") == 1).alias("one")), "digest")
    return found.where("page_id < original").select("page_id", "url", "payload_bytes", "digest", "original", "original_url", "one")


def _uri(page_id: int | None, url: str | None) -> str:
    """The address without characters that would break a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:x-page:{page_id}"


def record_id(page_id: int | None, digest: bytes, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest.hex()}/{copy}')}>"


def _framed(named: dict[str, str], block: bytes) -> bytes:
    named |= {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, date: str, digest: bytes, payload: bytes, size: int, copy: str = "", original: int | None = None, original_url: str | None = None, one: bool = True) -> bytes:
    """One record. With an original it is a revisit, and the payload is left out; its record is named if just one has that page_id and payload."""
    named = {"WARC-Type": "response" if original is None else "revisit", "WARC-Record-ID": record_id(page_id, digest, copy), "WARC-Date": date, "WARC-Target-URI": _uri(page_id, url), "WARC-Payload-Digest": f"sha1:{digest.hex()}", "X-Payload-Length": str(size), "X-Page-ID": str(page_id)}
    block = (HTTP % size).encode()
    if original is not None:
        named |= {"WARC-Profile": PROFILE, **({"WARC-Refers-To": record_id(original, digest)} if one else {}), "WARC-Refers-To-Target-URI": _uri(original, original_url), "WARC-Refers-To-Date": date, "X-Refers-To-Page-ID": str(original)}
    else:
        block += payload
    return _framed(named | {"Content-Type": "application/http;msgtype=response"}, block)


def info_record(date: str, name: str) -> bytes:
    return _framed({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{date}/{name}')}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record per page, dated now unless told otherwise. Rows that share both page_id and payload are records of the same type with ids of their own; a null page_id is never a revisit."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run_id = uuid.uuid4().hex
    headers = written(headers_of(pages), "warc-headers")
    revisits = written(revisits_of(headers, least_bytes), "warc-revisits")
    # Headers with what is to be known where records are written: which are revisits, and which repeat page_id and payload.
    keys = headers.groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("page_id", "digest", F.lit(False).alias("is_revisit")).unionByName(revisits.select("page_id", "digest", F.lit(True).alias("is_revisit")))
    keys = written(keys.groupBy("page_id", "digest").agg(F.max("is_revisit").alias("is_revisit")), "warc-keys")
    few = keys.count() <= MOST_BROADCAST_KEYS
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.unhex(F.sha1("html")))
    side = (F.broadcast(keys) if few else keys).withColumnsRenamed({"page_id": "k_page", "digest": "k_digest"})
    known = full.join(side, F.col("page_id").eqNullSafe(F.col("k_page")) & (F.col("digest") == F.col("k_digest")), "left")
    none = {"original": F.lit(None).cast("long"), "original_url": F.lit(None).cast("string"), "one": F.lit(True)}
    responses = known.where(~F.coalesce("is_revisit", F.lit(False))).withColumn("repeats", F.col("is_revisit").isNotNull()).select("page_id", "url", "html", "payload_bytes", "digest", "repeats", *[v.alias(k) for k, v in none.items()])
    rows = responses.unionByName(revisits.withColumn("html", F.lit(b"")).withColumn("repeats", F.lit(True)))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, copies, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for whole in batches:
            for part in slices(whole, 256):
                for r in part.to_pylist():
                    copies += 1
                    member = gzip.compress(record(r["page_id"], r["url"], date, r["digest"], r["html"], r["payload_bytes"], f"{run_id}/{task}/{copies}" if r["repeats"] else "", r["original"], r["original_url"], r["one"]), 6, mtime=0)
                    if not held:
                        held, files = [gzip.compress(info_record(date, f"{run_id}/{task}/{files}"), 6, mtime=0)], files + 1
                    held.append(member)
                    size += len(member)
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join([*held, EMPTY_MEMBER])], pa.binary())], ["file"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*held, EMPTY_MEMBER])], pa.binary())], ["file"])

    spark_rows = rows.mapInArrow(members, "file binary").select(F.col("file").cast("string").alias("value"))
    spark_rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _records(content: bytes) -> Iterator[bytes]:
    """The members of one file, unpacked one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof and at < len(view):
            chunk = view[at : at + 65536]
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError("an archive ends within a record")
        if data := b"".join(parts):
            yield data


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields and its block, whose length is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if version != "WARC/1.1" or end != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, block


def _page_of(text: str | None) -> int | None:
    return None if text in (None, "None") else int(text)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of a page. A response's payload is measured and hashed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for data in _records(content.as_py()):
                    fields, block = parse(data)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (size, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
                            raise ValueError(f"{fields['WARC-Record-ID']} doesn't hold its payload")
                    rows.append((_page_of(fields["X-Page-ID"]), size, digest, fields["WARC-Type"], _page_of(fields.get("X-Refers-To-Page-ID"))))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in RECORD.split(", ")])

    # Files are of bounded size, so a row of this reader is too.
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives and returns what they hold, a row per page. An empty table gives no rows."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
