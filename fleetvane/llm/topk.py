"""Operator 7: exact top-k by inner product, with vectors bucketed by norm.

Vectors become integers and are dealt into files by descending norm, so that each block of rows is a bucket of similar
norms. The k-th best product over the longest vectors is a first threshold per query. In each bucket a query's threshold,
divided by its own norm and the bucket's largest, is a local cosine threshold: over 1, no vector of the bucket can enter;
high, vectors are pruned by the range that the query's largest coordinates leave them; otherwise by their norm alone.
What is left is verified by whole products. Thresholds rise as a task goes on.

Products are made in doubles where norms prove that these are exact, else in 64-bit integers, else in Python's.

Queries go to the tasks in packed blocks of bounded size; each block is one pass over the vectors. Thresholds are made in
tasks too; what passes through the driver at a time is one packed block, or the packed longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetvane.llm.common import written

K, SCALE, EVERY = 10, 1024, 100
#: Bytes of a block of queries that is broadcast, and of the longest vectors on which thresholds begin (so many at most).
BLOCK_BYTES, SEED_BYTES, SEEDS = 32 << 20, 8 << 20, 4096
#: Rows of a bucket; the local cosine threshold from which coordinates are used, and how many of them.
BUCKET, COORDINATE_COSINE, FOCUS = 4096, 0.6, 3
#: Integer products below these are exact in double and in 64-bit arithmetic.
EXACT, LONG = float(1 << 53), float(1 << 63)
#: What a product of scale and component beyond doubles counts as.
LARGEST = 1.7e308
#: The score of no vector.
NONE = -np.iinfo(np.int64).max
HITS = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm2): components floor(scale * x), whole numbers as doubles. Rows whose id or vector is null, or with null or non-finite components, are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(~bad)
    # A double is floored without a cast to long, which would cut it off: what is over 2**53 is whole already.
    floor = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)
    within = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    v = ints.select("vec_id", F.transform("x", lambda c: within(floor(c * scale))).alias("v"))
    return v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def by_norm(ints: DataFrame) -> DataFrame:
    """Written in files of descending norm; equal norms are dealt by a hash of the id, so that no norm fills a task."""
    keys = [F.col("norm2").desc(), F.xxhash64("vec_id")]
    return written(ints.repartitionByRange(*keys).sortWithinPartitions(*keys, "vec_id"), "vectors")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """q @ x.T as 64-bit integers, exact; most is at least the product of the largest norms. What is beyond 64 bits becomes the nearest number within."""
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    if most < LONG / 2:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in x] for r in q]
    return np.array([[min(max(v, NONE + 1), -NONE) for v in r] for r in whole], np.int64).reshape(len(q), len(x))


class Best:
    """The k best (score, vec_id) of each query so far, and its threshold: nothing below it can still enter."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """rows: queries; ids: (m,) or (len(rows), m); scores: (len(rows), m), NONE where there is no vector."""
        if scores.shape[1] > 4 * self.k:
            # Cut to those that reach each query's k-th best; ties are settled below.
            bar = np.maximum(-np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1], self.floor[rows])
            most = int((scores >= bar[:, None]).sum(axis=1).max(initial=0))
            if not most:
                return
            if most < scores.shape[1]:
                take = np.argpartition(-np.where(scores >= bar[:, None], scores, NONE), most - 1, axis=1)[:, :most]
                scores, ids = np.take_along_axis(scores, take, 1), np.broadcast_to(ids, scores.shape)[np.arange(len(rows))[:, None], take]
        all_scores = np.concatenate([self.score[rows], scores], axis=1)
        all_ids = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(all_scores, order, 1)
        self.id[rows] = np.take_along_axis(all_ids, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows][:, -1])


class QueryBlock:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray):
        self.ids, self.vectors, self.floor = ids, vectors, floor
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        safe = np.maximum(self.norms, 1e-300)
        self.focus = np.argsort(-np.abs(vectors), axis=1)[:, :FOCUS]
        self.unit_focus = np.take_along_axis(vectors, self.focus, 1) / safe[:, None]

    def search(self, best: Best, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        """One bucket: ids, vectors and norms in descending norm."""
        top = norms[0]
        floor = best.floor.astype(np.float64)
        bound = floor / np.maximum(self.norms * top, 1e-300)
        bound = np.where(self.norms * top > 0, bound, np.where(floor > 0, 2.0, -1.0)) - 1e-9
        by_coordinate = (bound >= COORDINATE_COSINE) & (bound <= 1)
        by_length = np.flatnonzero(bound < COORDINATE_COSINE)
        for i in range(0, len(by_length), 256):
            rows = by_length[i : i + 256]
            least = np.where(floor[rows] > 0, floor[rows] / np.maximum(self.norms[rows], 1e-300), 0.0) * (1 - 1e-9)
            n = int(np.searchsorted(-norms, -least.min(), side="right"))
            if n:
                scores = products(self.vectors[rows], x[:n], float(self.norms[rows].max() * top))
                scores[self.ids[rows][:, None] == ids[None, :n]] = NONE
                best.offer(rows, ids[:n], scores)
        if by_coordinate.any():
            unit = x / np.maximum(norms, 1e-300)[:, None]
            for row in np.flatnonzero(by_coordinate):
                t = max(bound[row], 0.0)
                left = (norms * self.norms[row] >= floor[row] * (1 - 1e-9)) & (ids != self.ids[row])
                for f, q in zip(self.focus[row], self.unit_focus[row], strict=True):
                    slack = np.sqrt(max(0.0, (1 - t * t) * (1 - q * q))) + 1e-9
                    left &= (unit[:, f] >= q * t - slack) if q >= 0 else (unit[:, f] <= q * t + slack)
                at = np.flatnonzero(left)
                if len(at):
                    best.offer(np.array([row]), ids[at], products(self.vectors[row][None, :], x[at], float(self.norms[row] * top)))


PACKED = "dim int, ids binary, vectors binary, norms binary, floors binary"


def _packed(rows: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """rows (vec_id, v, norm2, floor) of bounded size, by dimension, as arrays that one task makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}
        for b in batches:
            lengths = np.asarray(pa.compute.list_value_length(b.column(1)))
            for d in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == d))
                held.setdefault(d, []).append([np.asarray(part.column(0)), _matrix(part.column(1), d), np.sqrt(np.asarray(part.column(2))), np.asarray(part.column(3))])
        for d, parts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *[pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*parts, strict=True)]], [f.split()[0] for f in PACKED.split(", ")])

    out = {}
    for r in rows.repartition(1).sortWithinPartitions(F.col("norm2").desc(), "vec_id").mapInArrow(run, PACKED).toLocalIterator():
        ids = np.frombuffer(r.ids, np.int64)
        out[r.dim] = (ids, np.frombuffer(r.vectors, np.float64).reshape(len(ids), r.dim), np.frombuffer(r.norms, np.float64), np.frombuffer(r.floors, np.int64))
    return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.asarray(pa.compute.list_value_length(batch.column(1)))
    for d in np.unique(lengths).tolist():
        yield d, np.flatnonzero(lengths == d)


def _with_floors(queries: DataFrame, seeds: dict[int, tuple[np.ndarray, ...]], k: int) -> DataFrame:
    """queries with floor, a lower bound of their k-th best score by the longest vectors; NONE without enough of them."""
    held = queries.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BUCKET):
                batch = whole.slice(i, BUCKET)
                floors = np.full(batch.num_rows, NONE, np.int64)
                for d, at in _by_dim(batch):
                    ids, x, norms, _ = held.value.get(d, ([], None, None, None))
                    if len(ids) > k:
                        block = QueryBlock(np.asarray(batch.column(0))[at], _matrix(batch.column(1).take(pa.array(at)), d), floors[at])
                        best = Best(len(at), k, block.floor)
                        for j in range(0, len(ids), 512):
                            block.search(best, ids[j : j + 512], x[j : j + 512], norms[j : j + 512])
                        floors[at] = best.score[:, -1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(floors)], ["vec_id", "v", "norm2", "floor"])

    return queries.select("vec_id", "v", "norm2").mapInArrow(run, "vec_id long, v array<double>, norm2 double, floor long")


def top_inner_products(vectors: DataFrame, k: int = K, every: int = EVERY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k best of all other vectors, ties to the smaller vec_id; fewer if there are fewer.

    Queries are the rows whose vec_id is divisible by `every`. Of rows that repeat a query's vec_id one is the query (the
    least vector) and none is its candidate; other repeated rows are candidates each. Only vectors of the same length meet;
    empty ones have products of 0. Scores beyond 64 bits are given as the nearest number within. Other columns of vectors
    play no part, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    stored = by_norm(integer_vectors(vectors))
    queries = stored.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "norm2")).alias("q")).select("vec_id", "q.v", "q.norm2")
    widest = stored.agg(F.max(F.size("v"))).first()[0]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if widest is None:
        return none
    longest = stored.orderBy(F.col("norm2").desc(), "vec_id").limit(max(1, min(SEEDS, SEED_BYTES // (8 * widest + 24))))
    queries = written(_with_floors(queries, _packed(longest.withColumn("floor", F.lit(NONE))), k), "queries")
    blocks = -(-(queries.agg(F.sum(8 * F.size("v") + 24)).first()[0] or 0) // block_bytes)
    hits = None
    for b in range(blocks):
        held = spark.sparkContext.broadcast(_packed(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            blocks_of = {d: QueryBlock(ids, x, floors) for d, (ids, x, _, floors) in held.value.items()}
            best = {d: Best(len(x.ids), k, x.floor) for d, x in blocks_of.items()}
            for whole in batches:
                for i in range(0, whole.num_rows, BUCKET):
                    batch = whole.slice(i, BUCKET)
                    ids, norms = np.asarray(batch.column(0)), np.sqrt(np.asarray(batch.column(2)))
                    for d, at in _by_dim(batch):
                        if d in blocks_of:
                            blocks_of[d].search(best[d], ids[at], _matrix(batch.column(1).take(pa.array(at)), d), norms[at])
            for d, x in best.items():
                q, j = np.nonzero(x.score > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(blocks_of[d].ids[q], pa.int64()), pa.array(x.id[q, j], pa.int64()), pa.array(x.score[q, j])], ["query_id", "vec_id", "score"])

        found = stored.select("vec_id", "v", "norm2").mapInArrow(run, HITS)
        found = written(found, "hits") if blocks > 1 else found
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return none
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
