"""Operator 13: exact k-means assignment by annulus search.

Centroids are sorted by norm. The distance u of a vector to the centroid nearest to it in norm bounds its least distance,
and by the triangle inequality only centroids whose norms lie within u of the vector's own can be as near: two binary
searches give that annulus, and its centroids are compared exactly, boundary ties included. Norms and radii are rounded
outward, so rounding never leaves a centroid out.

A round is one pass over the written vectors. A task sends one row per centroid, coordinate and 32-bit limb of its sums,
which are added in decimals; what reaches the driver is bounded by centroids, coordinates and limbs, whatever the table
holds. Arithmetic is in doubles where these are exact, and in Python's integers beyond.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.llm.common import written

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components below this have squared distances that are exact in doubles (64 coordinates).
SMALL = float(1 << 22)
LONGEST = (1 << 63) - 1
SUMS = "cluster int, at int, limb int, part long"
ASSIGNED = "vec_id long, cluster int, distance long"


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x) of the vectors of that many components, none of them null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dim) & fine)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): whole doubles where all are small, else Python's integers. SCALE is a power of 2, so no product is rounded."""
    if np.abs(x).max(initial=0) < SMALL / SCALE:
        return np.floor(x * SCALE)
    return np.array([[int(c) * SCALE if abs(c) >= 2.0**53 else int(np.floor(c * SCALE)) for c in row] for row in x.tolist()], object).reshape(x.shape)


def _length(v: np.ndarray) -> np.ndarray:
    """Euclidean norms to the nearest double."""
    with np.errstate(over="ignore"):
        return np.sqrt((v * v).sum(axis=1).astype(np.float64)) if v.dtype != object else np.array([_root(int((r * r).sum())) for r in v])


def _root(n: int) -> float:
    """Square root; infinite where it is beyond doubles, and then every centroid is compared."""
    if n.bit_length() > 2040:
        return math.inf
    shift = max(0, n.bit_length() - 900) // 2 * 2
    return math.ldexp(math.sqrt(n >> shift), shift // 2)


class Annulus:
    """Centroids (rows of Python's integers) sorted by norm."""

    def __init__(self, centroids: list[list[int]]):
        whole = np.array(centroids, object)
        small = max((abs(c) for row in centroids for c in row), default=0) < SMALL
        norms = _length(whole)
        self.number = np.argsort(norms, kind="stable")
        self.exact, self.norms = whole[self.number], norms[self.number]
        self.plain = self.exact.astype(np.float64) if small else None

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row of v, and how many exact distances were made."""
        centroids = self.plain if v.dtype != object and self.plain is not None else self.exact
        if centroids is self.exact and v.dtype != object:
            v = v.astype(np.int64).astype(object)
        norms = _length(v)
        at = np.searchsorted(self.norms, norms)
        left, right = np.maximum(at - 1, 0), np.minimum(at, len(self.norms) - 1)
        with np.errstate(invalid="ignore"):
            guess = np.where(np.abs(norms - self.norms[left]) <= np.abs(norms - self.norms[right]), left, right)
        diff = v - centroids[guess]
        best, made = (diff * diff).sum(axis=1), len(v)
        number = self.number[guess].copy()
        radius = (np.sqrt(best.astype(np.float64)) if v.dtype != object else np.array([_root(int(b)) for b in best], np.float64).reshape(len(v))) * (1 + 1e-12) + 1e-9 * (1 + norms)
        with np.errstate(invalid="ignore"):
            low = np.where(np.isfinite(norms), np.searchsorted(self.norms, norms - radius), 0)
            high = np.where(np.isfinite(norms), np.searchsorted(self.norms, norms + radius, side="right"), len(self.norms))
        for c in range(len(self.norms)):
            rows = np.flatnonzero((low <= c) & (c < high) & (guess != c))
            if len(rows):
                diff = v[rows] - centroids[c]
                d = (diff * diff).sum(axis=1)
                better = ((d < best[rows]) | ((d == best[rows]) & (self.number[c] < number[rows]))).astype(bool)
                best[rows[better]], number[rows[better]] = d[better], self.number[c]
                made += len(rows)
        return number, best, made


def _vectors(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        x = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
        wide = (np.abs(x) >= SMALL / SCALE).any(axis=1)
        for at in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            if len(at):
                yield part.take(pa.array(at)), integers(x[at])


def _limbs(sums: list[list[int]]) -> Iterator[tuple[int, int, int, int]]:
    """(cluster, coordinate, limb, part) of nonzero sums: part * 2 ** (32 * limb) add up to them."""
    for cluster, row in enumerate(sums):
        for at, total in enumerate(row):
            sign, rest, limb = (1 if total >= 0 else -1), abs(total), 0
            while rest:
                yield cluster, at, limb, sign * (rest & 0xFFFFFFFF)
                rest, limb = rest >> 32, limb + 1


def _round(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the means of what is nearest to each; centroids without vectors stay."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus, sums = Annulus(centroids), [[0] * (dim + 1) for _ in range(k)]
        for batch in batches:
            for _, v in _vectors(batch):
                cluster, _, _ = annulus.nearest(v)
                for c in np.unique(cluster).tolist():
                    mine = v[cluster == c]
                    # A block of 4096 small components adds up to a whole double.
                    sums[c] = [a + int(b) for a, b in zip(sums[c], [*mine.sum(axis=0).tolist(), len(mine)], strict=True)]
        rows = list(zip(*_limbs(sums), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [pa.int32()] * 3 + [pa.int64()], strict=True)], [f.split()[0] for f in SUMS.split(", ")])

    found = [[0] * (dim + 1) for _ in range(k)]
    parts = vectors.select("vec_id", "x").mapInArrow(run, SUMS).groupBy("cluster", "at", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    for r in parts.collect():
        found[r.cluster][r["at"]] += int(r.part) << (32 * r.limb)
    return [[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(found, centroids, strict=True)]


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the least hashes, in that order; a null id comes last, repeated ids by their vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    rows = vectors.orderBy(order, "x").limit(clusters).collect()
    return [[int(c) for c in integers(np.array([r.x]))[0]] for r in rows]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable vector, written, and the centroids after so many rounds."""
    stored = written(usable(vectors, dim), "vectors")
    centroids = first_centroids(stored, clusters, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], ASSIGNED), []
    for _ in range(rounds):
        new = _round(stored, centroids)
        if new == centroids:
            break  # whatever rounds are left change nothing
        centroids = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        for batch in batches:
            for part, v in _vectors(batch):
                number, distance, _ = annulus.nearest(v)
                distance = [min(int(d), LONGEST) for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return written(stored.mapInArrow(run, ASSIGNED), "assigned"), centroids


def clusters_of(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors of another length, null ones and those with null or non-finite components give no row; repeated rows and null
    ids give one each. With fewer usable vectors than clusters there are fewer clusters; an empty table gives no rows.
    Distances and inertias over 64 bits are given as the largest 64-bit number; centroids are exact however large the
    components are. Other columns of vectors play no part.
    """
    assigned, centroids = cluster(vectors, clusters, rounds, dim, seed)
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = assigned.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    fits = lambda c: F.least(c, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = assigned.groupBy("cluster").agg(total.alias("own"))
    sums = sums.withColumn("all", F.sum("own").over(Window.partitionBy(F.lit(0)))).select("cluster", fits(F.col("own")).alias("cluster_inertia"), fits(F.col("all")).alias("inertia"))
    # One row a cluster.
    return assigned.join(F.broadcast(sums.join(named, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Rounds unrolled; centroids (c, at, v) by coordinate."""
    near = """SELECT v.id, v.vec_id, v.v, m.c, m.d FROM v JOIN (SELECT id, min_by(c, d * 16 + c) AS c, min(d) AS d FROM
  (SELECT v.id, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN {c} c) GROUP BY id) m USING (id)"""
    steps = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM v ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {CLUSTERS})"""]
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        steps.append(f"""m{i} AS (SELECT c, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY c, place)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.v, o.v) AS v FROM c{i} o LEFT JOIN
  (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM m{i} GROUP BY c) f USING (c))""")
    steps.append(f"a AS MATERIALIZED ({near.format(c=f'c{ROUNDS}')})")
    return (
        ",\n".join(steps)
        + f"""
SELECT a.vec_id, a.c AS "cluster", a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} c USING (c)"""
    )


ORACLE_SQL = _oracle()
