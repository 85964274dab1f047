"""Operator 5: near duplicates by SimHash, with the generalised pigeonhole principle.

Distinct fingerprints stand for their documents. Their 64 bits are dealt into m partitions that gather correlated bits.
If the thresholds of the partitions add up to at least radius - m + 1, any two fingerprints within the radius agree in
some partition up to its threshold (-1: never probed), so thresholds may be unequal: a dynamic program picks them, and m,
by the candidates and probes that they are estimated to cost. Probing a partition looks up all values within its
threshold; candidates are verified by their Hamming distance.

A bucket with too many fingerprints is not expanded into pairs. Its fingerprints are linked through common neighbours
instead, by keys whose number grows with the fingerprints: two lie within radius r + s of each other just if some value is
within r of one and within s of the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvane.llm.common import by_slices, texts_of, written
from fleetvane.llm.components import components

RADIUS, SHINGLE_WORDS, BITS = 3, 3, 64
#: Partition counts that the dynamic program chooses from.
PARTS = (3, 4)
#: Buckets with more fingerprints than this are linked through common neighbours (2,146 keys each) and not by pairs.
DENSE = 4096
#: Cost of a probe (a row that is shuffled) in verified candidates.
PROBE_COST = 1.0
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash over the XXH64 (seed 42) of all word shingles of text with A-Z in lower case; 0 without words."""
    words = _words(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    buffer = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle_words, len(words)) - 1
    n = len(words) - k
    shingles = map(buffer.__getitem__, map(slice, starts[:n].tolist(), ends[k:].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every document; null texts are empty."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = pa.array([fingerprint(t, shingle_words) for t in texts_of(batch, "text")], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

        return each

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_slices(256, make), "doc_id long, fp long")


def _bit_counts(distinct: DataFrame) -> np.ndarray:
    """64 x 64: of how many fingerprints bits i and j are both set. Tasks send 64 rows each to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            v = np.asarray(batch.column(0)).astype("<i8")
            for i in range(0, len(v), 8192):
                bits = np.unpackbits(v[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS)), pa.array(list(total), pa.list_(pa.float64()))], ["bit", "ones"])

    sums = distinct.select("fp").mapInArrow(run, "bit long, ones array<double>").groupBy("bit").agg(F.array(*[F.sum(F.col("ones")[j]) for j in range(BITS)]).alias("ones"))
    out = np.zeros((BITS, BITS))
    for bit, ones in sums.collect():
        out[bit] = ones
    return out


def group_bits(ones: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Equal groups of bits; each starts with the two most correlated bits that are left and takes the bit most correlated with it."""
    p = np.diag(ones) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((ones / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for g in range(parts):
        size = BITS * (g + 1) // parts - BITS * g // parts
        c = corr[np.ix_(left, left)]
        i, j = np.unravel_index(np.argmax(c), c.shape)
        group = [left[i], left[j]] if i != j else left[:2]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def allocate(candidates: list[list[float]], probes: list[list[float]], total: int, radius: int = RADIUS) -> tuple[float, list[int]]:
    """Thresholds, one per partition and -1 at least, that add up to total at the least cost. candidates and probes: by partition, then by threshold from 0."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c, p in zip(candidates, probes, strict=True):
        new: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                more = 0.0 if t < 0 else c[t] + PROBE_COST * p[t]
                if done + t not in new or cost + more < new[done + t][0]:
                    new[done + t] = (cost + more, [*chosen, t])
        best = new
    return best[total]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _xor_each(fp: Column, bits: list[int], within: int) -> Column:
    """The array of fp with up to so many of these bits changed."""
    masks = [_mask(c) for k in range(within + 1) for c in combinations(bits, k)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: fp.bitwiseXOR(m))


def _keyed(part: int, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(part).alias("part"), v.alias("value")))


def plan(distinct: DataFrame) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, from counts over all distinct fingerprints."""
    n = distinct.count()
    ones = _bit_counts(distinct)
    groups = {m: group_bits(ones, n, m) for m in PARTS}
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("part"), F.col("fp").bitwiseAND(_mask(bits)).alias("value")) for m, g in groups.items() for i, bits in enumerate(g)])
    counts = distinct.select(F.explode(keys).alias("k")).groupBy("k").count()
    squares = {(r.m, r.part): r.pairs for r in counts.groupBy(F.col("k.m").alias("m"), F.col("k.part").alias("part")).agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(ones) / max(n, 1)
    odds = np.clip(2 * p * (1 - p), 1e-6, 0.5) / (1 - np.clip(2 * p * (1 - p), 1e-6, 0.5))  # of two values differing in a bit
    best = None
    for m, g in groups.items():
        candidates, probes = [], []
        for i, bits in enumerate(g):
            e = np.zeros(RADIUS + 1)
            e[0] = 1
            for b in bits:  # elementary symmetric polynomials: odds that just k bits differ
                e[1:] += e[:-1].copy() * odds[b]
            candidates.append([(squares.get((m, i), 0.0) + 1) * float(e[: t + 1].sum()) for t in range(RADIUS + 1)])
            probes.append([float(n) * sum(comb(len(bits), k) for k in range(t + 1)) for t in range(RADIUS + 1)])
        cost, thresholds = allocate(candidates, probes, RADIUS - m + 1)
        if best is None or cost < best[0]:
            best = (cost, g, thresholds)
    return best[1], best[2]


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def links(distinct: DataFrame, groups: list[list[int]], thresholds: list[int], dense: int = DENSE) -> DataFrame:
    """(a, b), a < b, distinct: enough of the pairs of fingerprints within the radius to connect all of them; outside dense buckets, all of them."""
    probed = [(i, bits, t) for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    stored = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_mask(bits)).alias("value")) for i, bits, _ in probed])).alias("k")).select("fp", "k.part", "k.value")
    sizes = stored.groupBy("part", "value").count().where(f"count > {dense}").drop("count")
    full = written(sizes, "dense")
    crowded = full.take(1) != []
    sparse = stored.join(full, ["part", "value"], "left_anti") if crowded else stored
    probes = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(*[_keyed(i, _xor_each(F.col("fp").bitwiseAND(_mask(bits)), bits, t)) for i, bits, t in probed])).alias("k")).select("a", "k.part", "k.value")
    found = probes.join(sparse.withColumnRenamed("fp", "b"), ["part", "value"]).where((F.col("a") < F.col("b")) & _close("a", "b")).select("a", "b")
    if crowded:
        # Whoever probes a dense bucket or lies in it: every pair that such a bucket holds is among these.
        inside = written(probes.join(full, ["part", "value"]).select(F.col("a").alias("fp")).distinct(), "inside")
        every = list(range(BITS))
        near = inside.select(F.col("fp").alias("b"), F.explode(_xor_each(F.col("fp"), every, RADIUS // 2)).alias("z")).groupBy("z").agg(F.min("b").alias("b"))
        reached = inside.select(F.col("fp").alias("a"), F.explode(_xor_each(F.col("fp"), every, RADIUS - RADIUS // 2)).alias("z"))
        found = found.union(reached.join(near, "z").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.distinct()


def groups_of(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """fps, a written table of (doc_id, fp) and maybe more, with component (a fingerprint) and component_id.

    component_id is the smallest doc_id reachable over links, the document's own included. Documents without a doc_id
    take part in links by their fingerprint; component_id is null only if no document of the component has an id.
    """
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    groups, thresholds = plan(distinct)
    linked = written(components(links(distinct, groups, thresholds, dense)), "components")
    comp = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = comp.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(comp.join(least, "component").select("fp", "component", "component_id"), "fp")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, repeated rows included; empty and null texts share fingerprint 0."""
    out = groups_of(written(fingerprints(docs), "fps"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
