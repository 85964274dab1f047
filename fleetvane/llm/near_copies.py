"""Near duplicates at a Jaccard similarity of 0.8 or more on sets of five-word shingles: by SimHash, and exact.

Every text gets operator 5's fingerprint, over five-word shingles. Fingerprints are linked by that operator's partitions and
thresholds, and a link counts if the two texts' sets are near. No radius finds all pairs at such a threshold, so an exact
step finds the rest: it compares shingle sets, and leaves out only what provably can't matter:

* Of two sets of sizes n and m at 0.8, each has at most a fifth of its shingles outside the other. A text with more
  than n / 5 shingles that no other text has is near to none; a quarter of the hash space suffices to see that of most.
* Among what is left, shingles are ordered by how many texts have them. Two near sets share one among the n - ceil(4n/5) + 1
  rarest of the larger and the m - ceil(8m/9) + 1 rarest of the smaller one; where that is, and the sizes, bound how much
  they can have in common. All other pairs that meet there are verified by their whole sets.

Only links matter, so texts that are connected already are not compared again: first every text of a bucket (a rare
shingle's texts) is held against one leader, a few times with other leaders, which connects large families in steps that are
linear in their sizes. Then all pairs of a bucket that are still unconnected and pass the bounds are verified; parities of
whole sets bound there how much two differ in. The leaders change the work, never the result.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.llm import simhash
from fleetvane.llm.common import by_slices, free_name, give_back, texts_of, written
from fleetvane.llm.components import components

NEAR_WORDS = 5
#: Hashes below this are the quarter of them in which a text's own shingles are counted first.
QUARTER = 1 << 62
#: Rounds with leaders before all unconnected pairs of a bucket are compared.
LEADER_ROUNDS = 3
#: Turns in which a text's candidates are compared, those that it meets most often first.
TURNS = ("turn = 1", "turn between 2 and 4", "turn > 4")
#: Rows of keys (some 40 bytes each) up to which they are broadcast; beyond, they are joined by shuffle.
MOST_BROADCAST_KEYS = 400_000
#: Bits of a set's parities.
PARITIES = 512
_P = [f"p{i}" for i in range(PARITIES // 64)]
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


def shingle_set(text: str, shingle_words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles of text with A-Z in lower case; all words are one shingle if there are fewer, and texts without words share the shingle 0."""
    words = _words(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(1, np.uint64)
    n = max(len(words) - shingle_words + 1, 1)
    shingles = (b" ".join(words[i : i + shingle_words]) for i in range(n))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n))


def row_key() -> Column:
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).cast("string"))


def _small(df: DataFrame) -> DataFrame:
    """df, a written table of keys, to be broadcast if it is small enough by count."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_KEYS else df


def loners(docs: DataFrame) -> DataFrame:
    """(node) of texts of which more than a fifth of the shingles are their own, as far as a quarter of the hash space shows. docs: (node, text), repeats included."""

    def make():
        give_back()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, hashes, sizes = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                found = shingle_set(text)
                few = found[: int(np.searchsorted(found, QUARTER))]
                hashes.append(few)
                nodes.append(np.full(len(few), node, np.int64))
                sizes.append(np.full(len(few), len(found), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(sizes))], ["node", "h", "n"])

        return each

    hashes = docs.select("node", "text").mapInArrow(by_slices(256, make), "node long, h long, n long")
    own = hashes.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.max("n").alias("n")).where("node = other")
    return own.groupBy("node").agg(F.count("*").alias("own"), F.max("n").alias("n")).where("5 * own > n").select("node")


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITIES bits, of how many shingles each stands for an odd number, as signed 64-bit numbers. Two sets differ in at least as many shingles as their parities differ in bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles, p0, p1, ...), written; rows of one node have the same text."""

    def make():
        give_back()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(map(shingle_set, texts_of(batch, "text")))
            bits = np.array(list(map(parities, found)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *[pa.array(bits[:, i]) for i in range(len(_P))]], ["node", "shingles", *_P])

        return each

    schema = "node long, shingles array<long>, " + ", ".join(f"{p} long" for p in _P)
    return written(docs.select("node", "text").mapInArrow(by_slices(256, make), schema).dropDuplicates(["node"]), "shingles")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(node, n, shared) of the sets that can be near another, written: how many shingles they have, and those that other sets have too, the rarest first."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    lists = each.join(often, "h").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "h"))).alias("shared"))
    return written(lists.where(5 * F.size("shared") >= 4 * F.col("n")).select("node", "n", F.col("shared.h").alias("shared")), "shared")


def prefixes(lists: DataFrame) -> DataFrame:
    """(node, n, h, place, indexed), written: the shingles by which a text finds others, their places in its whole order, and whether it can be found by them as the smaller of two."""
    own = F.col("n") - F.size("shared")
    probed, indexed = F.expr("n - (4 * n + 4) div 5 + 1"), F.expr("n - (8 * n + 8) div 9 + 1")
    rows = lists.select("node", "n", own.alias("own"), indexed.alias("to"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(probed - own, F.lit(0)).cast("int"))).alias("i", "h"))
    place = F.col("own") + F.col("i")
    return written(rows.select("node", "n", "h", place.alias("place"), (place < F.col("to")).alias("indexed")), "prefixes")


def _can(a: str, b: str) -> Column:
    """Whether two sets whose first common shingle is this one can be near."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    common = F.least(n - F.col(f"{a}place"), m - F.col(f"{b}place"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * common >= 4 * (n + m))


def near_pairs(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b), of a written table, whose sets have a Jaccard similarity of 0.8 or more."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    ends = F.broadcast(ends) if pairs.count() <= MOST_BROADCAST_KEYS // 2 else ends
    both = lists.join(ends, "node").groupBy("a", "b").agg(F.collect_list(F.struct("n", "shared")).alias("s"))
    common = F.size(F.array_intersect(F.col("s")[0]["shared"], F.col("s")[1]["shared"]))
    return both.where(9 * common >= 4 * (F.col("s")[0]["n"] + F.col("s")[1]["n"])).select("a", "b")


def simhash_links(docs: DataFrame) -> DataFrame:
    """(a, b), a < b, written: nodes of texts whose fingerprints over five-word shingles are within operator 5's radius. docs: (node, text).

    Texts of one fingerprint are linked to the least of them, which stands for all in links to other fingerprints.
    """
    prints = simhash.fingerprints(docs.select(F.col("node").alias("doc_id"), "text"), NEAR_WORDS).groupBy(F.col("doc_id").alias("node")).agg(F.first("fp").alias("fp"))
    prints = written(prints, "prints")
    first = written(prints.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = prints.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(k), F.col("first").alias(f"of_{k}")) for k in "ab"]
    between = simhash.links(first, *simhash.plan(first)).join(ends[0], "a").join(ends[1], "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return written(same.union(between).distinct(), "simhash-links")


def _joined(state: DataFrame, found: DataFrame) -> DataFrame:
    """state (node, component) after the links found, written."""
    ends = [state.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"]
    edges = found.join(ends[0], "a").join(ends[1], "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).where("a <> b").distinct()
    merged = components(edges).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return written(state.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "state")


def near_components(docs: DataFrame, best: DataFrame, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(node, component) of the texts that may be near another; component is the least node reachable. docs: (node, key, text); best: (node, key), written, a row of each text."""
    maybe = written(best.join(loners(docs), "node", "left_anti"), "maybe")
    sets = shingle_sets(docs.join(_small(maybe.select("key")), "key", "left_semi"))
    lists = shared_shingles(sets)
    entries = prefixes(lists)
    state = written(lists.select("node", F.col("node").alias("component")), "state")
    of = [state.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"]
    close = written(simhash_links(docs).join(of[0], "a").join(of[1], "b").select("a", "b"), "close")
    if close.take(1):
        state = _joined(state, written(near_pairs(close, lists), "links"))
    unordered = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    def mixed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The entries with components; the buckets that hold more than one."""
        rows = rows.join(state, "node")
        return rows, rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("indexed").alias("found")).where("low <> high and found")

    for r in range(leader_rounds):
        rows, _ = mixed(entries)
        rank = F.col("node") if r == 0 else F.xxhash64("h", "node", F.lit(r))
        leader = F.min(F.when(F.col("indexed"), F.struct(rank.alias("rank"), "node", "n", "place", "component"))).alias("leader")
        led = rows.groupBy("h").agg(leader, F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high and leader is not null")
        met = rows.join(led.select("h", "leader"), "h").where((F.col("component") != F.col("leader.component")) & _can("", "leader."))
        pairs = written(met.select("node", F.col("leader.node").alias("other")).select(*unordered).distinct(), "pairs")
        if not pairs.take(1):
            break
        state = _joined(state, written(near_pairs(pairs, lists), "links"))

    rows, buckets = mixed(entries)
    rows = rows.join(buckets.select("h"), "h", "left_semi")
    rows = written(rows.join(sets.select("node", *_P), "node"), "unconnected")
    x, y = rows.alias("x"), rows.where("indexed").alias("y")
    apart = F.expr("x.h = y.h and x.component <> y.component and (y.n < x.n or y.n = x.n and y.node < x.node)")
    differ = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in _P), F.lit(0))
    met = x.join(y, apart & _can("x.", "y.") & (9 * differ <= F.col("x.n") + F.col("y.n"))).select(F.col("x.node").alias("node"), F.col("y.node").alias("other")).select(*unordered).groupBy("a", "b").agg(F.count("*").alias("times"))
    pairs = written(met.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy(F.col("times").desc(), "b"))), "pairs")
    for turn in TURNS:
        of = [state.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab"]
        left = written(pairs.where(turn).join(of[0], "a").join(of[1], "b").where("of_a <> of_b").select("a", "b"), "left")
        if left.take(1):
            state = _joined(state, written(near_pairs(left, lists), "links"))
    return state


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one of each group of near duplicates: that with the smallest doc_id (null last), then the least hash of its text.

    Near duplicates have a Jaccard similarity of 0.8 or more on sets of five-word shingles; groups are what such pairs
    connect. Texts without words (null, empty, white space) are one group. Of rows that repeat both doc_id and text one
    stays. Texts and shingles are told apart by 64-bit hashes: among 1e9 different texts, two are taken for equal with a
    chance of 1 in 37. An empty table gives no rows.
    """
    node, key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), free_name(docs, "_key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), node.alias("node"))
    best = written(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row")), "texts")
    groups = near_components(docs.select(node.alias("node"), row_key().alias("key"), "text"), best.select("node", "row.key"))
    kept = best.join(groups, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("row").alias("row")).select(F.col("row.key").alias(key))
    return docs.withColumn(key, row_key()).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
