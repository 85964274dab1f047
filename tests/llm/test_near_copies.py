"""Near-duplicate removal of the pipeline against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import brute_components, words

from fleetvane.llm import common, near_copies, simhash


def sets_of(texts):
    return [{" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else {""} for w in (words((t or "").lower()) for t in texts)]


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return sorted(r.doc_id for r in near_copies.keep_one(df).collect())


def test_family_with_few_near_pairs(spark):
    """1,200 versions of a text, in pairs that share 6 of 11 edits; only these are near: no leader is near to most."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(50_000)}" for _ in range(300)]
    texts = []
    for i in range(600):
        at = rng.sample(range(300), 11)
        for side in "xy":
            copy = list(base)
            for k in at:
                copy[k] = f"b{i}.{k}" if k in at[:6] else f"{side}{i}.{k}"
            texts.append(" ".join(copy))
    want = sorted(set(brute_components(sets_of(texts))))
    assert 550 < len(want) < 900 and kept(spark, texts) == want


@pytest.mark.parametrize("rounds", [0, 3])
def test_leaders_change_nothing(spark, rounds):
    rng = random.Random(rounds)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 30, 100]))]
        for _ in range(30):
            copy = [rng.choice(["new", "other", w]) if rng.random() < 0.02 else w for w in base]
            texts.append(" ".join(copy[rng.randrange(3) :] + [f"t{k}" for k in range(rng.randrange(len(copy) // 4 + 1))]))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").withColumn("key", F.col("node").cast("string"))
    got = dict(map(tuple, near_copies.near_components(df, common.written(df.select("node", "key"), "best"), rounds).collect()))
    assert [got.get(i, i) for i in range(len(texts))] == brute_components(sets_of(texts))


def test_passage_that_many_share(spark):
    """A long passage in texts that are otherwise different, at similarities on either side of 0.8, and edges of the threshold."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(100)]
    texts = [" ".join([f"own{i}.{k}" for k in range(rng.randrange(5, 60))] + passage) for i in range(120)]
    for n in (5, 9, 10, 13, 14, 18, 54, 90):  # sets of n shingles, of which each pair has all but some in common
        line = [f"l{n}.{k}" for k in range(n + 4)]
        texts += [" ".join(line[k:]) for k in range(n // 4 + 2)]
    want = sorted(set(brute_components(sets_of(texts))))
    assert 30 < len(want) < len(texts) and kept(spark, texts) == want


def test_rows_and_columns(spark):
    rows = [(None, "one two three", 1), (4, "One  TWO three", 2), (4, "One  TWO three", 2), (9, "", 3), (7, None, 4), (8, " \n", 5), (3, "x " * 5000, 6), (2, "x " * 5000 + "y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int").withColumnRenamed("_key", "node").repartition(3)
    got = near_copies.keep_one(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.node) for r in got.collect()) == [(2, 7), (3, 6), (4, 2), (7, 4)]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_shingle_set():
    assert near_copies.shingle_set(" ").tolist() == [0] and len(near_copies.shingle_set("a b")) == 1
    assert np.array_equal(near_copies.shingle_set("A b c d e f"), near_copies.shingle_set("a  b c\nd e f"))


def test_parities_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (1, 30, 400, 5000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.unique(np.concatenate([x[: n - n // 10], rng.integers(0, 1 << 63, n // 8).astype(np.uint64)]))
        bits = sum(bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1") for a, b in zip(near_copies.parities(x), near_copies.parities(y), strict=True))
        assert bits <= len(np.setxor1d(x, y)) and (bits > 0) == (n > 9)


def test_simhash_finds_links_first(spark, monkeypatch):
    """The stage links fingerprints within operator 5's radius; those links connect what brute force connects, and its groups rest on them."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(900)}" for _ in range(150)]
        texts += [" ".join([*base[:149 - k], f"t{k}", *base[150 - k :]]) for k in range(4)]
    texts += ["a b c", "A  b c d", "", "e " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").withColumn("key", F.col("node").cast("string"))
    fps = [simhash.fingerprint(t, 5) for t in texts]
    near = [(i, j) for j in range(len(fps)) for i in range(j) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= simhash.RADIUS]
    def joined(pairs):
        root = list(range(len(texts)))
        for _ in texts:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root
    found, seen = near_copies.simhash_links(df), []
    assert near and joined([tuple(r) for r in found.collect()]) == joined(near)
    plain = near_copies.simhash_links
    monkeypatch.setattr(near_copies, "simhash_links", lambda docs: seen.append(1) or plain(docs))
    got = dict(map(tuple, near_copies.near_components(df, common.written(df.select("node", "key"), "best")).collect()))
    assert seen and [got.get(i, i) for i in range(len(texts))] == brute_components(sets_of(texts))
