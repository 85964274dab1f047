"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from test_ops import DOCS, ODD, crc

from fleetvane.llm import centroids, common, complement_packing, divergence
from fleetvane.llm.tokens import tokenizer_path


def slow_divergence(rows, top, least):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, t) for la, s, t in found if la == lang]
        df, total, by = Counter(), Counter(), {s: Counter() for s, _ in mine}
        for s, t in mine:
            df.update(set(t))
            total.update(t)
            by[s].update(t)
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(total), {s: share(c) for s, c in by.items()}
        for s in by:
            pairs = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in by if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, p[s][t] - q[t]) for t in kept if by[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, s, part, item, v, i + 1) for part, found_ in (("pair", pairs), ("term", terms)) for i, (item, v) in enumerate(found_)]
    return sorted(out)


@pytest.mark.parametrize("few", [1, 4096])
def test_source_divergence(spark, few):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abçdß世" for b in "xyzé界"] + ["Same", "SAME", "don't", "a1b", " ", "é" * 40, "é" * 40 + "z"]
    rows = [(rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for _ in range(160)]
    rows += [("en", "empty", None), ("en", "empty", ""), ("fr", "only", "rare"), ("fr", "two", "1 2"), ("it", "alone", "x x"), ("de", "s1", "long " * 4000)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, rank int").repartition(3)
    got = sorted(map(tuple, divergence.source_divergence(df, top=7, least_docs=3, few=few).collect()))
    want = slow_divergence(rows, 7, 3)
    assert got == want and {r[2] for r in want} == {"pair", "term"} and any(r[5] == 7 for r in want if r[2] == "term")
    assert divergence.source_divergence(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [2, 50])
def test_radix_top_with_ties(spark, few):
    rng = random.Random(8)
    rows = [("g", "h" * (i % 3), rng.choice([0, 5, 5, 5, 5, 1 << 20, (1 << 20) + 1, 1 << 40]), "p" * rng.randrange(6) + rng.choice(["", "\x00", "q", "é"]) + str(rng.randrange(30))) for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, v long, item string")
    got = sorted(map(tuple, divergence.radix_top(df, ["a", "b"], "v", "item", 120, few).collect()))
    want = []
    for b in ("", "h", "hh"):
        want += sorted((r for r in rows if r[1] == b), key=lambda r: (-r[2], r[3].encode()))[:120]
    assert got == sorted(want)
    assert divergence.radix_top(df, ["a", "b"], "v", "item", 1000, few).count() == 900


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("kind", ["log", "uniform", "short", "one", "mixed"])
def test_plan(kind):
    rng = np.random.default_rng(3)
    lengths = {"log": lambda: np.clip(np.exp(rng.normal(5.5, 1.3, 3000)), 1, 512), "uniform": lambda: rng.integers(1, 513, 900), "short": lambda: rng.integers(1, 9, 9000), "one": lambda: np.full(1000, 171), "mixed": lambda: np.concatenate([np.ones(5000), np.full(9, 511), [512]])}[kind]().astype(int)
    counts = np.bincount(lengths, minlength=513)
    planned, used = complement_packing.plan(counts, 512), np.zeros(513, int)
    for times, chosen in planned:
        assert times > 0 and sum(k * v for k, v in chosen.items()) <= 512
        for length, n in chosen.items():
            used[length] += n * times
    assert (used == counts).all()
    n = sum(times for times, _ in planned)
    assert -(-lengths.sum() // 512) <= n <= best_fit_decreasing(lengths.tolist(), 512)


def test_exact_complements():
    """Gaps that only just one pair or triple fills are filled by it."""
    lengths = [900, 60, 40, 800, 111, 50, 39, 700, 300]
    assert len(lengths) == sum(sum(c.values()) for _, c in complement_packing.plan(np.bincount(lengths, minlength=1001), 1000))
    full = [c for _, c in complement_packing.plan(np.bincount(lengths, minlength=1001), 1000)]
    assert sorted(sum(k * v for k, v in c.items()) for c in full) == [1000, 1000, 1000]
    index = complement_packing.Complements(np.bincount([5, 5, 7, 9], minlength=30))
    assert [index.pairs[s] for s in (10, 12, 14, 16)] == [1, 1, 1, 1] and index.exact(14, 3) == (9, 5) and index.exact(18, 3) is None and index.exact(19, 3) == (9, 5, 5)
    index.take({5: 1}, 1)
    assert index.pairs[10] == 0 and index.exact(19, 3) is None and index.exact(21, 3) == (9, 7, 5)


def test_pack_best_fit(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    rows = [(i, x, None, "x") for i, x in enumerate(ODD)] + [(3, "a", "en", "y"), (None, "no id here", None, None)] + [(100 + i, None, "", "") for i in range(300)]
    real = [(10**6 + r.doc_id, r.text, "", "") for r in common.table(spark, SF, "documents").collect()]
    df = spark.createDataFrame(rows + real, DOCS).withColumnRenamed("ids", "length").repartition(3)
    pieces = complement_packing.pack_best_fit(df).collect()
    ids = Counter()
    for i, text, *_ in rows + real:
        x = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        ids.update((i, k, at, len(x[at : at + 4096]), crc(x[at : at + 4096])) for k, at in enumerate(range(0, len(x), 4096)))
    assert ids == Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) and any(p.piece == 1 for p in pieces)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert len(by_sequence) <= best_fit_decreasing([p.length for p in pieces], 4096)
    assert complement_packing.pack_best_fit(df.limit(0)).count() == 0


def slow_clusters(rows, clusters, rounds, dim):
    kept = [(i, [int(c * 1024 // 1) if abs(c) < 2**53 else int(c) * 1024 for c in x]) for i, x in rows if x is not None and len(x) == dim and all(c is not None and np.isfinite(c) for c in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        centers = [[sum(x) // len(x) for x in zip(*mine, strict=True)] if (mine := [v for (_, v), a in zip(kept, at, strict=True) if a == k]) else c for k, c in enumerate(centers)]
    found = [(i, *nearest(v)) for i, v in kept]
    most, total = 2**63 - 1, sum(min(d, 2**63 - 1) for _, d, _ in found)
    return sorted(((i, k, min(d, most), min(most, sum(min(e, most) for _, e, m in found if m == k)), min(most, total), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for i, d, k in found), key=str)


@pytest.mark.parametrize("kind", ["plain", "ties", "large"])
def test_clusters(spark, kind):
    rng = random.Random(6)
    rows = [(rng.randrange(200), [rng.choice([-0.001, 0.0, 0.5, -2.0, 0.25]) if kind == "ties" else rng.gauss(0, 1) * (30 if i % 3 else 1) for _ in range(4)]) for i in range(150)]
    rows += rows[:9] + [(None, [1.0] * 4), (None, None), (7, [1.0] * 3), (8, [1.0, None, 1.0, 1.0]), (9, [float("nan")] * 4), (10, [float("-inf")] + [0.0] * 3), (11, [])]
    rows += [(300, [1e306, -1e306, 5.0, 2.0**53 + 2]), (301, [1e30, 3e4, -3e4, 5e3]), (302, [-1e19, 1e19, 0.1, -0.1])] if kind == "large" else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", df_one()).repartition(3)
    got = sorted(map(tuple, centroids.clusters_of(df, clusters=5, rounds=4, dim=4).collect()), key=str)
    assert got == slow_clusters(rows, 5, 4, 4)
    assert centroids.clusters_of(df.limit(0)).count() == 0 and centroids.clusters_of(df.limit(2), dim=4).count() <= 2


def df_one():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_annulus_leaves_centroids_out():
    rng = np.random.default_rng(1)
    centers = [[int(c) for c in row] for row in rng.normal(0, 1, (40, 6)) * np.linspace(1, 4000, 40)[:, None]]
    v = np.floor(np.array(centers)[rng.integers(0, 40, 500)] + rng.normal(0, 5, (500, 6)))
    cluster, distance, made = centroids.Annulus(centers).nearest(v)
    all_distances = ((v[:, None, :] - np.array(centers, float)[None]) ** 2).sum(axis=2)
    assert (cluster == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all() and made < 500 * 40 / 2


def test_top_products_of_enormous_components(spark):
    from fleetvane.llm import topk

    rows = [(0, [1e306, 1.0]), (1, [2.0, 0.0]), (2, [-1e306, 3.0]), (3, [0.0, 1.0]), (100, [0.0, 2.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()}
    assert got == {(0, 1): (1, 2**63 - 1), (0, 2): (100, 2 * 1024**2), (100, 1): (2, 6 * 1024**2), (100, 2): (0, 2 * 1024**2)}
