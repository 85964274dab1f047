"""The corpus operators against brute force, round trips and planted cases."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fleetvane.llm import chat, common, merge_automaton, near_copies, packing, quality_rules, simhash, token_orc, topk, toxicity, warc, wrappers
from fleetvane.llm.tokens import SpacedEncoder, WordEncoder, chunk_encoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, ids string"
ODD = [None, "", " \n\t ", "a", "x" * 30_000, "naïve  text　wide\x85line", "<|endoftext|> [INST]", "don't  STOP 123 ééé", "word " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "x") for i, t in enumerate(ODD)] + [(3, "a", "en", "y"), (None, "no id here", None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    def get(name):
        t = Tokenizer.from_file(tokenizer_path(name))
        t.no_truncation()
        t.no_padding()
        return t

    return get


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_orc(spark, docs, library):
    t = library("word_bpe_49k.json")
    got = sorted(map(tuple, token_orc.token_orc(spark, docs).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()), r[1]))
    start, want = 0, []
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_word_encoders(library):
    path = tokenizer_path("word_bpe_49k.json")
    texts = [*(t or "" for t in ODD), "ÀÉÎÖ÷×ß ÿŸ don't'S 12ab", "Σας ΟΔΟΣ İstanbul ﬁ e\u0301", "<|endoftext|>x<|startoftext|> <|EndOfText|>", "²³½ª é\x00a\x7fb\u200d \U0001f600"]
    want = [library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids for t in texts]
    for encoder in (chunk_encoder(path, False), merge_automaton.automaton_encoder(path)):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
        assert got == want


@pytest.mark.parametrize("make, name", [(WordEncoder, "word_bpe_49k.json"), (SpacedEncoder, "byte_bpe_50k.json")])
def test_repeated_words_are_looked_up_once(library, make, name):
    encoder, asked = make(tokenizer_path(name), 50_000), []
    texts = ["some words, some more Words " * 300, "", " some words\tünd 日本日本 日本、日本 " * 200, " ", "x"]
    want = [library(name).encode(t, add_special_tokens=False).ids for t in texts]
    for recent in (encoder.chunks, encoder.words):
        recent.values = lambda keys, values=recent.values: asked.append(len(keys)) or values(keys)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == want and sum(asked) < 100
    rare = [" ".join(f"w{i * 97 % 1000}é" for i in range(k, k + 400)) for k in range(0, 4000, 200)]  # more words than are remembered
    assert [np.frombuffer(x, "<u4").tolist() for t in rare for x in encoder.encode([t.encode()])] == [library(name).encode(t, add_special_tokens=False).ids for t in rare]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (token_orc.token_orc(spark, none), packing.pack(none), merge_automaton.automaton_round_trip(none), simhash.simhash_components(none), near_copies.keep_one(none), quality_rules.quality_verdicts(none), toxicity.toxicity_scores(none, None), wrappers.main_texts(pages), warc.warc_round_trip(pages), topk.top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert df.count() == 0
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_merge_automaton(docs, library):
    t = library("word_bpe_49k.json")
    got = sorted(map(tuple, merge_automaton.automaton_round_trip(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_packing(spark, docs, library):
    t, pieces = library("byte_bpe_50k.json"), packing.pack(common.table(spark, SF, "documents").select("doc_id", "text").unionByName(docs.where("doc_id < 9").withColumn("doc_id", docs.doc_id + 10**6).select("doc_id", "text").distinct())).collect()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in common.table(spark, SF, "documents").collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, all_ids in ids.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(all_ids) and p.ids_crc32 == crc(all_ids[at : at + p.length])
            at += p.length
        assert at == len(all_ids)
    used = padded = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert used / padded > 0.95


def words(text):
    return [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]


def slow_fingerprint(text):
    import xxhash

    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(200)) for _ in range(6)]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None] + [(100 + i, b) for i, b in enumerate(base)] + [(200 + i, b + " ab") for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect())
    fps = [slow_fingerprint(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    assert got == sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(3)
    rows, i = [], 0
    for n in (60, 150, 400):
        for edits in range(5):  # each changed word changes up to five shingles of five words
            base = [f"w{rng.randrange(3000)}" for _ in range(n)]
            copy = list(base)
            for k in rng.sample(range(n), max(1, n * edits // 200)):
                copy[k] = "edited"
            rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
            i += 2
        cut = rows[-1][1].split()
        rows.append((i, " ".join(cut[: n // 3] + [f"x{k}" for k in range(n // 3)] + cut[n // 3 :])))  # a third more: no near copy
        i += 1
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(set(brute_components(sets)))
    assert len(want) < len(rows) - 8 and sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, SF).collect()) == want


def brute_components(sets):
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]


def test_family_of_near_copies(spark):
    """One text in many versions, of which some are near others and some near none; also texts without words and repeats."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for i in range(150):
        copy = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 6, 9])):
            copy[k] = f"e{i}.{k}"
        texts.append(" ".join(copy))
    texts += ["", None, " ", "one", "one", "one two"]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in (words(t or "") for t in texts)]
    # Texts without words are near one another: their sets are equal.
    want = sorted(set(brute_components(sets)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert 10 < len(want) < 150 and sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == want


@pytest.mark.parametrize("dense", [2, 10**6])
def test_dense_links(spark, dense):
    rng = random.Random(2)
    centers = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centers for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = common.written(spark.createDataFrame([(f,) for f in signed], "fp long"), "t")
    groups, thresholds = simhash.plan(df)
    found = {tuple(r) for r in simhash.links(df, groups, thresholds, dense).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    if dense > 100:
        assert found == want
    parts = [{x} for x in signed]
    for edges in (found, want):
        parent = {x: x for x in signed}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        parts.append(sorted(sorted(y for y in signed if find(y) == r)[0] for r in {find(x) for x in signed}))
    assert parts[-1] == parts[-2]


def test_quality_order_never_changes_verdicts():
    texts = [t or "" for t in ODD] + ["# $ %" * 40, "Same line here\n" * 30, " ".join(f"w{i}" for i in range(80))]
    orders = [list(quality_rules.RULES), list(reversed(quality_rules.RULES))]
    verdicts = [[quality_rules.passes(quality_rules.DocStats(t), o) for t in texts] for o in orders]
    assert verdicts[0] == verdicts[1] and verdicts[0][-1] and sorted(quality_rules.order_rules(texts)) == sorted(quality_rules.RULES)


def test_toxicity():
    rng = random.Random(0)
    clean = ["the", "house", "river", "stone", "green", "table", "window", "garden"]
    bad = ["idiot", "moron", "scumbag"]
    make = lambda n, k: " ".join([rng.choice(clean) for _ in range(n)] + [rng.choice(bad) for _ in range(k)]) + "."
    rows = [(make(20, 0), 0) for _ in range(150)] + [(make(20, 3), 1) for _ in range(80)]
    scorer = toxicity.Scorer(toxicity.fit(rows))
    good, vile = scorer.scores([make(20, 0), "", "garden stone"]), scorer.scores([make(20, 3), "i d i o t and s.c.u.m.b.a.g m o r o n idiot", "id-iot mo-ron the scum-bag"])
    assert good.max() < 0.5 and vile.min() > good.max() and vile[0] > 0.7
    assert toxicity.fit([("a", 0)]) is None and toxicity.words_of("A b\nc") == ["a", "b", ".", "c"] and "idiot" in toxicity.words_of("you i d i o t")


def slow_kernel(a, b):
    def weights(w):
        out = {}
        for i in range(len(w)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(w))):
                for j in range(i + 1, k):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], []) + [toxicity.DECAY ** (k - i + 1)]
        return out

    x, y = weights(a), weights(b)
    norm = lambda v: sum(q * q for qs in v.values() for q in qs) ** 0.5
    common = sum(p * q for s in x.keys() & y.keys() for p in x[s] for q in y[s])
    return common / max(norm(x) * norm(y), 1e-9)


def test_kernel_by_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_KERNEL", 0.0)
    marks = ["idiot", "scumbag", "идиот", "白痴白痴", "aaaa"]
    words = ["idiot", "i.d.i.o.t", "idiom", "scum", "скотина", "идиоты", "白痴", "白痴!白痴", "aa", "aaaaaa", "x" * 50, "😀😀😀"]
    want = [[slow_kernel(w, m) ** toxicity.POWER for m in marks] for w in words]
    assert np.allclose(toxicity.Landmarks(marks).kernel(words), want, atol=1e-5)


def test_keep_harmless_rows(spark):
    rows = [(i, f"the green garden stone {i}." if i % 2 else "you idiot moron.") for i in range(60)]
    model = toxicity.fit([(t, 1 - i % 2) for i, t in rows])
    docs = spark.createDataFrame([*rows, *rows[:4], (None, "the stone."), (90, None), (91, "you idiot moron.")], "doc_id long, text string").withColumn("score", F.lit(9))
    kept = toxicity.keep_harmless(docs, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted([(False, i) for i, _ in [*rows, *rows[:4]] if i % 2] + [(True, 0), (False, 90)]) and {r.score for r in kept} == {9}
    scores = toxicity.toxicity_scores(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)


def test_quality_rows(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "too short"
    docs = spark.createDataFrame([(1, good), (1, good), (None, good), (2, bad), (3, None), (4, ""), (5, good + " ##$$%%" * 10), (6, "same line\n" * 40)], "doc_id long, text string").withColumn("kept", F.lit("x"))
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect() if quality_rules.passes(quality_rules.DocStats(r.text or ""), list(quality_rules.RULES)))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in quality_rules.keep_good(docs).collect()) == want == [(False, 1), (False, 1), (True, 0)]
    verdicts = quality_rules.quality_verdicts(docs).collect()
    assert len(verdicts) == 8 and sum(v.kept for v in verdicts) == 3
    seen = []
    rules = {"never": lambda d: False, "costly": lambda d: seen.append(1) or True}
    assert not quality_rules.passes(quality_rules.DocStats(good), ["never", "costly"], rules) and not seen


def test_chat_parts(spark):
    none = {"text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    part = lambda kind, **more: {**none, "type": kind, **more}
    rows = [
        (1, 0, "user", [part("text", text="look <|image:1|> "), part("image", ref="a.png", width=448, height=10), part("text", text="and"), part("audio", ref="b", seconds=1.5)]),
        (1, 1, "assistant", [part("text", text="</s> fine")]),
        (1, 2, "user", [part("document", ref="c", pages=2), None, part("image", ref=None)]),
        (2, None, None, None),
        (2, 5, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumn("first", F.lit("clash")).repartition(3)
    got = {(r.conv_id, r.turn): r for r in chat.format_conversations(df).collect()}
    assert [a["number"] for k in sorted(k for k in got if k[0] == 1) for a in got[k].attachments] == [1, 2, 3, 4]
    assert [a["tokens"] for k in sorted(k for k in got if k[0] == 1) for a in got[k].attachments] == [128, 38, 1024, 64]
    role, parts = chat.read_parts(got[1, 0].formatted, [a.asDict() for a in got[1, 0].attachments])
    assert role == "user" and [(p["type"], p.get("text") or p.get("ref")) for p in parts] == [("text", "look <|image:1|> "), ("image", "a.png"), ("text", "and"), ("audio", "b")]
    assert chat.read_parts(got[1, 1].formatted, [])[1] == [{"type": "text", "text": "</s> fine"}]
    assert got[2, None].formatted == "<||>\n</s>\n" and not got[2, 5].attachments


def test_tiers_and_step_groups(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "word " * rng.choice([3, 40, 200, 300, 700, 1500, 5000])) for i in range(400)], "doc_id long, text string").repartition(2)
    pieces = packing.pack(docs).collect()
    tier_of, used, groups = {}, {}, {}
    for p in pieces:
        assert tier_of.setdefault(p.sequence_id, p.tier) == p.tier and p.tier in packing.TIERS
        used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
        groups.setdefault((p.tier, p.step_group), set()).add(p.sequence_id)
    assert all(used[s] <= t for s, t in tier_of.items()) and sum(used[s] < t for s, t in tier_of.items()) <= 2
    assert len({t for t in tier_of.values()}) > 1
    for tier in {t for t, _ in groups}:
        sizes = sorted((sum(used[s] for s in g) for (t, _), g in groups.items() if t == tier), reverse=True)
        assert all(s == packing.STEP_TOKENS for s in sizes[:-2]) and max(sizes) <= packing.STEP_TOKENS


def test_reading_by_id_prunes(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit("some words to encode") for _ in range(4)], F.col("id").cast("string")).alias("text")).repartition(3)
    token_orc.token_orc(spark, docs, str(tmp_path / "t")).collect()
    found = token_orc.read_token_orc(spark, str(tmp_path / "t"), [7, 2500])
    assert sorted(r.doc_id for r in found.collect()) == [7, 2500]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    import pyarrow.orc as orc

    files = [orc.ORCFile(p) for p in (tmp_path / "t").glob("part-*.orc")]
    assert all(f.row_index_stride == 1000 and f.nstripes for f in files if f.nrows)
    # Without Bloom filters the same rows take less.
    size = lambda d: sum(p.stat().st_size for p in (tmp_path / d).glob("part-*.orc"))
    spark.read.orc(str(tmp_path / "t")).write.options(**{k: v for k, v in token_orc.ORC.items() if "bloom" not in k}).orc(str(tmp_path / "plain"))
    assert size("plain") < size("t")


def test_held_out_accuracy(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    s = toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id")
    r = s.selectExpr("sum(predicted * toxic) / sum(toxic) as recall", "sum(predicted * toxic) / sum(predicted) as precision").first()
    # Some 300 toxic documents to learn from; of those held out, one in sixteen holds no insult at all.
    assert r.recall > 0.9 and r.precision > 0.9


def test_absent_documents_use_up_no_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 4)
    monkeypatch.setattr(toxicity, "SAMPLE_HARMLESS", 4)
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, "you idiot moron." if i % 2 else "the green garden stone.") for i in ids[-40:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "Model", lambda *a: seen.append(a) or a)
    assert toxicity.train(docs, labels) and {w for w in seen[0][0]} & {"idiot", "moron"}
    with pytest.raises(ValueError):
        toxicity.keep_harmless(docs, toxicity.train(docs, labels.where("toxic = 0")))


PAGE = "<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><ul><li><a>Home</a></li><li><a>More</a></li></ul></nav><div class='ad'>Buy</div>{0}<footer>&copy; x</footer>"


def test_wrappers(spark):
    one = PAGE.format("<article><h1>A &amp; B</h1><p><b>Bold<i>ly</i><br><p>x  y\n z</p><div class='comments'>no</div><form>no</form></article>")
    two = PAGE.format("<article><h1>T</h1><p>p1</p></article>")
    rows = [(1, "http://h/1", one), (2, "http://h/2", two), (2, "http://h/2", two), (3, None, None), (None, "x", "plain &lt;text&gt;"), (4, "http://k/1", "<div>" * 400 + "deep")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted([("1", "A & B Boldly x y z", 18), ("2", "T p1", 4), ("2", "T p1", 4), ("3", "", 0), ("None", "plain <text>", 12), ("4", "deep", 4)])


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body class='right-sidebar'><p>a</p></body>", "a"),
        ("<body><main class='has-header'><p>a</p></main></body>", "a"),
        ("<body><article class='post share'>a</article></body>", "a"),
        ("<body><div class='widget'><article>a</article></div><div class='widget'>b</div></body>", "a"),
        ("<p style='overflow:hidden'>a</p><p title='a hidden place'>b</p><p aria-hidden='false'>c</p>", "a b c"),
        ("<p><a href='/x?id=search'>a</a></p>", "a"),
        ("<div data-x='class' class='nav'>menu</div><p>a</p>", "a"),
        ("<p hidden>no</p><p HIDDEN=''>no</p><p class=nav/x>no</p>a", "a"),
    ],
)
def test_wrapper_attributes(page, want):
    assert wrappers.main_text(page) == want


@pytest.mark.parametrize("region", ["article", "main"])
def test_template_text_in_regions(spark, region):
    rows = [(i, f"http://h/{i}", f"<body><{region}><h1>Title {i}</h1><div class='x1'>Read us daily</div>" + f"<p>Text {i}</p>" * (i % 3 + 1) + f"<div><span>Tell a friend</span></div></{region}></body>") for i in range(8)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Title {i}" + f" Text {i}" * (i % 3 + 1) for i in range(8)}


def test_wrapper_alignment():
    make = lambda body: wrappers.wrapper_of(wrappers.parse(f"<body>{body}</body>"))
    pages = [f"<p>Welcome to us</p><h2>t{i}</h2>" + f"<p>x{i}</p>" * (i + 1) + ("<ul><li>a</ul>" if i % 2 else "") for i in range(4)]
    whole = make(pages[0])
    for p in pages[1:]:
        whole = wrappers.align(whole, make(p))
    text = wrappers.to_json(whole)
    assert wrappers.to_json(wrappers.from_json(text)) == text
    parsed = [wrappers.parse(f"<body>{p}</body>") for p in pages]
    numbers = [{x.source: n for n, x in wrappers.placed_texts(items, wrappers.Level(whole))} for items in parsed]
    assert len({n["Welcome to us"] for n in numbers}) == 1 and numbers[1]["a"] == numbers[3]["a"] and set(numbers[2]) == {"Welcome to us", "t2", "x2"}
    assert [wrappers.main_text(f"<body>{p}</body>", text, frozenset([numbers[0]["Welcome to us"]])) for p in pages[1:3]] == ["t1 x1 x1 a", "t2 x2 x2 x2"]
    wild = make("".join(f"<x{i}>a</x{i}>" for i in range(300)))
    assert len(wrappers.align(whole[0].items, wild[0].items)) <= wrappers.MOST_ITEMS


def test_warc(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a/1", long), (2, "http://a/\r\n2", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", long), (None, "u", long), (7, "u", "WARC/1.1\r\n\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages, str(tmp_path / "w")).collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = {i: (len((h or "").encode()), sha(h), "revisit" if i in (1, 2) else "response", 6 if i in (1, 2) else None) for i, _, h in rows}
    assert got == want
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC-Type: response") == 6 and data.count(b"WARC-Type: revisit") == 2 and data.count(b"WARC-Type: warcinfo") >= 1


def test_warc_ids_and_file_sizes(spark, tmp_path):
    noise = random.Random(0)
    long = "x" * 2000
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (2, "v", long), (3, "u", "a")] + [(i, "u", noise.randbytes(3000).hex()) for i in range(10, 60)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"), file_bytes=20_000)
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*")]
    assert len(files) > 5 and max(p.stat().st_size for p in (tmp_path / "w").glob("part-*")) < 27_000
    ids = [line for f in files for line in f.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(rows) + len(files)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "w")).where("page_id < 10").collect())
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None)]
    # Two records hold the original here, so none is named; where one does, its id is.
    assert all(b"WARC-Refers-To: " not in f for f in files)


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(700, 8)) * rng.lognormal(0, 1, (700, 1))).astype(np.float32)
    x[5:9] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (900, [None] * 8), (1000, [float("nan")] * 8), (None, x[0].tolist()), (1100, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(map(tuple, topk.top_inner_products(df, block_bytes=300).collect()))
    ints = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and i not in (800, 900, 1000)}
    want = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_odd_vectors(spark):
    big = 65535.0
    rows = [(100, [big, big, big]), (1, [big, big, big - 1 / 1024]), (2, [big, big - 1 / 1024, big - 1 / 1024]), (200, []), (3, []), (4, []), (300, [1e6]), (5, [1e6]), (6, [-1e6]), (400, [4e9, 4e9]), (7, [1e9, -3.0]), (8, [1e300, 0.0]), (9, [-1e300, 0.0])]
    got = sorted(map(tuple, topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in (100, 200, 300, 400):
        least = 2**63 - 1
        best = sorted((-min(max(sum(a * b for a, b in zip(ints[q], v, strict=True)), 1 - least), least), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_clashing_columns_survive_the_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents").withColumns({n: F.lit(n) for n in ("_key", "__key", "key", "node", "row", "component", "score", "held_out", "size")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "t")
    assert docs.columns[-9:] == ["_key", "__key", "key", "node", "row", "component", "score", "held_out", "size"] and docs.where("_key = '_key' and node = 'node'").count() == docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://h:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Cluster, "x")


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|>\n", "\\", "\\<|assistant|>\n", "<<SYS>><</SYS>>\\\\", "", "</s"]
    assert [chat.unescape(chat.escape(t)) for t in tricky] == tricky
    assert not any(c in chat.escape(t) for t in tricky for c in chat.CONTROL)
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(tricky)] + [(2, None, None, None), (None, 0, "assistant", "x"), (3, 0, "a|>\nb", "c"), (3, 0, "a|>\nb", "c")]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1].n_turns == 2
    text, a, b, parts = chat.format_turn("assistant", [{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 448, "height": 224}, {"type": "audio", "ref": "a", "seconds": 2}, {"type": "document", "ref": "d", "pages": 3}])
    assert text == "<|assistant|>\nsee <|image:1|><|audio:2|><|document:3|></s>\n" and text[a:b].startswith("see ") and [p["tokens"] for p in parts] == [128, 50, 1536]


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    kept = [r for r in docs.collect() if quality_rules.passes(quality_rules.DocStats(r.text or ""), list(quality_rules.RULES))]
    stage = docs
    counts = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = common.written(f(spark, stage, SF), "t")
        assert stage.columns == docs.columns
        counts.append({r.doc_id for r in stage.select("doc_id").collect()})
    assert counts[0] == {r.doc_id for r in kept} and counts[2] <= counts[1] <= counts[0]
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == counts[2]
