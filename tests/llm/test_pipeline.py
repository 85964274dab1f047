"""The whole pipeline against its stages' rules by brute force; only the toxicity model is taken as given."""

import numpy as np
from conftest import SF
from test_near_copies import sets_of
from test_ops import brute_components, crc

import corpus_pipeline
from fleetvane.llm import common, quality_rules, toxicity
from fleetvane.llm.tokens import tokenizer_path


def test_run_by_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    good = [r for r in rows if all(rule(quality_rules.DocStats(r[1])) for rule in quality_rules.RULES.values())]
    kept = spark.createDataFrame(good, "doc_id long, text string")
    scorer = toxicity.Scorer(toxicity.train(kept, common.table(spark, SF, "labels")))
    harmless = [r for r, s in zip(good, scorer.scores([t for _, t in good]), strict=True) if s < toxicity.THRESHOLD]
    first = set(brute_components(sets_of([t for _, t in harmless])))
    one_each = {d: t for i, (d, t) in enumerate(harmless) if i in first}
    assert len(rows) > len(good) > len(harmless) > len(one_each) > 50

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.no_truncation()
    by_doc, by_sequence = {}, {}
    for p in corpus_pipeline.run(spark, SF).collect():
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(one_each)
    for d, pieces in by_doc.items():
        ids, at = [*t.encode(one_each[d], add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(np.array(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_stages_keep_columns(spark):
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
