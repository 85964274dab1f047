"""Extra columns, also of names that operators use themselves, change no result; so do null ids."""

import pytest
from pyspark.sql import functions as F

from fleetvane.llm import centroids, chat, complement_packing, divergence, merge_automaton, packing, quality_rules, simhash, token_orc, topk, warc, wrappers

DOCS = [(1, "one two three four", "en", "a"), (1, "one two three four", "en", "a"), (None, "no id", None, "b"), (7, None, "en", None), (9, "", "de", "a"), (2**40, "zwei drei " * 40, "de", "c")]
CLASHES = ["fp", "length", "ids", "n", "key", "part", "number", "host", "wrapper", "salt", "v", "norm2", "x", "payload", "digest", "rank", "value", "component", "_place", "cluster", "score"]


def of_docs(run):
    return "doc_id long, text string, lang string, source string", DOCS, run


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (None, None, "x" * 1200), (3, "http://b/", "x" * 1200), (3, "http://b/", "x" * 1200)]
VECTORS = [(100, [1.0, 2.0]), (101, [0.5, -1.0]), (None, [3.0, 3.0]), (200, [1.0, 2.0]), (200, [1.0, 2.0]), (5, None)]
TURNS = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (2, 0, "user", None), (2, 0, "user", None)]

CASES = {
    "op1": of_docs(lambda df: token_orc.token_orc(df.sparkSession, df)),
    "op3": of_docs(merge_automaton.automaton_round_trip),
    "op5": of_docs(simhash.simhash_components),
    "op8": of_docs(lambda df: quality_rules.quality_verdicts(df, list(quality_rules.RULES))),
    "op10": of_docs(lambda df: packing.pack(df.coalesce(1)).drop("sequence_id", "offset", "tier", "step_group")),
    "op11": of_docs(lambda df: divergence.source_divergence(df, least_docs=1)),
    "op12": of_docs(lambda df: complement_packing.pack_best_fit(df).drop("sequence_id", "offset")),
    "op2": ("page_id long, url string, html string", PAGES, wrappers.main_texts),
    "op4": ("page_id long, url string, html string", PAGES, warc.warc_round_trip),
    "op7": ("vec_id long, embedding array<double>", VECTORS, topk.top_inner_products),
    "op13": ("vec_id long, embedding array<double>", VECTORS, lambda df: centroids.clusters_of(df, clusters=2, rounds=2, dim=2)),
    "op9": ("conv_id long, turn long, role string, text string", TURNS, chat.chat_digests),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_extra_columns(spark, name):
    schema, rows, run = CASES[name]
    plain = spark.createDataFrame(rows, schema)
    more = plain.withColumns({c: F.lit("clash") for c in CLASHES if c not in plain.columns}).withColumn("Doc_Length", F.lit(1))
    want, got = (run(df) for df in (plain, more))
    assert want.columns == got.columns and sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
