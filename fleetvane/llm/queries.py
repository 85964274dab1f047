"""Queries of the subpackage: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetvane.llm import centroids, chat, complement_packing, divergence, merge_automaton, packing, quality_rules, simhash, token_orc, topk, toxicity, warc, wrappers
from fleetvane.llm.common import table


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_orc(spark, table(spark, sf_dir, "documents"))


def op2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op3_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_automaton.automaton_round_trip(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement_packing.pack_best_fit(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters_of(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_orc": op1_token_orc,
        "op2_wrappers": op2_wrappers,
        "op3_merge_automaton": op3_merge_automaton,
        "op4_warc": op4_warc,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_topk": op7_topk,
        "op8_quality_rules": op8_quality_rules,
        "op9_chat": op9_chat,
        "op10_packing": op10_packing,
        "op11_divergence": op11_divergence,
        "op12_best_fit": op12_best_fit,
        "op13_centroids": op13_centroids,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE_SQL, "op7_topk": topk.ORACLE_SQL, "op8_quality_rules": quality_rules.ORACLE_SQL, "op9_chat": chat.ORACLE_SQL, "op11_divergence": divergence.ORACLE_SQL, "op13_centroids": centroids.ORACLE_SQL}
