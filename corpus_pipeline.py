"""Four operators in a row over documents; each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetvane.llm import near_copies, packing, quality_rules, toxicity
from fleetvane.llm.common import table, written


#: What a worker may remember of words while packing. The stages before have grown the executors' heaps to their limit by then.
PACKING_BYTES = 176 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_harmless(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, most_bytes=PACKING_BYTES)


STAGES = [("quality rules", quality), ("toxicity", harmless), ("SimHash near-dedup", one_of_each), ("packing", packed)]

#: The toxicity model can't be put in SQL. The tests hold run() against the stages' rules by brute force, given the model's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
