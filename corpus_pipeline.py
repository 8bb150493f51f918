"""From raw documents to a training mix, stage by stage.

Each stage reads what its predecessor wrote and returns the columns of
``documents``; the last returns the words each document gives to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import common, decontaminate, line_dedup, mix, ngram_join, quality_rules


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; documents left without lines go."""
    return line_dedup.deduplicated(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return ngram_join.representatives(docs, shingle=5, numerator=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken from each document to meet the sources' targets."""
    return mix.mix(docs)


STAGES = [
    ("quality_rules", apply_rules),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("mix", mix_sources),
]

#: Tokeniser figures, MinHash lines and the cube method are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"pipeline-{name}")
    return docs
