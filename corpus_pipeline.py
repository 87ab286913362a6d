"""A training corpus from raw documents: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreloom.llm import decontamination, language_id, mixing, ngram_join, sharding
from loreloom.llm.common import table
from loreloom.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language stay; those without letters or without one go."""
    return language_id.kept_documents(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest id stays, also where ids are repeated or null."""
    return ngram_join.kept_rows(docs)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"), stretch=True)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row in 40 shards of nearly equal bytes."""
    return sharding.shards(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark_passages),
    ("mixing sources", mixed_sources),
    ("sharding", sharded),
]

#: Language mixtures are fitted by iteration, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
