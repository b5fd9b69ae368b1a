"""A corpus pipeline over the operators of ``evalloop.llm``: from ``documents`` to tokens.

Each stage takes the rows that the one before kept and returns the columns of ``documents``; the last returns
the token digests.  ``run`` stores each stage's rows in the shared checkpoint folder before the next reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalloop.llm import bpe, mixing, quality, secret_scan, simhash
from evalloop.llm.common import cut_lineage, prepare, table
from evalloop.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or a learned rule go."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near-duplicates stays: the one with the smallest id, a null id last."""
    prepare(spark)
    return simhash.one_per_component(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    prepare(spark)
    return secret_scan.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights: a document appears as often as the mix takes it."""
    prepare(spark)
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids, decoded again: counts and digests."""
    prepare(spark)
    return bpe.round_trip(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixed_sources),
    ("bpe tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, "stage")
    return docs


#: The rules are learned and the fingerprints need XXH64, which SQL has not: tests hold the stages against brute force.
ORACLE_SQL = None
