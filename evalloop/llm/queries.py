"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloop.llm import (bpe, collocations, conversations, embed_dedup, langid, mixing, oracle, quality, secret_scan,
                          simhash, token_counts, toxicity, url_filter, warc)
from evalloop.llm.common import prepare, table


def vocabulary() -> str:
    """The place of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with ``bad``: the document that a url names by its last number is labelled toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    labels = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(bad).alias("bad"))
    names = F.regexp_extract("url", r"://[^/?#]*[^?#]*?([0-9]{1,18})[^0-9?#]*(?:[?#]|$)", 1)
    return pages.withColumn("_names", names.try_cast("bigint")).join(
        labels, F.col("_names") == F.col("_label_id"), "left").select("page_id", "url", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return url_filter.judge(marked_pages(spark, sf_dir)).drop("template")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.counts(table(spark, sf_dir, "documents"), vocabulary())


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return conversations.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_embeddings": op8_embeddings,
    "op9_languages": op9_languages,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_trie": op13_conversation_trie,
}

#: DuckDB SQL for the rows of a query, where SQL can express it.
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
