"""Derived inputs of the registered queries, computed by Spark from the given tables.

The driver tables hold no answers, boxes, headers or tags, so each loop stage
gets a deterministic projection of a real table (integer arithmetic only, so
that the DuckDB oracle in :mod:`evalloop.plans.oracle` builds the same rows):

* ``gold_problems``  <- orders:    one question per order, gold answer in boxed or ``####`` form
* ``candidates``     <- lineitem:  one candidate output per line item (cand_idx by position)
* ``doc_problems``   <- documents: raw question rows with heterogeneous fields
* ``raw_responses``  <- documents: model-style ``Question:/Answer:`` texts with defects
* ``json_responses`` <- events:    attribution-like JSON wrapped in prose / fences / truncated
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloop.operators.judge import judge_key
from evalloop.operators.sampling import index_within_group
from evalloop.session import read_table  # noqa: F401  (re-exported)

CAND_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LOCK = threading.Lock()


def _fingerprint(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """Identity of the input files on any file system: path, size and time of each, summed up by Spark."""
    h = hashlib.sha1(sf_dir.rstrip("/").encode())
    for t in tables:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir.rstrip('/')}/{t}.parquet")
        r = files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
        h.update(f"{t}:{r[0]}:{r[1]}:{r[2]}".encode())
    return h.hexdigest()[:16]


def materialized(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build) -> DataFrame:
    """Write a derived table once into the shared checkpoint folder and read it back.

    Mirrors production, where e.g. the completions table is written once by
    the inference job and every later stage reads the stored copy; the key
    covers the input folder and its files, so changed inputs get a new copy.
    """
    from evalloop.session import committed, ensure_checkpoint_dir, spread

    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/fixtures/{name}-{_fingerprint(spark, sf_dir, tables)}"
    with _LOCK:
        if not committed(spark, path):
            build(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spread(spark.read.parquet(path))


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def gold_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_gold: ``problems`` rows from orders; dataset = order priority (5 groups)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    digit = _s((F.col("o_orderkey") * 7) % 10)
    answer = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Work it out.\n#### "), digit)).otherwise(
        F.concat(F.lit("The check digit is \\boxed{"), digit, F.lit("}.")))
    df = o.select(
        F.concat(F.lit("Order "), _s("o_orderkey"), F.lit(": what is its check digit?")).alias("question"),
        answer.alias("answer"),
        F.col("o_orderpriority").alias("dataset"),
        F.concat(F.lit("orders/"), F.col("o_orderpriority")).alias("dataset_id"),
        F.lit("unknown").alias("difficulty"),
        F.col("o_orderkey").alias("sample_index"),
    )
    return df.withColumn("judge_key", judge_key())


def candidate_value():
    return (F.col("l_orderkey") * 7 + F.col("l_partkey") % 3) % 10


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_preds, stored once (see :func:`materialized`)."""
    return materialized(spark, sf_dir, "candidates", ["lineitem"], build_candidates)


def build_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_preds: ``(sample_index, cand_idx, text)``; four text shapes by line number."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", *CAND_ORDER)
    idx = index_within_group(li, ["l_orderkey"], CAND_ORDER, "cand_idx")
    v = _s(candidate_value())
    alt = _s((candidate_value() + 3) % 10)
    m = F.col("l_linenumber") % 4
    text = (
        F.when(m == 0, F.concat(F.lit("We add the parts.\nSo the result is $\\boxed{"), v, F.lit("}$.")))
        .when(m == 1, F.concat(F.lit("First guess \\boxed{"), alt,
                               F.lit("}, but checking again gives \\boxed{\\boxed{"), v, F.lit("}} ok")))
        .when(m == 2, F.concat(F.lit("Compute the digit.\n#### "), v, F.lit(" ;\nend of work")))
        .otherwise(F.concat(F.lit("Line one\n  "), v, F.lit(".  \n")))
    )
    return idx.select(F.col("l_orderkey").alias("sample_index"), F.col("cand_idx").cast("int").alias("cand_idx"),
                      text.alias("text"))


def doc_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_problems: raw question rows from documents with fields that vary by ``doc_id % 6``.

    Columns: doc_id, source, problem, question, solution, final_answer (some blank or null).
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    m = F.col("doc_id") % 6
    boxed_answer = F.concat(F.lit("So $\\boxed{\\frac{"), _s("n_chars"), F.lit("}{"),
                            _s(F.col("doc_id") % 7 + 1), F.lit("}}$."))
    problem = F.when(m.isin(0, 1, 2), F.col("text")).when(m == 3, F.lit("   "))
    question = F.when(m.isin(3, 4), F.concat(F.lit("Q"), _s("doc_id"), F.lit(": "), F.col("text")))
    solution = (F.when(m == 0, F.concat(F.lit("Reasoning.\n"), boxed_answer))
                .when(m == 1, F.concat(F.lit("Reasoning.\n#### "), _s("n_chars")))
                .when(m == 2, F.lit("Reasoning without a final line"))
                .when(m == 3, F.lit(""))
                .when(m == 5, F.col("text")))
    final = F.when(m.isin(2, 3), _s(F.col("n_chars") % 97)).when(m == 4, F.lit(" "))
    return d.select("doc_id", "source", problem.alias("problem"), question.alias("question"),
                    solution.alias("solution"), final.alias("final_answer"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_raw: model-style responses from documents; header/tag defects by ``doc_id % 8``.

    Columns: doc_id, source, source_question, response.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    m = F.col("doc_id") % 8
    q = F.col("text")
    box = F.concat(F.lit("$\\boxed{"), _s(F.col("n_chars") % 100), F.lit("}$."))
    deep = F.concat(F.lit("$\\boxed{" + "{" * 20), _s(F.col("n_chars") % 100), F.lit("}" * 20 + "}$."))
    work = F.concat(F.lit("We compute it step by step.\n"), q, F.lit("\nThe value is "), _s(F.col("n_chars") % 100), F.lit(".\n"))
    resp = (
        F.when(m == 0, F.concat(F.lit("Question:\n"), q, F.lit("\nAnswer:\n"), work, box))
        .when(m == 1, F.concat(F.lit("<think>draft</think>\nQuestion: New problem about item "), _s("doc_id"),
                               F.lit(" and its parts?\nAnswer: "), work, deep))
        .when(m == 2, F.concat(F.lit("Question: Short?\nAnswer: "), work, box))
        .when(m == 3, F.concat(F.lit("Question: A different question about "), _s("n_chars"),
                               F.lit(" things.\nAnswer: "), work, F.lit("no box here")))
        .when(m == 4, F.concat(F.lit("question: first draft about "), _s("doc_id"), F.lit(" items and more"),
                               F.lit("\nANSWER: answer: "), work, box, F.lit("\nQuestion:")))
        .when(m == 5, F.concat(F.lit("<Plan>plan "), _s("doc_id"), F.lit(" "), q, F.lit("<Solve>solve</Solve><Answer>"),
                               box, F.lit("</Answer>")))
        .when(m == 6, F.concat(F.lit("Question: Find the value for record "), _s("doc_id"),
                               F.lit(" please.\nAnswer: Question: leaked header\n"), q, F.lit("\n"), box))
        .otherwise(F.concat(F.lit("<think>\nsteps for "), _s("doc_id"), F.lit("\n</think>\n"), work,
                            F.lit("**Final Answer:** \\boxed{"), _s(F.col("n_chars") % 100), F.lit("}")))
    )
    return d.select("doc_id", "source", q.alias("source_question"), resp.alias("response"))


def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_json: attribution-like responses from events; shape by ``event_id % 5``."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    obj = F.concat(F.lit('{"error_type": "'), F.col("event_type"), F.lit('", "missing_skill": "skill_'),
                   _s(F.col("user_id") % 7), F.lit('", "detail": '), F.col("props"), F.lit("}"))
    m = F.col("event_id") % 5
    text = (F.when(m == 0, obj)
            .when(m == 1, F.concat(F.lit("Here is my analysis: "), obj, F.lit(" Hope it helps.")))
            .when(m == 2, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
            .when(m == 3, F.substring(obj, F.lit(1), F.length(obj) - 2))
            .otherwise(F.concat(obj, F.lit(" and "), F.col("props"))))
    return e.select("event_id", "user_id", text.alias("text"))


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_items: the benchmark, and documents that leaked into it: with other blanks, or with one more word."""
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spaced = docs.filter(F.col("doc_id") % 37 == 0).select(
        F.col("doc_id") + 10_000_000, F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("  ")))
    longer = docs.filter(F.col("doc_id") % 41 == 0).select(F.col("doc_id") + 20_000_000, F.concat("text", F.lit(" zzextra")))
    return bench.union(spaced).union(longer)
