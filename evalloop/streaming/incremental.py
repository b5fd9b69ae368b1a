"""Incremental judging with Structured Streaming.

New candidate files are judged as they land (file source with an explicit
schema, ``availableNow`` or processing-time trigger):

* stream-static inner join with the gold answers (extracted once per question);
* a streaming aggregation keeps ONE state row per question: the numbers seen (a set, 8 bytes each) and, of each
  number below k, when it came first and whether it was correct then.  Its functions are Spark's own, so no question
  costs a call into Python.  The first delivery of a candidate counts, later ones do not; of deliveries in one
  micro-batch a correct one wins.  A micro-batch emits the old and the new verdict of the questions that it touched;
* with ``idle_ms``, or a k above ``MOST_COLUMNS``, ``transformWithState`` keeps the state row instead (numbers seen as
  bits): it can let go of idle questions, at about a millisecond of Python per question and micro-batch;
* ``foreachBatch`` adds them to the verdict store as one part (I2) and adds new minus old to the running totals (I3).

The verdict store is a list of parts in levels: whenever ``fan_in`` parts of a level are there, they are merged
into one of the next level, the latest verdict of a question winning.  So a read opens at most
``fan_in - 1`` parts a level, and levels grow with the logarithm of the batches.  The list is replaced by one rename;
a batch that is delivered again after its list was committed changes nothing.
"""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from evalloop.operators import judge as jd
from evalloop.operators import metrics as mt
from evalloop.session import path_exists
from evalloop.sources.parts import PartLists

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("judge_key", T.StringType()), T.StructField("cand_idx", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

QUESTION = ["judge_key", "dataset"]
#: Candidate numbers per combined row: their bits, summed, stay in a long.
BLOCK = 32
#: The block (or number) of candidates without a number; they count once and are never correct within k.
NO_NUMBER = -(1 << 40)
#: Numbers below k that the aggregation follows in a column each.
MOST_COLUMNS = 64

#: ``known`` is null for a question that had no verdict before.
CHANGES = T.StructType([
    T.StructField("judge_key", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("n_candidates", T.LongType()), T.StructField("pass_at_1", T.BooleanType()), T.StructField("pass_at_k", T.BooleanType()),
    T.StructField("known", T.LongType()), T.StructField("old_pass_at_1", T.BooleanType()), T.StructField("old_pass_at_k", T.BooleanType()),
])


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(judge_key, dataset, block, seen, correct)`` per Arrow batch from ``(judge_key, dataset, block, bit, ok)``.

    Re-deliveries within the batch fold into one; a question that holds most rows shrinks to a row per 32 numbers.
    """
    keys = [*QUESTION, "block"]
    for batch in batches:
        single = pa.Table.from_batches([batch]).group_by([*keys, "bit"]).aggregate([("ok", "max")])
        bits = single["bit"].to_numpy()
        marked = single.append_column("seen", pa.array(1 << bits)).append_column(
            "correct", pa.array((1 << bits) * single["ok_max"].to_numpy()))
        out = marked.group_by(keys).aggregate([("seen", "sum"), ("correct", "sum")]).select([*keys, "seen_sum", "correct_sum"])
        yield from out.rename_columns([*keys, "seen", "correct"]).to_batches()


class Questions(StatefulProcessor):
    """State of a question: its blocks of seen numbers, the number of candidates and the smallest correct number."""

    def __init__(self, k: int, idle_ms: int | None = None):
        self.k, self.idle_ms = max(int(k), 1), idle_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("question", "seen binary, n bigint, first bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else (b"", 0, None)
        blocks = dict(struct.iter_unpack("<qQ", bytes(held[0])))
        n, first = held[1], held[2]
        correct: dict[int, int] = {}
        seen: dict[int, int] = {}
        for r in rows:
            seen[r["block"]] = seen.get(r["block"], 0) | r["seen"]
            correct[r["block"]] = correct.get(r["block"], 0) | r["correct"]
        for block, bits in seen.items():
            new = bits & ~blocks.get(block, 0)
            if not new:
                continue
            blocks[block] = blocks.get(block, 0) | new
            n += new.bit_count()
            hits = correct[block] & new
            if hits and block != NO_NUMBER:
                at = block * BLOCK + (hits & -hits).bit_length() - 1
                first = at if first is None else min(first, at)
        if n == held[1]:
            return
        self.state.update((b"".join(struct.pack("<qQ", *b) for b in sorted(blocks.items())), n, first))
        old = self._verdict(held[1], held[2]) if held[1] else (None, None, None)
        yield Row(**dict(zip(CHANGES.names, (*key, *self._verdict(n, first), *old))))

    def _verdict(self, n, first) -> tuple[int, bool, bool]:
        return n, first == 0, first is not None and first < self.k


def verdict_changes(marks: DataFrame, k: int) -> DataFrame:
    """``CHANGES`` of the questions that a micro-batch touches, from ``(judge_key, dataset, number, ok, at)``.

    ``at`` is the time of the micro-batch.  A delivery is ranked by ``2 * at``, plus 1 if it is wrong, so the smallest
    rank of a number tells its first delivery.  Numbers below 0 are no sampler's; they are kept with their ranks.
    """
    k = max(int(k), 1)
    number, rank = F.col("number"), F.col("at") * 2 + F.when(F.col("ok"), 0).otherwise(1)
    below = (number < 0) & (number != NO_NUMBER)
    state = marks.groupBy(*QUESTION).agg(
        F.collect_set("number").alias("numbers"), F.min("at").alias("since"), F.max("at").alias("now"),
        F.collect_set(F.when(below, F.struct("number", rank.alias("rank")))).alias("below"),
        *(F.min(F.when(number == i, rank)).alias(f"rank_{i}") for i in range(k)))
    before = F.col("now") * 2  # ranks of earlier micro-batches are smaller

    def verdict(counts) -> tuple:
        first = F.coalesce(*(F.when((F.col(f"rank_{i}") % 2 == 0) & counts(F.col(f"rank_{i}")), i) for i in range(k)))
        negative = F.aggregate(
            F.array_sort("below"), F.struct(F.lit(0).cast("long").alias("last"), F.lit(False).alias("hit")),
            lambda got, e: F.struct(e["number"].alias("last"), (
                got["hit"] | ((e["number"] != got["last"]) & (e["rank"] % 2 == 0) & counts(e["rank"]))).alias("hit")))["hit"]
        return F.coalesce(~negative & (first == 0), F.lit(False)), negative | first.isNotNull()

    known = F.col("since") < F.col("now")
    new, old = verdict(lambda rank: F.lit(True)), verdict(lambda rank: rank < before)
    return state.select(
        *QUESTION, F.size("numbers").cast("long").alias("n_candidates"), new[0].alias("pass_at_1"), new[1].alias("pass_at_k"),
        F.when(known, 1).cast("long").alias("known"), F.when(known, old[0]).alias("old_pass_at_1"), F.when(known, old[1]).alias("old_pass_at_k"))


class VerdictStore:
    """Verdicts of the questions as parts in levels, and totals per dataset, one list per micro-batch."""

    def __init__(self, spark: SparkSession, root: str, fan_in: int = 8, keep: int = 3):
        self.spark, self.fan_in, self.keep = spark, max(int(fan_in), 2), keep
        self.lists = PartLists(spark, root)
        self.root = self.lists.root

    def add(self, changes: DataFrame, batch_id: int, k: int, query: str | None = None) -> None:
        """Add the changed verdicts of a micro-batch; one that the newest list holds already is left out."""
        now = self.lists.read()
        if now and batch_id <= now["batch"]:
            return
        part = {"path": f"parts/l0-{batch_id}", "level": 0}
        changes.withColumn("k", F.lit(int(k))).withColumn("batch_id", F.lit(int(batch_id)).cast("long")) \
            .write.mode("overwrite").parquet(f"{self.root}/{part['path']}")
        totals = self._totals(now, part, batch_id)
        parts = self._compacted([*(now["parts"] if now else []), part], batch_id)
        self.lists.commit(batch_id, {"batch": int(batch_id), "k": int(k), "query": query, "parts": parts, "totals": totals,
                                     "at": int(time.time() * 1000)})
        self.lists.forget(self.keep, lambda c: [p["path"] for p in c["parts"]] + [c["totals"]])

    def _totals(self, now: dict | None, part: dict, batch_id: int) -> str:
        """Totals after this batch: those before plus, per changed question, its new verdict minus its old one."""
        rows = self.spark.read.parquet(f"{self.root}/{part['path']}")
        flag = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
        signed = rows.select("k", F.coalesce("dataset", F.lit("")).alias("dataset"),
                             F.when(F.col("known").isNull(), 1).otherwise(0).cast("long").alias("n"),
                             (flag("pass_at_1") - flag("old_pass_at_1")).alias("n_pass_1"),
                             (flag("pass_at_k") - flag("old_pass_at_k")).alias("n_pass_k"))
        if now:
            signed = signed.unionByName(self.spark.read.parquet(f"{self.root}/{now['totals']}"))
        path = f"totals/b{batch_id}"
        signed.groupBy("k", "dataset").agg(*(F.sum(c).alias(c) for c in ("n", "n_pass_1", "n_pass_k"))) \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{path}")
        return path

    def _compacted(self, parts: list[dict], batch_id: int) -> list[dict]:
        """``parts`` with every ``fan_in`` of one level merged into one of the next."""
        level = 0
        while any(p["level"] >= level for p in parts):
            same = [p for p in parts if p["level"] == level]
            if len(same) >= self.fan_in:
                merged = {"path": f"parts/l{level + 1}-{batch_id}", "level": level + 1}
                _latest(self.spark.read.parquet(*(f"{self.root}/{p['path']}" for p in same))).write.mode("overwrite").parquet(
                    f"{self.root}/{merged['path']}")
                parts = [p for p in parts if p["level"] != level] + [merged]
            level += 1
        return parts

    def verdicts(self) -> DataFrame:
        """The latest verdict of every question."""
        now = self._newest()
        return _latest(self.spark.read.parquet(*self.lists.paths(now))).select(*QUESTION, "n_candidates", "pass_at_1", "pass_at_k", "k")

    def totals(self) -> DataFrame:
        """``(k, dataset, n, n_pass_1, n_pass_k)`` of everything judged so far: one row per dataset, whatever was judged."""
        return self.spark.read.parquet(f"{self.root}/{self._newest()['totals']}")

    def _newest(self) -> dict:
        now = self.lists.read()
        if now is None:
            raise FileNotFoundError(f"no micro-batch was committed to {self.root}")
        return now


def _latest(rows: DataFrame) -> DataFrame:
    """J5 over questions: the row of the newest batch (partial aggregation)."""
    others = [c for c in rows.columns if c not in QUESTION]
    picked = rows.groupBy(*QUESTION).agg(F.max_by(F.struct(*others), "batch_id").alias("_r"))
    return picked.select(*QUESTION, *[F.col(f"_r.{c}").alias(c) for c in others])


def _query_id(spark: SparkSession, checkpoint_dir: str) -> str | None:
    """The id that a streaming query wrote into its checkpoint, None before its first start."""
    path = f"{checkpoint_dir.rstrip('/')}/metadata"
    return json.loads(spark.read.text(path).first()[0])["id"] if path_exists(spark, path) else None


def start_incremental_judge(spark: SparkSession, source_dir: str, problems: DataFrame, store_dir: str,
                            checkpoint_dir: str, k: int = 8, file_format: str = "parquet",
                            available_now: bool = True, files_per_batch: int | None = None,
                            idle_ms: int | None = None, fan_in: int = 8):
    """Stream candidate files from ``source_dir`` into the verdict store.

    ``problems``: (judge_key, dataset, answer).  Returns the ``StreamingQuery``
    (``awaitTermination`` it for availableNow).  ``files_per_batch`` bounds what one micro-batch reads.  State: one row per question, 8 bytes per candidate number.
    ``idle_ms``: the caller promises that a question which got no candidate for so long is complete, and its
    state is dropped; without it the state is kept.  A store belongs to one checkpoint and one k: another raises.
    A candidate without a key is no one's and is ignored; one without a number counts once and is never correct.
    """
    stream = spark.readStream.schema(CANDIDATE_SCHEMA).format(file_format)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", int(files_per_batch))
    gold = jd.gold_finals(problems.filter(F.col("judge_key").isNotNull()), "judge_key", keep=["dataset"])
    preds = jd.candidate_finals(stream.load(source_dir), "judge_key")
    ok = (~F.col("gold_missing")) & (F.col("pred_norm") != "") & (F.col("pred_norm") == F.col("gt_norm"))
    number = F.col("cand_idx").cast("long")
    matched = preds.join(gold, "judge_key", "inner")
    if idle_ms is None and k <= MOST_COLUMNS:
        changes = verdict_changes(matched.select(
            *QUESTION, F.coalesce(number, F.lit(NO_NUMBER)).alias("number"), F.coalesce(ok, F.lit(False)).alias("ok"),
            F.unix_millis(F.current_timestamp()).alias("at")), k)
    else:
        marks = matched.select(
            *QUESTION, F.coalesce(F.floor(number / BLOCK), F.lit(NO_NUMBER)).cast("long").alias("block"),
            F.coalesce(F.pmod(number, F.lit(BLOCK)), F.lit(0)).cast("long").alias("bit"),
            F.coalesce(ok, F.lit(False)).cast("long").alias("ok"))
        combined = marks.mapInArrow(combine, "judge_key string, dataset string, block bigint, seen bigint, correct bigint")
        changes = combined.groupBy(*QUESTION).transformWithState(
            Questions(k, idle_ms), CHANGES, "Update", "ProcessingTime" if idle_ms else "None")

    store = VerdictStore(spark, store_dir, fan_in)
    held = store.lists.read()
    if held and (held["k"] != int(k) or held["query"] != _query_id(spark, checkpoint_dir)):
        raise ValueError(f"{store_dir} belongs to another checkpoint or another k than {checkpoint_dir}, {k}")
    if held and held.get("at", 0) >= time.time() * 1000:  # deliveries are told apart by the time of their micro-batch
        raise RuntimeError(f"the clock of this driver is behind the last micro-batch of {store_dir}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, batch_id, k, _query_id(spark, checkpoint_dir))

    w = (changes.writeStream.outputMode("update").foreachBatch(handle)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    # The provider (the one that keeps such state) is read when a query starts; other queries of the session keep theirs.
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB_PROVIDER)
    try:
        return w.start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def current_verdicts(spark: SparkSession, store_dir: str) -> DataFrame:
    """I2 read side: the latest verdict per question."""
    return VerdictStore(spark, store_dir).verdicts()


def running_stats(spark: SparkSession, store_dir: str) -> DataFrame:
    """pass@1 / pass@k overall and per dataset over everything judged so far, from the running totals alone."""
    return mt.rates_of_totals(VerdictStore(spark, store_dir).totals())
