"""Toxicity by a factorization machine over hashed terms.

A term is a word, or a character n-gram of one (which finds inflected and compounded forms), hashed to a slot.
The machine adds to the weights of a document's terms the products of their factors, pair by pair: terms that
are harmless alone and toxic together (an insult with the mention of a group) get a weight as a pair.
It is fitted on a bounded sample of labelled rows; every text is then scored as a whole.
"""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import cut_lineage, held_out, prepare, small_side
from evalloop.llm.terms import Remembered, gram_slots, words

#: Distinct labelled texts of each class that the machine learns from, at most.
SAMPLE = 8_000
SLOTS, GRAMS = 1 << 20, (4, 5, 6)
#: Terms that take part: those whose presence tells most about the label in the sample.
TERMS = 3_000
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 30, 128, 0.1, 1e-4


def slots_of(word: str) -> tuple[int, ...]:
    return tuple({crc32(word.encode()) % SLOTS, *gram_slots(word, GRAMS, SLOTS)})


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """A stored table of ``text``, ``label`` and ``weight``: at most ``most`` distinct texts of each class, none held out.

    The toxic label wins if one repeats.  A label is one observation however many rows repeat its id: the rows are
    counted by id and digest, a text is drawn (by hash) with the chance of its share in the rows of its id, and the
    drawn texts of an id share the weight 1 by their rows.  The draw is made after the join and from digests
    alone; what is drawn is bounded before it is broadcast, and copies of a text are combined where they are read.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out("doc_id")).groupBy(
        F.col("doc_id").alias("_label_id")).agg(F.max(label_col).cast("int").alias("label"))
    marks = small_side(cut_lineage(marks, "toxic-labels"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(
        F.col("_id").isNotNull() & ~held_out("_id")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    met = cut_lineage(texts.groupBy("_id", "digest").agg(F.count(F.lit(1)).alias("rows")).join(
        marks, F.col("_id") == F.col("_label_id")).select("_id", "digest", "label", "rows"), "toxic-rows")
    of_id = lambda df, name: cut_lineage(df.groupBy("_id").agg(F.sum("rows").alias("all")), name)
    chance = (F.pmod(F.xxhash64("_id", "digest", F.lit(11)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = met.join(of_id(met, "toxic-ids"), "_id").withColumn("key", -F.log(chance) * F.col("all") / F.col("rows")).drop("all")
    drawn = [keyed.filter(F.col("label") == k).orderBy("key", "_id", "digest").limit(most) for k in (0, 1)]
    drawn = cut_lineage(drawn[0].unionAll(drawn[1]), "toxic-sample")
    # Multiples of 2^-20, so that sums of weights do not depend on their order.
    weight = F.greatest(F.floor(F.col("rows") / F.col("all") * (1 << 20)), F.lit(1)) / float(1 << 20)
    drawn = cut_lineage(drawn.join(of_id(drawn, "toxic-drawn-ids"), "_id").select("_id", "digest", "label", weight.alias("weight")), "toxic-weights")
    return cut_lineage(texts.join(F.broadcast(drawn), ["_id", "digest"]).groupBy("_id", "digest", "label", "weight").agg(
        F.first("text").alias("text")), "toxic-texts")


def informative(texts: DataFrame, most: int = TERMS) -> list[int]:
    """The slots with the largest chi-square between presence and label, from counts summed by Spark."""
    def count(batches):
        seen = np.zeros((2, SLOTS))
        known = Remembered(slots_of, 50_000)
        for batch in batches:
            for text, label, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "weight"))):
                present = set().union(*map(known.__getitem__, set(words(text))))
                seen[label, np.fromiter(present, np.int64, len(present))] += weight
        at = np.flatnonzero(seen.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["slot", "clean", "toxic"])

    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    n0, n1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    if not n0 or not n1:
        return []
    counts = texts.select("text", "label", "weight").mapInArrow(count, "slot bigint, clean double, toxic double").groupBy("slot").agg(
        F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    chi = n * F.pow(a * n1 - b * n0, F.lit(2.0)) / (n0 * n1 * (a + b) * F.greatest(n - a - b, F.lit(0.5)))
    top = counts.filter(a + b >= 3).select("slot", chi.alias("chi")).orderBy(F.desc("chi"), "slot").limit(most)
    return [r["slot"] for r in top.collect()]


class Machine:
    """Weights and factors by term, fitted with adaptive gradient steps on the logistic loss."""

    def __init__(self, slots: list[int], rank: int = RANK, seed: int = 5):
        self.place = {s: k for k, s in enumerate(slots)}
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.weight = np.zeros(len(slots) + 1)
        self.factor = rng.normal(0, 0.01, (len(slots) + 1, rank))
        self.factor[-1] = 0  # the last row ends every document and weighs nothing

    def terms_of(self, word: str) -> tuple[int, ...]:
        return tuple({self.place[s] for s in slots_of(word) if s in self.place})

    def _joined(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All terms one after another, and how many a document has; each ends with the pad, so none is empty."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        pad = (len(self.weight) - 1,)
        return np.fromiter(chain.from_iterable(chain(r, pad) for r in rows), np.int64, int(lengths.sum())), lengths

    def _raw(self, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, the factors of the terms and their sums by document."""
        starts = np.cumsum(lengths) - lengths
        v = self.factor[terms]
        total = np.add.reduceat(v, starts)
        pairs = (total ** 2).sum(axis=1) - np.add.reduceat((v ** 2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weight[terms], starts) + 0.5 * pairs, v, total

    def raw(self, rows: list[list[int]]) -> np.ndarray:
        return self._raw(*self._joined(rows))[0] if rows else np.zeros(0)

    def fit(self, rows: list[list[int]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 6,
            weights: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(seed)
        weights = np.ones(len(rows)) if weights is None else weights
        size, rank = self.factor.shape
        seen_w, seen_v, seen_b = np.full_like(self.weight, 1e-2), np.full_like(self.factor, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), BATCH):
                pick = order[k:k + BATCH]
                terms, lengths = self._joined([rows[i] for i in pick])
                raw, v, total = self._raw(terms, lengths)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) * weights[pick] / len(pick)
                each = np.repeat(error, lengths)
                step = each[:, None] * (np.repeat(total, lengths, axis=0) - v)
                grad_w = DECAY * self.weight + np.bincount(terms, each, size)
                grad_v = DECAY * self.factor + np.stack([np.bincount(terms, step[:, r], size) for r in range(rank)], axis=1)
                grad_w[-1] = grad_v[-1] = 0
                grad_b = error.sum()
                seen_w, seen_v, seen_b = seen_w + grad_w ** 2, seen_v + grad_v ** 2, seen_b + grad_b ** 2
                self.weight -= RATE * grad_w / np.sqrt(seen_w)
                self.factor -= RATE * grad_v / np.sqrt(seen_v)
                self.bias -= RATE * grad_b / np.sqrt(seen_b)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """From 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        most: int = SAMPLE) -> Machine:
    """The machine, from the terms of the sample: at most ``2 * most`` distinct texts of at most ``TERMS`` numbers reach the driver."""
    prepare(docs.sparkSession)
    texts = sample(docs, labels, id_col, text_col, label_col, most)
    machine = Machine(informative(texts))
    if not machine.place:
        return machine

    def run(batches):
        known = Remembered(machine.terms_of)
        for batch in batches:
            found = [sorted(set().union(*map(known.__getitem__, set(words(t))))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "label", "weight")), pa.array(found, pa.list_(pa.int32()))],
                                             names=["_id", "label", "weight", "terms"])

    kind = texts.schema["_id"].dataType.simpleString()
    rows = texts.select("_id", "text", "label", "weight").mapInArrow(run, f"_id {kind}, label int, weight double, terms array<int>").collect()
    rows.sort(key=lambda r: (r["_id"], r["terms"], r["weight"]))  # the fit does not depend on the partitions
    machine.fit([r["terms"] for r in rows], np.array([r["label"] for r in rows], float),
                weights=np.array([r["weight"] for r in rows], float))
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` of every row: one pass over whole texts, without a shuffle.

    Null and empty texts have no term and score what the bias says; ids may be null or repeat; without labels
    the machine is empty and every score is 0.5 or below; an empty table gives an empty result; other columns are
    not read.
    """
    prepare(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = ids.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        own = shared.value
        known = Remembered(own.terms_of)
        for batch in batches:
            found = [sorted(set().union(*map(known.__getitem__, set(words(t))))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(own.score(found), pa.float64())], names=["_id", "score"])

    scored = ids.mapInArrow(run, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    return score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
