"""Phrase collocations per language, found by best-first branch and bound over the prefix tree of phrases.

Two passes read the texts.  The first counts words, and pairs of neighbours in a hashed table of fixed size, whose
cells are upper bounds; the second keeps the runs of words whose pairs may reach the least count.  Equal runs are
stored once with their number, and all further counting works on them.

A phrase's children are the phrases one word longer.  No phrase below prefix p can score more than
``SCALE * f(p) / (f(q) + f(p))`` for any shorter prefix q of p, as its own count is at most f(p) and the rest behind q is at
least as frequent as the phrase.  A round takes the frontier of one language down to a score T: it grows only
prefixes whose bound reaches T, most promising first, scores what it meets, and tells which of the phrases that score T or
more survive.  Once they are enough, no phrase that was not grown can be among the best; otherwise T is lowered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloop.llm.common import cut_lineage, prepare, small_side

LEAST = 30
LONGEST = 4
BEST = 2000
SCALE = 2_000_000
#: A phrase goes if a longer one around it has this percentage of its count.
COVERED_PERCENT = 80
#: Cells of the hashed table of pairs: 2 to this power, a byte each.
CELL_BITS = 24
#: Cells that are summed together, and bytes of text that are taken apart together.
CHUNK = 1 << 18
TOGETHER = 12 << 20
#: Places of a run at which phrases start; longer runs are stored in overlapping parts.
STARTS = 512

# Bytes that end a piece, bytes between words, A-Z in lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _windows(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``data`` in parts of about ``most`` bytes that end with a piece."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        if end < len(data):
            ends = np.flatnonzero(_KIND[data[at:end]] == 2)
            while not len(ends) and end < len(data):
                start, end = end, min(len(data), end + most)
                ends = np.flatnonzero(_KIND[data[start:end]] == 2) + (start - at)
            end = at + int(ends[-1]) + 1 if len(ends) else len(data)
        yield data[at:end]
        at = end


def _words(data: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of UTF-8 bytes in order, and the number of the piece of each."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words.dictionary_encode(), piece


def _parts(batches) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """Language, distinct words, place among them of each word, and piece of each word, of whole texts taken together."""
    held, size = [], 0

    def out():
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column(0)).to_pylist():
            texts = table.filter(pc.equal(table.column(0), lang)).column(1).combine_chunks()
            # every text ends its last piece
            closed = pc.binary_join_element_wise(texts, "", "\n")
            first, last = (closed.buffers()[1][k * 4:k * 4 + 4] for k in (closed.offset, closed.offset + len(closed)))
            first, last = (int.from_bytes(bytes(x), "little") for x in (first, last))
            data = np.frombuffer(closed.buffers()[2], np.uint8)[first:last]
            for view in _windows(data, TOGETHER):
                words, piece = _words(view)
                if len(words):
                    yield lang, words.dictionary, words.indices.to_numpy(), piece

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= TOGETHER:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _cells(lang: str, words: pa.Array, codes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each pair of neighbours."""
    names = np.asarray([*words.to_pylist(), lang], dtype=object)
    hashes = pd.util.hash_array(names, categorize=False)
    salted = hashes[:-1] ^ hashes[-1]
    mixed = (salted[codes[:-1]] * np.uint64(0x9E3779B97F4A7C15) + salted[codes[1:]]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _count(bits: int):
    def run(batches):
        table = np.zeros(1 << bits, np.uint32)
        for lang, words, codes, piece in _parts(batches):
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), words, pa.array(n, pa.int64()), pa.nulls(len(words), pa.int32()),
                 pa.nulls(len(words), pa.binary())], names=["lang", "word", "n", "chunk", "cells"])
            cells = _cells(lang, words, codes, bits)[piece[1:] == piece[:-1]]
            np.add.at(table, cells, 1)
        if table.any():
            size = min(CHUNK, len(table))
            bytes_ = np.minimum(table, 255).astype(np.uint8)
            for k in range(0, len(table), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k // size], pa.int32()),
                     pa.array([bytes_[k:k + size].tobytes()], pa.binary())], names=["lang", "word", "n", "chunk", "cells"])

    return run


def _sum_cells(batches):
    """Cells of equal chunks added up, never beyond a byte."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(cells.as_buffer(), np.uint8).astype(np.uint16)
            sums[chunk] = np.minimum(sums[chunk] + own, 255) if chunk in sums else own
    for chunk, cells in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([cells.astype(np.uint8).tobytes()], pa.binary())],
                                         names=["chunk", "cells"])


def _linked(cells, bits: int, least: int):
    """The runs of words of which each pair of neighbours may reach the least count, with their number."""
    def run(batches):
        bounds = np.frombuffer(cells.value, np.uint8)
        for lang, words, codes, piece in _parts(batches):
            if len(codes) < 2:
                continue
            close = (piece[1:] == piece[:-1]) & (bounds[_cells(lang, words, codes, bits)] >= least)
            edge = np.diff(np.concatenate([[False], close, [False]]).astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # words begin..end-1
            if not len(begin):
                continue
            # long runs in parts: each word of a run starts phrases in one part, which goes on for LONGEST - 1 words
            times = (end - begin - 1) // STARTS + 1
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first = np.repeat(begin, times) + part * STARTS
            last = np.minimum(np.repeat(end, times), first + STARTS + LONGEST - 1)
            sizes = last - first
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                             words.take(pa.array(codes[places])))
            found = pc.binary_join(lists, " ").value_counts()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.field(0), found.field(1)],
                                             names=["lang", "run", "n"])

    return run


def _bound(whole: Column, part: Column) -> Column:
    """floor(SCALE * whole / part) of longs, exact beyond 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * whole.cast("decimal(20,0)"), part)


def _plus(a: Column, b: Column) -> Column:
    return a.cast("decimal(20,0)") + b.cast("decimal(20,0)")


def _first(phrase: str, words: int | Column) -> Column:
    """The first words of a phrase, or the last ones if ``words`` is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), F.lit(words) if isinstance(words, int) else words)


class Counts:
    """Exact counts of phrases in the stored runs, by what they begin with, end with or are."""

    def __init__(self, runs: DataFrame, least: int):
        self.runs, self.least = runs, least

    def occurrences(self, n: int) -> DataFrame:
        """``lang``, ``phrase``, ``times``: the phrases of n words at their places in the runs."""
        starts = F.least(F.lit(STARTS), F.size("w") - n + 1)
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), starts))
        runs = self.runs.select("lang", F.split("run", " ").alias("w"), F.col("n").alias("times"))
        return runs.select("lang", "times", F.explode(F.transform(at, lambda k: F.array_join(F.slice("w", k, F.lit(n)), " "))).alias("phrase"))

    def _summed(self, occurrences: DataFrame, name: str) -> DataFrame:
        return cut_lineage(occurrences.groupBy("lang", "phrase").agg(F.sum("times").alias("a")).filter(F.col("a") >= self.least), name)

    def all(self, n: int) -> DataFrame:
        return self._summed(self.occurrences(n), f"phrases-{n}")

    def around(self, n: int, begins: DataFrame, ends: DataFrame) -> DataFrame:
        """Phrases of n words that begin with a phrase of ``begins`` or end with one of ``ends`` (lang, phrase)."""
        def side(df, mark):
            return small_side(df.select(F.col("lang").alias(f"{mark}_lang"), F.col("phrase").alias(f"{mark}_of")))
        front, back = side(begins, "b"), side(ends, "e")
        found = self.occurrences(n).withColumn("front", _first("phrase", n - 1)).withColumn("back", _first("phrase", 1 - n))
        found = found.join(front, (F.col("lang") == F.col("b_lang")) & (F.col("front") == F.col("b_of")), "left").join(
            back, (F.col("lang") == F.col("e_lang")) & (F.col("back") == F.col("e_of")), "left")
        return self._summed(found.filter(F.col("b_of").isNotNull() | F.col("e_of").isNotNull()), f"grown-{n}")

    def of(self, n: int, wanted: DataFrame) -> DataFrame:
        wanted = small_side(wanted)
        return self._summed(self.occurrences(n).join(wanted, ["lang", "phrase"], "left_semi"), f"asked-{n}")


def scored(phrases: DataFrame, n: int, known: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, a) of n words with the lowest-scoring cut: score, k, l, r; ``known`` has all parts."""
    left, right = (known.select(F.col("lang").alias(f"{m}_lang"), F.col("phrase").alias(f"{m}_of"), F.col("a").alias(m)) for m in "lr")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n - 1)))).withColumn(
        "front", _first("phrase", F.col("k"))).withColumn("back", _first("phrase", F.col("k") - n))
    cuts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("front") == F.col("l_of"))).join(
        right, (F.col("lang") == F.col("r_lang")) & (F.col("back") == F.col("r_of")))
    best = F.min(F.struct(_bound(F.col("a"), _plus(F.col("l"), F.col("r"))).alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")


def _bounded(phrases: DataFrame, n: int, prefixes: DataFrame) -> DataFrame:
    """``phrases`` of n words with the bound of all that begins with them; ``prefixes``: lang, phrase, a, bound of n - 1 words."""
    up = prefixes.select(F.col("lang").alias("u_lang"), F.col("phrase").alias("u_of"), F.col("a").alias("u"), F.col("bound").alias("u_bound"))
    return phrases.join(up, (F.col("lang") == F.col("u_lang")) & (_first("phrase", n - 1) == F.col("u_of"))).select(
        "lang", "phrase", "a", F.least(F.col("u_bound"), _bound(F.col("a"), _plus(F.col("u"), F.col("a")))).alias("bound"))


def _reaching(df: DataFrame, goals: DataFrame, score: str) -> DataFrame:
    """Rows of the languages in ``goals`` whose ``score`` reaches the language's."""
    return df.join(goals, "lang").filter(F.col(score) >= F.col("goal")).drop("goal")


def _uncovered(found: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """``found`` without the phrases of n words that a phrase of one word more around them covers.

    A phrase two words longer that covers one has a phrase between both that is at least as frequent, so one word is enough.
    """
    around = longer.select("lang", F.col("a").alias("b"), F.explode(F.array(_first("phrase", n), _first("phrase", -n))).alias("phrase"))
    most = around.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    covered = 100 * F.col("b").cast("decimal(20,0)") >= COVERED_PERCENT * F.col("a").cast("decimal(20,0)")
    return found.join(most, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("b")


def _ranked(df: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def runs_of_texts(docs: DataFrame, lang_col: str, text_col: str, least: int, cell_bits: int) -> tuple[DataFrame, DataFrame]:
    """The word counts (lang, phrase, a) and the runs (lang, run, n), both stored."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = cut_lineage(texts.mapInArrow(_count(cell_bits), "lang string, word string, n bigint, chunk int, cells binary"), "phrase-first")
    words = cut_lineage(first.filter("chunk IS NULL").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("a")), "phrase-words")
    cells = first.filter("chunk IS NOT NULL").select("chunk", "cells").repartition("chunk").mapInArrow(_sum_cells, "chunk int, cells binary")
    table = b"".join(r["cells"] for r in sorted(cells.collect(), key=lambda r: r["chunk"])) or bytes(1 << cell_bits)
    shared = spark.sparkContext.broadcast(table)
    runs = texts.mapInArrow(_linked(shared, cell_bits, least), "lang string, run string, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    return words, cut_lineage(runs, "phrase-runs")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", best: int = BEST, least: int = LEAST,
         cell_bits: int = CELL_BITS) -> DataFrame:
    """The ``best`` surviving phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Counts cover all texts.  A null language is ``und``, null and empty texts have no word; repeated rows count as
    often as they appear; ties in score and count are ordered by the phrase; an empty table gives an empty result;
    other columns are not read.  ``cell_bits`` sets the size of the table of pairs, which changes the speed alone.
    """
    prepare(docs.sparkSession)
    words, runs = runs_of_texts(docs, lang_col, text_col, least, cell_bits)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    one = cut_lineage(words.filter(F.col("a") >= least), "phrases-1")
    counts = Counts(runs, least)
    two = counts.all(2)
    pairs = cut_lineage(scored(two, 2, one), "scored-2")
    # a word alone bounds its phrases by SCALE / 2, as does no prefix at all
    bound2 = cut_lineage(_bounded(two, 2, one.withColumn("bound", F.lit(SCALE).cast("long"))), "bounds-2")
    open_, settled, rank = pairs.select("lang").distinct(), None, 2 * best
    while True:
        # the score of so many pairs; 0 where there are fewer
        reached = _ranked(pairs, rank).filter(F.col("rank") == rank).select("lang", F.col("score").alias("goal"))
        goals = cut_lineage(open_.join(reached, "lang", "left").select("lang", F.coalesce("goal", F.lit(0)).alias("goal")), "goals")
        if goals.isEmpty():
            break
        small = small_side(goals)
        front2, top2 = (cut_lineage(_reaching(df, small, c), f"front-2-{c}") for df, c in ((bound2, "bound"), (pairs, "score")))
        three = counts.around(3, front2, top2)
        grown3 = _bounded(three, 3, front2)
        pairs3 = cut_lineage(scored(grown3.select("lang", "phrase", "a"), 3, one.unionByName(two)), "scored-3")
        front3, top3 = (cut_lineage(_reaching(df, small, c), f"front-3-{c}") for df, c in ((grown3, "bound"), (pairs3, "score")))
        four = counts.around(4, front3, top3)
        grown4 = cut_lineage(_bounded(four, 4, front3).select("lang", "phrase", "a"), "grown-4")
        tails = grown4.select("lang", _first("phrase", -3).alias("phrase")).distinct().join(three, ["lang", "phrase"], "left_anti")
        tails = counts.of(3, cut_lineage(tails, "tails"))
        top4 = _reaching(scored(grown4, 4, one.unionByName(two).unionByName(three).unionByName(tails)), small, "score")
        top = cut_lineage(_uncovered(top2, three, 2).unionByName(_uncovered(top3, four, 3)).unionByName(top4), "survivors")
        enough = top.groupBy("lang").count().filter(F.col("count") >= best).select("lang")
        done = cut_lineage(goals.filter("goal = 0").select("lang").unionByName(enough).distinct(), "settled")
        part = _ranked(top.join(small_side(done), "lang", "left_semi"), best)
        settled = part if settled is None else settled.unionByName(part)
        open_, rank = goals.select("lang").join(done, "lang", "left_anti"), 4 * rank
    if settled is None:
        settled = pairs.withColumn("rank", F.lit(0))
    return settled.join(small_side(cut_lineage(totals, "phrase-totals")), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
