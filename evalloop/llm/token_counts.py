"""Token counts by a two-tier lookup of pre-tokens inside the tasks; no pre-token is ever shuffled.

Tier one is a compact hash table of frequent pre-tokens and their lengths in tokens: open addressing over an
Arrow string array, looked up for all distinct pre-tokens of a batch at once, and small enough to be broadcast
(its number of entries and the size of an entry are bounded).  Tier two encodes what the table lacks, in a cache
that each worker keeps and bounds.  Which pre-tokens the table holds changes the speed alone, never a count, so
they are counted over a bounded sample of rows (``SAMPLE_ROWS``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.llm import bpe
from evalloop.llm.common import cut_lineage, prepare
from evalloop.llm.terms import Remembered

#: Entries of the frequent table, and the longest pre-token (in characters) that it holds.
ENTRIES = 1 << 16
LONGEST = 32
#: Rows, about, whose pre-tokens decide what the table holds.
SAMPLE_ROWS = 4_000
#: Pre-tokens that a task of the sample counts at once; beyond it the rarer half is forgotten.
COUNTED = 1 << 18
#: Pre-tokens that are looked up together, and the characters of a text from which it is read piece by piece.
TOGETHER = 1 << 17
LONG_TEXT = 1 << 20
#: Tokens beyond which a text is over the limit.
LIMIT = 1024


class LengthTable:
    """Lengths in tokens by pre-token: open addressing with linear probing; ``find`` looks many up at once."""

    def __init__(self, keys: list[str], lengths: list[int]):
        self.keys = pa.array(keys, pa.string())
        self.lengths = np.array(lengths, dtype=np.int32)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(size, -1, dtype=np.int32)
        for k, at in enumerate(self._home(self.keys)):
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = k

    def _home(self, keys: pa.Array) -> np.ndarray:
        names = np.asarray(keys.to_pylist(), dtype=object)
        return (pd.util.hash_array(names, categorize=False) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: pa.Array) -> np.ndarray:
        """The length of each key, -1 where the table does not hold it; equal hashes are told apart by the keys."""
        found = np.full(len(keys), -1, dtype=np.int32)
        if not len(keys) or not len(self.keys):
            return found
        at, open_ = self._home(keys), np.arange(len(keys))
        while len(open_):
            entry = self.slots[at]
            there = entry >= 0
            at, open_, entry = at[there], open_[there], entry[there]
            same = pc.equal(self.keys.take(pa.array(entry)), keys.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            found[open_[same]] = self.lengths[entry[same]]
            at, open_ = (at[~same] + 1) & (len(self.slots) - 1), open_[~same]
        return found


def pre_tokens(own: bpe.Codec, text: str) -> Iterator[str]:
    """The pre-tokens of a text; a special string of the vocabulary is one by itself."""
    for k, part in enumerate(own.cut.split(text) if own.cut else [text]):
        if k % 2:
            yield part
        elif part:
            pattern = bpe._ANY if bpe._BEYOND_LATIN.search(part) else bpe._LATIN
            if len(part) < LONG_TEXT:
                yield from pattern.findall(part)
            else:
                yield from (m.group() for m in pattern.finditer(part))


class Lengths:
    """Both tiers in a worker: the broadcast table, then the cache over the encoder."""

    def __init__(self, own: bpe.Codec, table: LengthTable):
        self.own, self.table = own, table
        self.cache = Remembered(lambda p: 1 if p in own.special else len(own.encode_piece(p)))

    def of(self, pieces: list[str]) -> np.ndarray:
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        lengths = self.table.find(coded.dictionary).astype(np.int64)
        misses = np.flatnonzero(lengths < 0)
        lengths[misses] = [self.cache[p] for p in coded.dictionary.take(pa.array(misses)).to_pylist()]
        return lengths[coded.indices.to_numpy()]

    def count(self, texts: Iterable[str]) -> list[int]:
        """The number of tokens of each text; pre-tokens of several texts are looked up together, parts of long ones apart."""
        totals: list[int] = []
        held: list[str] = []
        owner: list[tuple[int, int]] = []  # text, number of its pre-tokens among those held

        def flush():
            sums = np.concatenate([[0], np.cumsum(self.of(held))]) if held else [0]
            at = 0
            for text, n in owner:
                totals[text] += int(sums[at + n] - sums[at])
                at += n
            held.clear()
            owner.clear()

        for k, text in enumerate(texts):
            totals.append(0)
            pieces = pre_tokens(self.own, text)
            while part := list(islice(pieces, TOGETHER)):
                held += part
                owner.append((k, len(part)))
                if len(held) >= TOGETHER:
                    flush()
        flush()
        return totals


def frequent(docs: DataFrame, spec, text_col: str = "text", entries: int = ENTRIES, sample_rows: int = SAMPLE_ROWS) -> LengthTable:
    """The table of the ``entries`` most frequent pre-tokens of about ``sample_rows`` rows.

    The sample is drawn by row, so copies of one text do not fill it.  Each of at most eight tasks counts with
    bounded memory and hands over its most frequent pre-tokens; the driver adds up at most 8 x ``entries`` short rows.
    """
    rows = docs.count()
    part = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if rows > sample_rows:
        part = part.filter(F.rand(11) < sample_rows / rows)
    part = cut_lineage(part, "token-sample").coalesce(8)

    def tally(batches):
        own, seen = bpe.codec(spec.value), Counter()
        for batch in batches:
            for text in batch.column(0):
                pieces = pre_tokens(own, text.as_py())
                while some := list(islice(pieces, TOGETHER)):
                    seen.update(p for p in some if len(p) <= LONGEST)
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(entries)
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                             names=["piece", "n"])

    total: Counter = Counter()
    for row in part.mapInArrow(tally, "piece string, n bigint").collect():
        total[row["piece"]] += row["n"]
    own = bpe.codec(spec.value)
    keys = [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    return LengthTable(keys, [1 if p in own.special else len(own.encode_piece(p)) for p in keys])


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
           entries: int = ENTRIES) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row: whole texts, tokens of the vocabulary at ``path``.

    One pass without a shuffle beside the small one over the sample.  Null texts count as empty (no bytes, no
    tokens); special strings of the vocabulary inside a text are one token, as its library's default has it; ids may be
    null or repeat; texts of any length are read whole, in parts of ``TOGETHER`` pre-tokens; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    spec = bpe._shared(docs, path)
    table = spark.sparkContext.broadcast(frequent(docs, spec, text_col, entries))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        lengths = Lengths(bpe.codec(spec.value), table.value)
        for batch in batches:
            n = lengths.count(t.as_py() for t in batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                             names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
