"""Rows that share a key meet block by block: no task holds a whole hot bucket, and every pair meets once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.session import cut_lineage


#: Rows that the table of hot buckets may have to be broadcast; a count proves it.
BROADCAST_ROWS = 200_000


def dealt(df: DataFrame, key: str, member: str, rows: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """The rows of ``df`` dealt to block pairs of their bucket (equal ``key``) and sorted by them: one shuffle.

    A bucket of m rows is cut into ``ceil(m / rows)`` blocks (more if its ``weight`` sums to over ``most`` a block) by a
    hash of ``member``.  Adds ``own``, the block of the row, and ``left <= right``, a block pair that it takes part in:
    two rows of one block meet in (b, b), of two blocks in (a, b).  ``df`` is read twice: it should come from a stored table.
    """
    blocks = F.ceil(F.col("_m") / rows)
    if weight:
        blocks = F.greatest(blocks, F.least(F.ceil(F.col("_w") / most), F.col("_m")))
    hot = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), F.sum(weight or F.lit(1)).alias("_w")).select(
        F.col(key).alias("_key"), blocks.cast("int").alias("_blocks")).filter("_blocks > 1"), "hot-buckets")
    met = df.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, F.col(key) == F.col("_key"), "left")
    several = F.coalesce(F.col("_blocks"), F.lit(1))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), several).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), several - 1)))
    met = met.withColumn("left", F.least("own", "_other")).withColumn("right", F.greatest("own", "_other")).drop("_key", "_blocks", "_other")
    return met.repartition(key, "left", "right").sortWithinPartitions(key, "left", "right")


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal ``keys`` (integers without nulls) of a sorted partition, as many as a batch ends, with where each starts.

    Memory: one batch and the longest run.
    """
    held: list[pa.RecordBatch] = []
    last = None

    def cut(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        cols = np.stack([table[k].to_numpy().astype(np.int64) for k in keys])
        starts = np.concatenate([[0], np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1])
        return table, starts

    for batch in batches:
        if not batch.num_rows:
            continue
        first, end = (tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1))
        if held and first == end == last:
            held.append(batch)  # the run goes on and does not end here
            continue
        held.append(batch)
        last = end
        table, starts = cut(held)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        held = table.slice(int(starts[-1])).to_batches()
    if held:
        yield cut(held)


def sides(own: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows of the left and of the right block in a run."""
    return np.flatnonzero(own == left), np.flatnonzero(own == right)


def common(flat: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, chunk: int = 2048) -> np.ndarray:
    """How many values each row of ``a`` shares with each of ``b``; ``flat[i]`` belongs to ``row[i]`` of ``n`` rows, once.

    A product of 0/1 matrices over the values that occur more than once, ``chunk`` of them at a time.
    """
    out = np.zeros((len(a), len(b)), np.float32)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = times[at] > 1
    at, row = at[kept], row[kept]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, chunk):
        lo, hi = np.searchsorted(at, [start, start + chunk])
        held = np.zeros((n, int(at[hi - 1]) - start + 1), np.float32)
        held[row[lo:hi], at[lo:hi] - start] = 1
        out += held[a] @ held[b].T
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """For every row of a symmetric link matrix the first row of its component; each row is expanded once."""
    root = np.full(len(linked), -1)
    for start in np.flatnonzero(linked.any(axis=1)):
        if root[start] >= 0:
            continue
        front = np.array([start])
        root[start] = start
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[front] = start
    return np.where(root < 0, np.arange(len(linked)), root)
