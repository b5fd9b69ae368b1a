"""Helpers that several operators of this package share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloop.session import ensure_checkpoint_dir, ship_package, tables_root

__all__ = ["WORD", "held_out", "table", "prepare", "cut_lineage", "ensure_checkpoint_dir", "small_side",
           "pair_blocks", "runs_of"]

#: A word: a maximal run of characters other than the blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a side may have to be broadcast; a count proves it before the hint is given.
BROADCAST_ROWS = 200_000


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch carries to a Python worker, by rows and by bytes; give the workers this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    ensure_checkpoint_dir(spark)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder, and read from there.

    A lost executor never makes upstream work run again; ``release_tables`` deletes it.  Zstandard keeps the table small, and its buffers do
    not pile up outside the heap as those of the default codec do over many small files.
    """
    spark = df.sparkSession
    path = f"{tables_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the ids that no model learns from (a null id counts as the empty text)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stored table of narrow rows) with a broadcast hint if a count proves it small.

    Beyond ``max_rows`` the hint is left out: Spark then joins by a shuffle, and its
    adaptive skew join splits hot keys.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def pair_blocks(df: DataFrame, keys: Sequence[str], member: str, block_rows: int) -> DataFrame:
    """Split the groups of ``keys`` that hold more than ``block_rows`` rows into blocks.

    Adds ``own`` (the block of the row) and ``left``/``right``: a group of k blocks becomes the
    k(k+1)/2 block pairs ``left <= right``, a row goes to the k pairs that name its block, so that any
    two rows of a group meet exactly once: rows of one block in (b, b), of two blocks in (a, b).
    Ordinary groups stay whole as (0, 0).  Hot groups thus never land in one task.  ``df`` is read twice:
    pass a stored table.  The table of hot groups has at most rows / block_rows rows.
    """
    hot = df.groupBy(*keys).count().filter(F.col("count") > block_rows).select(
        *keys, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    hot = small_side(cut_lineage(hot, "hot-groups"))
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("blocks")).cast("int")
    dealt = df.join(hot, list(keys), "left").withColumn("own", F.coalesce(own, F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    return dealt.withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")).drop(
        "blocks", "other")


def runs_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` of a sorted partition, one at a time.

    Memory: one run and one batch.  ``keys`` are integer columns without nulls.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols:
            changes |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(changes) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def blocks_for(rows: int, radius: int, bits: int = 64, shard_rows: int = 64) -> int:
    """Blocks to cut ``bits`` into so that shards that agree on all but ``radius`` blocks stay small."""
    blocks = radius + 1
    while blocks < bits // 4 and rows / 2 ** math.floor(bits * (blocks - radius) / blocks) > shard_rows:
        blocks += 1
    return blocks
