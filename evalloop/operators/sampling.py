"""Positional index, per-group samples, limits and seeded shuffles.

Hot groups: one dataset (or question) may hold a third of all rows, so no
operator here puts a whole group into one task.  Positions are computed after
a range partitioning on (group, order) keys, which splits a hot group across
many tasks; per-group samples keep a map-side top-n per partition first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloop.session import cut_lineage


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond &= F.col(a).eqNullSafe(F.col(b))
    return cond


#: Groups are counted in so many hashed slots: the counts stay small whatever the data.
SLOTS = 1 << 16
#: Rows of a slot that one task may sort; groups in larger slots are spread over many tasks.
HOT_ROWS = 50_000


def index_within_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                       index_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, by ``order_cols``.

    Rows that tie take the positions of their tie, each once.  One pass over the group
    columns counts the rows of hashed slots.  Groups of small slots are numbered by a
    window: one shuffle of the rows.  Only groups in slots of more than ``HOT_ROWS`` rows
    are indexed as ranges of keys (:func:`_index_hot_groups`), so a hot group spreads over many tasks.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    slot = F.pmod(F.xxhash64(*group_cols), F.lit(SLOTS))
    crowded = df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = [r["_slot"] for r in crowded.select("_slot").collect()]  # at most SLOTS numbers
    number = F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order_cols)) - 1
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not hot:
        return df.select(*columns, number.cast("long").alias(index_col))
    few = df.filter(~slot.isin(hot)).select(*columns, number.cast("long").alias(index_col))
    return few.unionAll(_index_hot_groups(df.filter(slot.isin(hot)), group_cols, order_cols, index_col, num_partitions))


def _index_hot_groups(df: DataFrame, group_cols: list[str], order_cols: list[str], index_col: str,
                      num_partitions: int | None) -> DataFrame:
    """:func:`index_within_group` for groups of any size.

    Only the keys are indexed: they are range-partitioned on (group, order) and stored with the
    number of their partition.  Offsets (rows of the group in earlier partitions) and local
    positions both come from this one stored copy, so they always belong to the same
    partitioning; the positions are then joined back to the wide rows on (group, order).
    """
    keys = group_cols + order_cols
    g, k = [f"_g{i}" for i in range(len(group_cols))], [f"_k{i}" for i in range(len(keys))]
    narrow = df.groupBy(*[F.col(c).alias(n) for c, n in zip(keys, k)]).agg(F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    parts = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    stored = cut_lineage(narrow.repartitionByRange(parts, *k).withColumn("_pid", F.spark_partition_id()), "positions")
    own = k[:len(group_cols)]
    # one row per partition and group in it
    sizes = stored.groupBy("_pid", *own).agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*own).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(n) for c, n in zip(own, g)],
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_pid", *own).orderBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.withColumn("_local", F.coalesce(F.sum("_n").over(local), F.lit(0))).join(
        offsets, (F.col("_pid") == F.col("_opid")) & _same(own, g))
    placed = placed.select(*k, (F.col("_local") + F.col("_offset")).alias("_position"), "_n")
    own_columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.join(placed, _same(keys, k))
    if stored.filter("_n > 1").isEmpty():
        return rows.select(*own_columns, F.col("_position").alias(index_col))
    return rows.filter("_n = 1").select(*own_columns, F.col("_position").alias(index_col)).unionAll(
        _apart(rows.filter("_n > 1"), k).select(*own_columns, (F.col("_position") + F.col("_nth")).alias(index_col)))


def _apart(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` that tie in ``keys``, stored, with ``_nth`` from 0 among their like.

    Rows are counted per stored part first, so a tie that holds a third of all rows is numbered in many tasks.
    """
    rows = cut_lineage(rows.withColumn("_place", F.monotonically_increasing_id()), "ties").withColumn(
        "_part", F.shiftright("_place", 33))
    names = [f"{k}_of" for k in keys]
    earlier = Window.partitionBy(*names).orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_part").alias("_of_part")).count().withColumn(
        "_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_place")) - 1
    return rows.withColumn("_own", local).join(parts, _same(keys, names) & (F.col("_part") == F.col("_of_part"))).withColumn(
        "_nth", F.col("_own") + F.col("_before"))


def sample_per_group(df: DataFrame, group_col: str, key_col: str, n: int | None = 4, seed: int = 42,
                     order=None) -> DataFrame:
    """L3: ``min(n, size)`` rows per group without replacement, seeded; ``n=None`` keeps all (full mode).

    A row's rank is ``xxhash64(key, seed)`` (or the given ``order`` column; ties
    by key), independent of input order.  Spark limits the window on the map side
    (a partial group limit), so a hot group sends at most ``n`` rows per
    partition to the final ranking.
    """
    h = F.xxhash64(F.col(key_col), F.lit(seed)) if order is None else order
    ranked = df.withColumn("_h", h)
    if n is None:
        return index_within_group(ranked, [group_col], ["_h", key_col], "sample_rank").drop("_h")
    w = Window.partitionBy(group_col).orderBy("_h", key_col)
    return (ranked.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= n)
            .withColumn("sample_rank", F.col("sample_rank") - 1).drop("_h"))


def pick_one(df: DataFrame, key_col: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """L4: the row whose key has the smallest seeded hash, or the smallest ``order`` (ties by key)."""
    h = F.xxhash64(F.col(key_col), F.lit(seed)) if order is None else order
    best = df.select(F.min_by(F.col(key_col), F.struct(h, F.col(key_col))).alias("_pick"))  # one row
    return df.join(F.broadcast(best), F.col(key_col) == F.col("_pick"), "left_semi")


#: Outputs per question that the sampler may draw; arrays of outputs hold no more.
SAMPLER_N = 1024


def bounded_outputs(candidates: DataFrame, most: int = SAMPLER_N, cand_idx: str = "cand_idx") -> DataFrame:
    """``candidates``, checked row by row: an index of ``most`` or more is an error.

    Outputs of a question are numbered from 0, so what is gathered into one row
    per question (prompts, prediction arrays) stays below ``most`` outputs; a
    question beyond the sampler's n stops the job instead of filling one task.
    """
    ok = F.when(F.col(cand_idx) < most, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"more than {most} outputs of a question: index "), F.col(cand_idx).cast("string"))).cast("boolean"))
    return candidates.filter(ok)


def head_limit(df: DataFrame, n: int | None, order_cols: Sequence[str]) -> DataFrame:
    """L1: first ``n`` rows by input order; ``None``/0 keeps all (CLI truthiness)."""
    if not n:
        return df
    return df.orderBy(*order_cols).limit(int(n))


def seeded_shuffle(df: DataFrame, key_cols: Sequence[str], seed: int = 42, order: Column | None = None) -> DataFrame:
    """Reproducible shuffle order, exposed as a ``shuffle_key`` to sort by."""
    h = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)) if order is None else order
    return df.withColumn("shuffle_key", h)


def latest_by_step(df: DataFrame, group_cols: Sequence[str], name_col: str,
                   pattern: str = r"^checkpoint-(\d+)$") -> DataFrame:
    """L7 (re-aimed): per group, the name with the highest step number."""
    step = F.regexp_extract(F.col(name_col), pattern, 1)
    valid = df.filter(F.col(name_col).rlike(pattern)).withColumn("step", step.cast("long"))
    return valid.groupBy(*group_cols).agg(
        F.max_by(F.col(name_col), F.col("step")).alias(name_col), F.max("step").alias("step"))


def missing_shards(index_df: DataFrame, listing_df: DataFrame, map_col: str = "weight_map",
                   file_col: str = "file") -> DataFrame:
    """L8 (re-aimed): shards named by an index's weight map that are not listed."""
    needed = index_df.select(F.explode(F.map_values(F.col(map_col))).alias(file_col)).distinct()
    return needed.join(listing_df.select(file_col), file_col, "left_anti")


def ordered(df: DataFrame, *cols: str | Column) -> DataFrame:
    """L2: restore input order at the sink."""
    return df.orderBy(*cols)
