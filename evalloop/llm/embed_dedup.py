"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Each table rotates the unit vectors by three rounds of random signs and a Walsh-Hadamard transform and hashes a
vector to the nearest signed axis, once per rotation.  A vector is stored in its own bucket of each table and
looked up in that bucket and the next probable ones.  What meets in a bucket is compared in blocks of
matrix products in double precision; only pairs at or above the threshold leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import cut_lineage, pair_blocks, prepare, runs_of
from evalloop.llm.components import components

THRESHOLD = 0.95
#: Tables, rotations of each (their axes together are the bucket), and further buckets looked up per table.
TABLES, ROTATIONS, PROBES = 8, 2, 3
#: Rows of a bucket compared in one task; larger buckets are split into pairs of blocks.
BLOCK_ROWS = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, step = x.shape[1], 1
    x = x.copy()
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotations(size: int, seed: int) -> np.ndarray:
    """Random signs of the three rounds of every table and rotation."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (TABLES, ROTATIONS, 3, size))


def buckets(unit: np.ndarray, signs: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """For one table: a row of ``1 + probes`` bucket numbers per vector, its own first, then the nearest others.

    Another bucket replaces the axis of one rotation by a further one; how far is the loss of projection.
    """
    axes, loss = [], []
    for three in signs:
        x = unit
        for s in three:
            x = hadamard(x * s)
        both = np.concatenate([x, -x], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :probes + 1]
        axes.append(top)
        far = np.take_along_axis(both, top, axis=1)
        loss.append(far[:, :1] - far)
    width = 2 * unit.shape[1]
    place = [width ** k for k in range(len(axes))]
    own = sum(a[:, 0].astype(np.int64) * p for a, p in zip(axes, place))
    moved = np.concatenate([own[:, None] + (a[:, 1:].astype(np.int64) - a[:, :1]) * p for a, p in zip(axes, place)], axis=1)
    near = np.argsort(np.concatenate([d[:, 1:] for d in loss], axis=1), axis=1, kind="stable")[:, :probes]
    return np.concatenate([own[:, None], np.take_along_axis(moved, near, axis=1)], axis=1)


def _units(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored tables: ``_id``, ``digest`` of every row (null digest: links with nothing), and the classes of equal vectors."""
    v = F.col("_vec")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"  # half the bytes to shuffle
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("_vec"))
    name = F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(",", F.transform(v, lambda x: (x + 0.0).cast("string"))).cast("binary"), 256))
    rows = cut_lineage(rows.select("_id", "_vec", name.alias("digest")), "vectors")
    own = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("_id").alias("least"), F.count("*").alias("n"), F.first("_vec").alias("vec"))
    own = own.select(F.xxhash64("digest").alias("c"), "digest", "least", "n", "vec", F.size("vec").alias("size"))
    return rows.select("_id", "digest"), cut_lineage(own, "vector-classes")


def pairs(classed: DataFrame, threshold: float = THRESHOLD, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a < b``: the found pairs of classes with a cosine of ``threshold`` or more, each once, as a stored table."""
    keyed = classed.select("c", "size", "vec")

    def hashed(batches):
        signs: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                unit = _units(part.column("vec"))
                wide = 1 << max(0, int(size) - 1).bit_length()
                padded = np.pad(unit, ((0, 0), (0, wide - unit.shape[1])))
                if wide not in signs:
                    signs[wide] = rotations(wide, seed)
                for t in range(TABLES):
                    found = buckets(padded, signs[wide][t])
                    for k in range(found.shape[1]):
                        yield pa.RecordBatch.from_arrays(
                            [part.column("c"), pa.array([int(size)] * len(found), pa.int32()), pa.array([t] * len(found), pa.int32()),
                             pa.array(found[:, k]), pa.array([k == 0] * len(found))], names=["c", "size", "t", "bucket", "stored"])

    places = cut_lineage(keyed.mapInArrow(hashed, "c bigint, size int, t int, bucket bigint, stored boolean"), "vector-buckets")
    keys = ["size", "t", "bucket"]
    # a bucket that nothing, or only one vector, is stored or looked up in, gives no pair
    used = places.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("stored").alias("any")).filter("rows > 1 AND any")
    places = places.join(cut_lineage(used.select(*keys), "vector-used-buckets"), keys, "left_semi")
    dealt = pair_blocks(cut_lineage(places, "vector-places"), keys, "c", block_rows)
    keys += ["left", "right"]
    dealt = dealt.join(keyed.select("c", "vec"), "c").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        for rows in runs_of(batches, keys):
            if rows.num_rows < 2:
                continue
            left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
            unit, ids = _units(rows.column("vec").combine_chunks()), rows.column("c").to_numpy()
            own, stored = rows.column("own").to_numpy(), rows.column("stored").to_numpy()
            target = np.flatnonzero(stored)
            found = []
            for k in range(0, len(ids), 512):
                some = np.arange(k, min(k + 512, len(ids)))
                close = unit[some] @ unit[target].T >= threshold
                i, j = np.nonzero(close)
                i, j = some[i], target[j]
                if left != right:
                    cross = own[i] != own[j]
                    i, j = i[cross], j[cross]
                apart = ids[i] != ids[j]
                found.append(np.stack([np.minimum(ids[i], ids[j])[apart], np.maximum(ids[i], ids[j])[apart]], axis=1))
            both = np.unique(np.concatenate(found), axis=0)
            for k in range(0, len(both), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(both[k:k + (1 << 16), 0]), pa.array(both[k:k + (1 << 16), 1])], names=["a", "b"])

    return cut_lineage(dealt.select(*keys, "own", "stored", "c", "vec").mapInArrow(compare, "a bigint, b bigint").distinct(), "vector-pairs")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Equal vectors form a class and are compared once; a row's links are the other rows of its class and all rows of
    the linked classes.  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths; rows that repeat an id are linked like any others; a null id
    is never the smallest of a component; an empty table gives an empty result; other columns are not read.
    """
    prepare(vectors.sparkSession)
    rows, classed = classes(vectors, id_col, vec_col)
    found = pairs(classed, threshold)
    narrow = classed.select("c", "digest", "least", "n")
    sizes = narrow.select(F.col("c").alias("b"), "n")
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes, "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("more"))
    labels = components(found).withColumnRenamed("node", "c")
    reached = cut_lineage(labels.join(narrow, "c").select("c", "label", "least"), "vector-reached")
    least = cut_lineage(reached.groupBy("label").agg(F.min("least").alias("component")), "vector-components")
    answer = narrow.join(links, "c", "left").join(reached.join(least, "label").select("c", "component"), "c", "left").select(
        F.col("digest").alias("of"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"),
        F.coalesce("component", "least").alias("component"))
    out = rows.join(cut_lineage(answer, "vector-answers"), F.col("digest") == F.col("of"), "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
