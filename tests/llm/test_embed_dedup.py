import numpy as np
import pytest
from pyspark.sql import types as T

from evalloop.llm import embed_dedup, queries

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(ids, vectors, threshold=0.95):
    """Links and the smallest reachable id of every vector, by comparing all."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[k], label[near[k]].min(initial=label[k])) for k in range(len(ids))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def clustered(rng, n=1200, size=64):
    centres = rng.normal(size=(40, size))
    rows = [centres[rng.integers(40)] + rng.normal(size=size) * rng.choice([0.0, 0.1, 0.2, 0.3, 3.0]) for _ in range(n)]
    return np.array(rows, dtype=np.float32)


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_recall_and_precision_against_brute_force(spark, monkeypatch, block_rows):
    rng = np.random.default_rng(1)
    x = clustered(rng)
    links, label = brute(range(len(x)), x)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(embed_dedup.pairs, "__defaults__", (0.95, 17, block_rows))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    same = np.array([got[k].component_id for k in range(len(x))]) == label
    assert same.mean() >= 0.99
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_transform_is_orthogonal_and_fast_form_equals_the_matrix():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 16))
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embed_dedup.hadamard(x), x @ h.T / 4)
    assert np.allclose(np.linalg.norm(embed_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_buckets_begin_with_the_own_one_and_differ():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 32))
    found = embed_dedup.buckets(x / np.linalg.norm(x, axis=1, keepdims=True), embed_dedup.rotations(32, 1)[0])
    assert found.shape == (50, 1 + embed_dedup.PROBES)
    assert all(len(set(row)) == len(row) for row in found.tolist())


def test_query_over_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    links, label = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op8_embeddings(spark, sf).collect()}
    assert got == {r.vec_id: (int(n), int(c)) for r, n, c in zip(rows, links, label)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]),
            (8, [1.0, 0.0]), (9, [2.0, 0.001]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]), (12, [0.0, 5.0]),
            (13, [0.0, 1e-30]), (14, [3.0]), (15, [-0.0, 5.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in ("c", "digest", "n", "size", "_id", "label", "vec")])
    got = {}
    for r in embed_dedup.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    for k in (1, 2, 3, 4, 5, 6, 10, 11, 14):
        assert got[k] == [(0, k, True)], k
    assert got[7] == [(4, 7, True)] and got[8] == [(4, 7, False)] * 2 and got[9] == [(4, 7, False)]
    assert got[None][0][:2] == (4, 7)
    assert got[12] == [(2, 12, True)] and got[13] == [(2, 12, False)] and got[15] == [(2, 12, False)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
