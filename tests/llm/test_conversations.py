"""The conversation trie: equal to a plain recursion over lists of turns, however the ranges are cut."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import types as T

from evalloop.llm import conversations as cv

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            id_ = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, id_, role, text))
    paths = {}
    for c in own:
        own[c].sort()
    for c in own:
        h, base = crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(t[3:] for t in own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves = 0 if children[p] else 1
        for k in children[p]:
            saved, leaves = saved + sums[k][0], leaves + sums[k][1]
        sums[p] = (saved, leaves)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sums[p][1], sums[p][0],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(rows, spark, clash=()):
    schema = T.StructType(SCHEMA.fields + [T.StructField(c, T.StringType()) for c in clash])
    return spark.createDataFrame([(*r, *["x" for _ in clash]) for r in rows], schema)


def check(spark, rows, **kw):
    got = cv.trie(made(rows, spark), **kw)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def random_rows(seed, convs=120, texts=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "béé", "", None][:texts + 1]))
            for c in range(-7, convs) for t in range(rng.choice([1, 2, 3, 12]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    check(spark, random_rows(seed))


def test_any_cut_into_ranges(spark):
    rows = random_rows(3, 40)
    for range_turns in (1, 5, 40):
        check(spark, rows, range_turns=range_turns)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted((tuple(r) for r in cv.trie(df, range_turns=100).collect()), key=str) == brute([tuple(r) for r in df.collect()])


def test_copies_spread_over_ranges_and_their_ids_over_rows(spark, monkeypatch):
    rows = [(c, t, "user", f"text {t}") for c in range(0, 3000, 5) for t in range(3)] + [(7, None, "user", "text 0"), (7, 0, "user", "text 1")]
    monkeypatch.setattr(cv, "ENDS_ROW", 7)
    check(spark, rows, range_turns=50)


def test_odd_rows(spark):
    big = 1 << 62
    rows = [(0, 0, None, None), (0, 0, None, None), (0, None, "user", "x" * 100_000), (None, 0, "user", "lost"), (11, 0, "user", "only"),
            (big, 0, "a", "b"), (-big, 3, "a", "b"), (4, 1, "us", "er"), (4, 2, "u", "ser"), *[(20, t, "user", str(t)) for t in range(3000)]]
    check(spark, rows)
    got = cv.trie(made(rows, spark, ["base", "conv", "key", "id", "part", "n", "kind", "t"]))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert cv.trie(made([], spark)).collect() == []


def test_layouts_grow_and_paths_are_compressed():
    tree, rng = cv.RadixTree(), random.Random(5)
    keys = {bytes(rng.randrange(256) for _ in range(cv.TURN * rng.randint(0, 3))) for _ in range(600)}
    keys |= {bytes([k]) + bytes(cv.TURN - 1) for k in range(256)}
    for key in keys:
        tree.insert(key, [1] * (len(key) // cv.TURN)).convs.append(len(key))
    assert tree.root.layout() == 256 and sorted(b for b, _ in tree.root.items()) == list(range(256))
    ids = {hashlib.sha256(key[:d]).digest()[:cv.TURN] for key in keys for d in range(0, len(key) + 1, cv.TURN)}
    assert {n.id for n in cv.nodes(tree)} == ids

    def count(node):
        return 1 + sum(count(c) for _, c in node.items())

    assert count(tree.root) < 2 * len(keys) + 2  # far fewer nodes than bytes
    node = cv.Node(b"")
    layouts = []
    for k in range(60):
        node.put(255 - k, cv.Node(b""))
        layouts.append(node.layout())
    assert (layouts[3], layouts[4], layouts[15], layouts[16], layouts[47], layouts[48]) == (4, 16, 16, 48, 48, 256)
    assert [b for b, _ in node.items()] == list(range(196, 256)) and node.find(3) is None
