import random
import re

import numpy as np
import xxhash

from evalloop.llm import queries, simhash
from evalloop.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, radius=4):
    """Smallest id per component, by comparing all fingerprints."""
    arr, group = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(arr)):
        for k in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= radius):
            a, b = root(i), root(i + 1 + int(k))
            group[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprint_of_long_and_short_texts(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(1)
    texts = ["", " \n", "One", "a b c", "a b c d", "É Bé 中 c d e F", "x " * 50]
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(1, 80))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(12):  # clusters and chains of few flipped bits
        x = rng.getrandbits(64)
        for _ in range(60):
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4)))
            x &= (1 << 64) - 1
            values.add(x)
    values = sorted(values)
    want = plain_components(values, values)
    stored = simhash.cut_lineage(spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long"))
    for shard_rows in (4096, 5):
        found = components(simhash.links(stored, 4, shard_rows)).collect()
        label = {r.node & (1 << 64) - 1: r.label & (1 << 64) - 1 for r in found}
        groups = {}
        for v, w in zip(values, want):
            groups.setdefault(w, set()).add(label.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_more_blocks_still_meet_every_pair():
    rng = random.Random(3)
    for blocks in (5, 6, 7):
        kept = simhash.masks(blocks, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), 4):
                b ^= 1 << k
            assert any(a & m == b & m for m in kept)


def test_a_large_cluster_costs_few_comparisons():
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 3000:
        values.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))))
    values.discard(centre)
    values = [centre, *values]
    seen = 0

    class Counting(simhash.LinkTree):
        def search(self, x, me, top):
            nonlocal seen
            before = self.root
            self.root = lambda i: count() or before(i)
            super().search(x, me, top)
            del self.root

    def count():
        nonlocal seen
        seen += 1
    tree = Counting(4)
    for v in values:
        tree.add(v)
    assert len(tree.star()) == len(values) - 1
    assert seen < 40 * len(values)


def test_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == odd.count() and len(by[5]) == 2
    assert {r.fingerprint for k in (1, 2, 3) for r in by[k]} == {"0" * 16}
    assert {by[k][0].component_id for k in (1, 2, 3)} == {1}
    assert by[7][0].component_id == 5 and by[None][0].component_id == 5
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 5, 6, 8]


def test_exactly_one_row_of_each_component_stays(spark, odd, documents):
    kept = simhash.one_per_component(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 8]
    assert simhash.one_per_component(odd.limit(0)).count() == 0
    same, other = "one two three four five six", "quite another text that is unique here"
    rows = [(1, same, "en", "s", 1), (2, same, "en", "s", 1), (2, other, "en", "s", 2), (3, "null ids only in this group", "en", "s", 3)]
    rows += [(None, same, "en", "s", 1)] * 3 + [(None, "no id at all for this text", "en", "s", 4)] * 2
    df = documents(rows)
    want = {(1, same), (2, other), (3, rows[3][1]), (None, rows[-1][1])}
    got = [(r.doc_id, r.text) for r in simhash.one_per_component(df.repartition(4)).collect()]
    assert len(got) == 4 and set(got) == want
    assert (2, other) in {(r.doc_id, r.text) for r in simhash.keep_one(df).collect()}  # only the other row of id 2 is a copy


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    least = plain_components(fps, [r.doc_id for r in docs])
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, least)}
    assert {tuple(r) for r in queries.op6_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_components_of_chains_and_hubs(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 1 for k in range(1, 40))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
