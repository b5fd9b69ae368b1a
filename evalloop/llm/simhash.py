"""Near-duplicates by SimHash fingerprints, searched with BK-trees.

Fingerprints are linked when they differ in at most ``radius`` bits.  The 64 bits are cut into
``radius + 1`` blocks or more; two linked fingerprints agree on all but ``radius`` of them, so every choice
of the other blocks is a table of shards, and each linked pair shares a shard of some table.  A shard is one
BK-tree (children keyed by their Hamming distance to the parent); a search follows only the edges within
the radius, and skips subtrees that already belong wholly to the searcher's component: a cluster of
thousands of near copies costs each of them a few comparisons, not a comparison with all the others.
A shard gives a star of links per component, never all pairs.  Shards over ``shard_rows`` are split into
block pairs, the tree of one block being searched with the members of the other, so no shard is one
task's burden.  The trees are built where the shuffle brings their members together instead of being
broadcast: their size has no bound.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import blocks_for, cut_lineage, pair_blocks, prepare, runs_of
from evalloop.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of one tree; larger shards are split.
SHARD_ROWS = 4096
#: Shingles hashed at a time, which bounds the memory of a very long text.
CHUNK = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text in UTF-8, as an unsigned integer; 0 without a word.

    Words are split at the blank and U+0009 to U+000D and A-Z lower-cased, which is what ``bytes`` does.
    """
    words = data.lower().split() if data else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - shingle + 1], ends[shingle - 1:]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(first), CHUNK):
        spans = zip(first[k:k + CHUNK].tolist(), last[k:k + CHUNK].tolist())
        ones += _ones(np.array([digest(joined[x:y], seed) for x, y in spans], dtype=np.uint64))
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of every row; a null text has no word."""
    ids = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_data"))
    kind = ids.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return ids.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


class LinkTree:
    """A BK-tree that joins what it finds within the radius into components."""

    def __init__(self, radius: int):
        self.radius = radius
        self.value: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.above: list[int] = []  # union-find
        self.whole: list[int] = []  # a member whose component holds the whole subtree, or -1

    def root(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    def _join(self, i: int, k: int) -> None:
        i, k = self.root(i), self.root(k)
        if i != k:
            self.above[max(i, k)] = min(i, k)

    def _node(self, x: int) -> int:
        self.value.append(x)
        self.kids.append({})
        self.above.append(len(self.above))
        self.whole.append(len(self.whole))
        return len(self.value) - 1

    def search(self, x: int, me: int, top: int) -> None:
        """Join ``me`` (the node of ``x``) with all nodes within the radius below ``top``."""
        radius, todo = self.radius, [top]
        while todo:
            node = todo.pop()
            mark = self.whole[node]
            if mark >= 0 and self.root(mark) == self.root(me):
                continue
            away = (self.value[node] ^ x).bit_count()
            if away <= radius:
                self._join(node, me)
            for edge, kid in self.kids[node].items():
                if away - radius <= edge <= away + radius:
                    todo.append(kid)

    def probe(self, x: int) -> None:
        """Search with a value that does not become part of the tree."""
        me = self._node(x)
        self.search(x, me, 0)

    def add(self, x: int) -> None:
        me = self._node(x)
        if me == 0:
            return
        self.search(x, me, 0)
        path, node = [], 0
        while True:
            path.append(node)
            away = (self.value[node] ^ x).bit_count()
            kid = self.kids[node].get(away)
            if kid is None:
                self.kids[node][away] = me
                break
            node = kid
        mine = self.root(me)
        for node in reversed(path):
            if self.root(node) != mine:
                self.whole[node] = -1
            elif self.whole[node] < 0 or self.root(self.whole[node]) != mine:
                same = all(self.whole[k] >= 0 and self.root(self.whole[k]) == mine for k in self.kids[node].values())
                self.whole[node] = node if same else -1

    def star(self) -> list[tuple[int, int]]:
        roots = map(self.root, range(len(self.value)))
        return [(self.value[i], self.value[r]) for i, r in enumerate(roots) if i != r]


def shard_links(values: list[int], own: list[int], left: int, right: int, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius in one shard or in one pair of its blocks."""
    tree = LinkTree(radius)
    if left == right:
        for x in values:
            tree.add(x)
    else:
        for x, o in zip(values, own):
            if o == left:
                tree.add(x)
        if tree.value:
            for x, o in zip(values, own):
                if o == right:
                    tree.probe(x)
    return tree.star()


def masks(blocks: int, radius: int) -> list[int]:
    """One mask for each choice of the blocks on which two linked fingerprints can agree."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(kept) for kept in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a``, ``b``: links between the distinct fingerprints ``fp`` of a stored table that connect all within the radius."""
    tables = masks(blocks_for(fps.count(), radius), radius)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard"))
        for k, m in enumerate(tables)])).alias("_k")).select("fp", "_k.t", "_k.shard")
    keyed = pair_blocks(cut_lineage(keyed, "shards"), ["t", "shard"], "fp", shard_rows)
    keys = ["t", "shard", "left", "right"]
    dealt = keyed.select(*keys, "own", "fp").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for rows in runs_of(batches, keys):
            if rows.num_rows < 2:
                continue
            found = shard_links([x & 0xFFFFFFFFFFFFFFFF for x in rows.column("fp").to_pylist()],
                                rows.column("own").to_pylist(), rows.column("left")[0].as_py(),
                                rows.column("right")[0].as_py(), radius)
            if found:
                ends = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id reachable over links, the row's own included.  Null and empty texts
    have the fingerprint zero and link like any other; rows that repeat an id are answered once each; a null
    id is never the smallest unless a component has no other; an empty table gives an empty result.  Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "_id"), "fingerprints")
    fps = cut_lineage(marked.groupBy("fp").agg(F.min("_id").alias("least")), "distinct-fingerprints")
    labels = components(links(fps, radius, shard_rows)).withColumnRenamed("node", "fp")
    linked = cut_lineage(labels.join(fps, "fp"), "linked-fingerprints")
    least = cut_lineage(linked.groupBy("label").agg(F.min("least").alias("component")), "component-least")
    reached = linked.join(least, "label").select("fp", "component")
    answer = cut_lineage(fps.join(reached, "fp", "left").select(
        "fp", F.coalesce("component", "least").alias("component_id")), "fingerprint-components")
    return marked.join(answer, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` stored with a number ``_row``; and of every row ``_row``, ``component`` (a row of it) and ``rank``.

    ``rank`` orders rows by id, a null id last, then by a digest of the whole row and its number.
    """
    prepare(docs.sparkSession)
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
    stored = cut_lineage(docs.withColumn("_digest", whole).withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_digest").alias("digest"), F.col("_row").alias("row"))
    found = near_duplicates(stored, "_row", text_col, shingle, radius).select("_row", F.col("component_id").alias("component"))
    return stored.drop("_digest"), cut_lineage(found.join(stored.select("_row", rank.alias("rank")), "_row"), "ranked-rows")


def _without(stored: DataFrame, ranked: DataFrame, gone) -> DataFrame:
    first = cut_lineage(ranked.groupBy("component").agg(F.min("rank").alias("first")), "component-first")
    lost = cut_lineage(ranked.join(first, "component").filter(gone).select("_row"), "near-duplicates")
    return stored.join(lost, "_row", "left_anti").drop("_row")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      radius: int = RADIUS) -> DataFrame:
    """Exactly one row of ``docs`` per component: the one with the smallest id, a null id last, then by its digest.

    Rows are told apart by a number of their own: null and repeated ids are rows like any other.
    """
    stored, ranked = _rows(docs, id_col, text_col, shingle, radius)
    return _without(stored, ranked, F.col("_row") != F.col("first.row"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows with a null id stay.

    Rows that repeat the id that stays are the same document and stay as they are; a row with the id of one that
    goes stays if its own component has no smaller id.  ``one_per_component`` keeps one row.
    """
    stored, ranked = _rows(docs, id_col, text_col, shingle, radius)
    return _without(stored, ranked, F.col("rank.id") > F.col("first.id"))
