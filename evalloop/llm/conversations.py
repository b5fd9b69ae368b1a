"""The prefix trie of conversations: adaptive radix trees over turn ids, one per range of the sorted keys.

A turn's id is a fixed-width big-endian number, the first 16 bytes of the digest of its role and text; a
conversation's key is its turns' ids one after another.  The keys are sorted by range, so that equal and
similar conversations lie side by side and a group of copies spreads over many ranges.  Every range builds one
tree in its task; a node of the trie is emitted at each depth that is a whole number of turns, with its sums over
the range.  Two neighbouring ranges share the nodes that the last key of one and the first key of the other have
in common; what both have counted there is taken off once, from one small row per range, so that the sums
of all ranges add up to those of the whole trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloop.llm.common import cut_lineage, prepare, small_side

#: Bytes of a turn id.
TURN = 16
#: Every conversation shares up to this many turns less one with the first one of its family.
SHARED_TURNS = 9
FAMILY = 5
#: Turns, about, that the tree of one task holds.
RANGE_TURNS = 200_000
#: Conversation ids that one stored row of a list of ends holds.
ENDS_ROW = 4096


class Leaf:
    """What ends at a key: the conversation ids in ascending order and the sizes of the key's turns."""

    __slots__ = ("convs", "sizes")

    def __init__(self, sizes):
        self.convs, self.sizes = [], sizes


class Node:
    """An inner node: the compressed path to it, what ends there, and children in one of four layouts.

    Up to 4 or 16 children are byte strings searched for the next byte, up to 48 go through an index of 256
    places, more are a plain array of 256; a node grows into the next layout when its own is full.
    """

    __slots__ = ("path", "leaf", "index", "children", "count")

    def __init__(self, path: bytes):
        self.path, self.leaf = path, None
        self.index: bytearray | None = bytearray()
        self.children: list = []
        self.count = 0

    def layout(self) -> int:
        return 256 if self.index is None else 48 if len(self.index) == 256 else 4 if self.count <= 4 else 16

    def find(self, byte: int):
        if self.index is None:
            return self.children[byte]
        if len(self.index) == 256:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        at = self.index.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, child: "Node") -> None:
        """Adds a child or takes the place of the one at ``byte``."""
        if self.index is None:
            self.count += self.children[byte] is None
            self.children[byte] = child
            return
        if len(self.index) == 256:
            if at := self.index[byte]:
                self.children[at - 1] = child
            elif self.count < 48:
                self.children.append(child)
                self.count += 1
                self.index[byte] = self.count
            else:
                self._resize(256)
                self.put(byte, child)
            return
        at = self.index.find(byte)
        if at >= 0:
            self.children[at] = child
        elif self.count < 16:
            self.index.append(byte)
            self.children.append(child)
            self.count += 1
        else:
            self._resize(48)
            self.put(byte, child)

    def _resize(self, places: int) -> None:
        held = list(self.items())
        if places == 48:
            self.index = bytearray(256)
            for k, (byte, _) in enumerate(held):
                self.index[byte] = k + 1
            self.children = [c for _, c in held]
        else:
            self.index, self.children = None, [None] * 256
            for byte, child in held:
                self.children[byte] = child

    def items(self) -> Iterator[tuple[int, "Node"]]:
        """Children with their bytes, in order of the bytes."""
        if self.index is None:
            return ((b, c) for b, c in enumerate(self.children) if c is not None)
        if len(self.index) == 256:
            return ((b, self.children[at - 1]) for b, at in enumerate(self.index) if at)
        return iter(sorted(zip(self.index, self.children)))


class RadixTree:
    """Keys of bytes with path compression; ``insert`` returns the leaf of a key."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, sizes: Sequence[int]) -> Leaf:
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                # the key leaves the compressed path: a new node takes the common part
                same = 0
                while at + same < len(key) and path[same] == key[at + same]:
                    same += 1
                fork = Node(path[:same])
                node.path = path[same + 1:]
                fork.put(path[same], node)
                parent.put(byte, fork)
                node, path = fork, fork.path
            at += len(path)
            if at == len(key):
                if node.leaf is None:
                    node.leaf = Leaf(sizes)
                return node.leaf
            child = node.find(key[at])
            if child is None:
                child = Node(key[at + 1:])
                node.put(key[at], child)
                child.leaf = Leaf(sizes)
                return child.leaf
            parent, byte, node, at = node, key[at], child, at + 1


class Open:
    """A trie node of a range and its sums there.

    ``n`` members, ``conv`` the smallest, ``size`` of the last text, ``children``, ``leaves``, and over the subtree
    ``weighted`` (members times size) and ``once`` (size).
    """

    __slots__ = ("hash", "parent", "depth", "n", "conv", "size", "children", "leaves", "weighted", "once", "leaf")

    def __init__(self, hash_, parent: "Open | None"):
        self.hash, self.parent, self.depth = hash_, parent, parent.depth + 1 if parent else 0
        self.n = self.children = self.leaves = self.weighted = self.once = 0
        self.conv = self.size = self.leaf = None

    @property
    def id(self) -> bytes:
        return self.hash.digest()[:TURN]

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.weighted += self.n * self.size
        self.once += self.size
        if up := self.parent:
            up.n += self.n
            up.conv = self.conv if up.conv is None else min(up.conv, self.conv)
            up.children += 1
            up.leaves += self.leaves
            up.weighted += self.weighted
            up.once += self.once


def nodes(tree: RadixTree) -> list[Open]:
    """The trie nodes of a tree: one at each depth of whole turns, also within a compressed path."""
    done: list[Open] = []
    open_ = [Open(hashlib.sha256(), None)]
    path = bytearray()
    stack: list[tuple[Node | None, bytes | int]] = [(tree.root, b"")]
    while stack:
        node, byte = stack.pop()
        if node is None:  # back from a subtree: the path is cut to what it was, deeper nodes are complete
            del path[byte:]
            while open_[-1].depth * TURN > byte:
                open_[-1].close()
                done.append(open_.pop())
            continue
        stack.append((None, len(path)))
        path += byte + node.path
        while (open_[-1].depth + 1) * TURN <= len(path):
            up = open_[-1]
            hash_ = up.hash.copy()
            hash_.update(path[up.depth * TURN:(up.depth + 1) * TURN])
            open_.append(Open(hash_, up))
        if node.leaf:
            here = open_[-1]
            here.leaf = node.leaf
            here.n += len(node.leaf.convs)
            least = node.leaf.convs[0]
            here.conv = least if here.conv is None else min(here.conv, least)
            for known in reversed(open_[1:]):
                if known.size is not None:
                    break
                known.size = node.leaf.sizes[known.depth - 1]
        stack += [(child, bytes([b])) for b, child in reversed(list(node.items()))]
    root = open_[0]
    if root.n:
        root.size = 0
        root.close()
        done.append(root)
    return done


def shared_turns(a: bytes, b: bytes) -> int:
    """Whole turns that two keys have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid * TURN] == b[:mid * TURN] else (low, mid - 1)
    return low


#: Rows of a range.  node: its sums (a change, for the nodes that two ranges share); ends: a part of the ids that end at
#: a key which the ranges beside may hold as well; edge: the first and last key of the range.
PARTIAL = ("kind string, id binary, parent binary, depth bigint, n bigint, conv bigint, parent_conv bigint, children bigint, "
           "leaves bigint, saved bigint, ends string, part int, first_key binary, last_key binary, sizes array<bigint>")
_TYPES = [pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_NAMES = [c.split()[0] for c in PARTIAL.split(", ")]


def _rows(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 4096):
        some = rows[k:k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in some], t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _of_range(batches) -> Iterator[pa.RecordBatch]:
    """The rows of one range, whose input (conv, key, sizes) comes in order of key and conv."""
    from pyspark import TaskContext

    tree, first, last, leaf, first_sizes = RadixTree(), None, None, None, None
    for batch in batches:
        for conv, key, sizes in zip(*[c.to_pylist() for c in batch.columns]):
            if key != last:
                leaf, last = tree.insert(key, sizes), key
                if first is None:
                    first, first_sizes = key, sizes
            leaf.convs.append(conv)
    if first is None:
        return
    edges = {id(tree.insert(first, ())), id(tree.insert(last, ()))}
    rows = [{"kind": "edge", "part": TaskContext.get().partitionId(), "first_key": first, "last_key": last, "sizes": first_sizes}]
    for node in nodes(tree):
        ends, convs = None, node.leaf.convs if node.leaf else []
        if node.leaf and id(node.leaf) in edges:
            rows += [{"kind": "ends", "id": node.id, "conv": convs[k], "ends": ",".join(map(str, convs[k:k + ENDS_ROW]))}
                     for k in range(0, len(convs), ENDS_ROW)]
        elif convs:
            ends = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
        rows.append({"kind": "node", "id": node.id, "parent": node.parent and node.parent.id, "depth": node.depth, "n": node.n,
                     "conv": node.conv, "parent_conv": node.parent and node.parent.conv, "children": node.children,
                     "leaves": node.leaves, "saved": node.weighted - node.once, "ends": ends})
        if len(rows) >= 4096:
            yield from _rows(rows)
            rows = []
    yield from _rows(rows)


def _twice(batches) -> Iterator[pa.RecordBatch]:
    """What neighbouring ranges (last key of one; first key of the next and its sizes) have both counted, as changes."""
    for batch in batches:
        for last, first, sizes in zip(*[c.to_pylist() for c in batch.columns]):
            depth = shared_turns(last, first)
            # a key that the next range repeats or continues was taken for a leaf of the range before
            leaf = len(last) == depth * TURN
            hash_, under, rows = hashlib.sha256(), sum(sizes[:depth]), []
            for d in range(depth + 1):
                if d:
                    hash_.update(first[(d - 1) * TURN:d * TURN])
                rows.append({"kind": "node", "id": hash_.digest()[:TURN], "n": 0, "children": -(d < depth),
                             "leaves": -leaf, "saved": under})
                under -= sizes[d - 1] if d else 0
            yield from _rows(rows)


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """``of``, ``digest`` of each id's list of ends, whose parts come one after another; only a running digest is held."""
    at, running, out = None, None, []
    for batch in batches:
        for of, part in zip(*[c.to_pylist() for c in batch.columns]):
            if of != at:
                if running:
                    out.append((at, running.hexdigest()))
                at, running = of, hashlib.sha256(part.encode())
            else:
                running.update(b"," + part.encode())
    if running:
        out.append((at, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())],
                                     names=["of", "digest"])


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn in hexadecimal letters."""
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.left(F.sha2(named.cast("binary"), 256), F.lit(2 * TURN))


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``conv``, ``key``, ``sizes``: the rebuilt turns of every conversation as ids one after another, and the bytes of each text.

    A conversation begins as the first one of its family (ids that agree but for their remainder by five): h turns of
    that, then its own from h on.  Turns come in order, a null turn first, equal ones by their ids; one exchange, of
    ids and sizes only, brings a family together.  A conversation is one record here: 16 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(conv_col).cast("long")
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv"), F.col(turn_col).isNotNull().alias("has"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"), turn_id(role, text).alias("id"),
        F.octet_length(text).cast("long").alias("size"))
    own = turns.groupBy("base", "conv").agg(F.array_sort(F.collect_list(F.struct("has", "turn", "id", "size"))).alias("t"))
    head = F.when(F.col("conv") == F.col("base"), F.slice("t", 1, SHARED_TURNS - 1))
    own = own.withColumn("head", F.coalesce(F.max(head).over(Window.partitionBy("base")), F.slice("t", 1, 0)))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    own = own.withColumn("t", F.concat(F.slice("head", F.lit(1), h), F.slice("t", h + 1, F.size("t"))))
    return own.select("conv", F.unhex(F.array_join("t.id", "")).alias("key"), F.col("t.size").alias("sizes"))


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the prefix trie over all rebuilt conversations (see :func:`rebuilt`), with their sums.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.  Null roles and texts count as empty; rows that repeat a turn are turns of their own;
    rows without a conversation id belong to no conversation; an empty table has no node; other columns are not read.
    """
    spark = conversations.sparkSession
    prepare(spark)
    keys = cut_lineage(rebuilt(conversations, conv_col, turn_col, role_col, text_col), "trie-keys")
    turns = keys.agg(F.sum(F.size("sizes")).alias("n")).first()["n"] or 0
    parts = max(spark.sparkContext.defaultParallelism, turns // range_turns + 1)
    ranged = keys.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv")
    found = cut_lineage(ranged.mapInArrow(_of_range, PARTIAL), "trie-ranges")
    # one row per range: the last key of each beside the first key of the next
    order = Window.orderBy("part")
    edges = found.filter("kind = 'edge'").select(F.lag("last_key").over(order).alias("before"), "first_key", "sizes").filter(
        "before IS NOT NULL")
    partial = found.filter("kind = 'node'").unionByName(edges.mapInArrow(_twice, PARTIAL))
    one = cut_lineage(partial.groupBy("id").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.min("parent_conv").alias("parent_conv"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.count("depth").alias("ranges")), "trie-nodes")
    # at most the nodes on the border of two ranges, and the keys there
    shared = cut_lineage(one.filter("ranges > 1").select(F.col("id").alias("shared_id"), F.col("conv").alias("shared_conv")), "trie-shared")
    ends = cut_lineage(found.filter("kind = 'ends'").repartition("id").sortWithinPartitions("id", "conv").select("id", "ends").mapInArrow(
        _digests, "of binary, digest string"), "trie-ends")
    none = hashlib.sha256(b"").hexdigest()
    return one.join(small_side(shared), F.col("parent") == F.col("shared_id"), "left").join(
        small_side(ends), F.col("id") == F.col("of"), "left").select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("shared_conv", "parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", "ends", F.lit(none)).alias("ends_sha256"))
