"""Prefixes that conversations share: a trie of turns, packed as double arrays shard by shard.

A turn is known by a digest of 128 bits of its role and text, a node by a digest of
the turns that lead to it, so texts are read once and never moved.  Conversations are
cut into segments of ``SEGMENT`` turns, each below the node where the one before
ended; equal segments are one path with a count.  Paths are sorted by range, and each
run of at most ``SHARD_PATHS`` neighbours below one node is a shard: its turns get
dense ids, its paths are packed into BASE and CHECK arrays and walked along them, and
every node sums its subtree.

A sorted shard shares nodes with other shards only along its first and its last path
and along paths that go on in another segment.  These nodes are *open*: their partial
sums are merged over all shards, and what open nodes hold of each other is added by
pointer doubling, in as many rounds as the logarithm of the depth.  All other nodes are
whole where they are.  Hence no conversation, no group of copies and no prefix
that very many share has to fit into one task; only the digest over the ends of one
node is a sequence by definition, and its sorted ids stream through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codicil.llm.shared import stage, to_batch

SEGMENT = 64
SHARD_PATHS = 4096
ROOT = bytes(16)

_KEY = 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_SEGMENTS = pa.schema([("root", pa.binary()), ("depth", pa.int64()), ("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("conv", pa.int64()), ("end", pa.binary())])
_NODES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("open", pa.bool_()), ("conv", pa.int64()), ("parent_conv", pa.int64())]
    + [(name, pa.int64()) for name in ("n_convs", "n_children", "n_leaves", "saved", "size")]
)
_ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<long>')}" for f in schema)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, place, key, size`` of each turn: its place from 1, its digest, its text's UTF-8 bytes.

    Turns go by ``turn`` (null first), those with one number by digest.  Null roles and
    texts are empty; rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.unhex(F.substring(digest, 1, 2 * _KEY)).alias("key"), F.octet_length(text).cast("long").alias("size")
    )
    order = W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "key")
    return turns.select("conv", F.row_number().over(order).alias("place"), "key", "size")


def with_borrowed_heads(turns: DataFrame, lender: Column, taken: Column, most: int) -> DataFrame:
    """``conv, part, place, key, size``: the first ``taken`` turns of conversation ``lender``, then each conversation's own turns behind as many.

    ``lender`` and ``taken`` (at most ``most``) are made of ``conv``.  Each conversation also
    has a row of part -1 without a turn, so that one left without turns is not lost.
    """
    convs = turns.select("conv").distinct()
    heads = turns.where(F.col("place") <= most).select(F.col("conv").alias("lender"), "place", "key", "size")
    borrowers = convs.select("conv", lender.alias("lender"), taken.alias("taken"))
    borrowed = borrowers.join(heads, "lender").where(F.col("place") <= F.col("taken")).select("conv", F.lit(0).alias("part"), "place", "key", "size")
    own = turns.where(F.col("place") > taken).select("conv", F.lit(1).alias("part"), "place", "key", "size")
    return own.unionByName(borrowed).unionByName(_empty_heads(convs))


def _empty_heads(convs: DataFrame) -> DataFrame:
    nothing = [F.lit(0).alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("size")]
    return convs.select("conv", F.lit(-1).alias("part"), *nothing)


def whole_conversations(turns: DataFrame) -> DataFrame:
    """The turns as they are, in the form that ``prefix_nodes`` takes."""
    return turns.select("conv", F.lit(1).alias("part"), "place", "key", "size").unionByName(_empty_heads(turns.select("conv").distinct()))


def _child(node: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(node + key, digest_size=_KEY).digest()


def _segments(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``conv, key, size`` sorted by conversation and turn -> segments; ``end`` is set where a conversation ends."""
        conv, root, node, depth, path, sizes, rows = None, ROOT, ROOT, 0, [], [], []

        def closed(end: bytes | None) -> tuple:
            return root, depth, b"".join(path), sizes, conv, end

        for batch in batches:
            for own, key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != conv:
                    if conv is not None:
                        rows.append(closed(node))
                    conv, root, node, depth, path, sizes = own, ROOT, ROOT, 0, [], []
                if key is None:
                    continue
                if len(path) == segment:
                    rows.append(closed(None))
                    root, depth, path, sizes = node, depth + segment, [], []
                node = _child(node, key)
                path.append(key)
                sizes.append(size)
            if len(rows) >= 4096:
                yield to_batch(rows, _SEGMENTS)
                rows = []
        if conv is not None:
            rows.append(closed(node))
        yield to_batch(rows, _SEGMENTS)

    return run


class DoubleArray:
    """A trie whose child of state ``s`` by code ``c`` (from 1) is ``base[s] + c``, if ``check`` has ``s`` there."""

    def __init__(self, paths: list[list[int]]) -> None:
        """``paths``: distinct and sorted."""
        self.base, self.check, self._used = [0], [0], bytearray(b"\1")
        self.preorder: list[int] = []  # states without the root, each after its parent
        stack = [(0, 0, len(paths), 0)]
        while stack:
            state, low, high, depth = stack.pop()
            if low < high and len(paths[low]) == depth:
                low += 1
            groups = []
            while low < high:
                code, start = paths[low][depth], low
                while low < high and paths[low][depth] == code:
                    low += 1
                groups.append((code, start, low))
            if groups:
                base = self._place(state, [g[0] for g in groups])
                for code, start, end in groups:
                    self.preorder.append(base + code)
                    stack.append((base + code, start, end, depth + 1))

    def _place(self, state: int, codes: list[int]) -> int:
        """Puts a state's children at the first base where all their slots are free."""
        first, slot = codes[0], codes[0]
        while True:
            slot = self._used.find(0, slot + 1)
            if slot < 0:
                slot = max(len(self._used), first + 1)
            base = slot - first
            if not any(base + c < len(self._used) and self._used[base + c] for c in codes):
                break
        more = base + codes[-1] + 1 - len(self._used)
        if more > 0:
            self._used.extend(bytes(more))
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
        for c in codes:
            self._used[base + c], self.check[base + c] = 1, state
        self.base[state] = base
        return base

    def states(self, path: list[int]) -> Iterator[int]:
        """The states that a path leads through, as far as it is in the trie."""
        state = 0
        for code in path:
            following = self.base[state] + code
            if following >= len(self.check) or self.check[following] != state:
                return
            state = following
            yield state


def _packed(root: bytes, depth: int, rows: list[tuple]) -> list[tuple]:
    """Nodes of one shard from its sorted paths: rows ``(path, sizes, n, conv, goes_on)``."""
    turns = [[r[0][i : i + _KEY] for i in range(0, len(r[0]), _KEY)] for r in rows]
    ids = {key: i for i, key in enumerate(sorted({k for t in turns for k in t}), 1)}
    paths = [[ids[k] for k in t] for t in turns]
    trie = DoubleArray(paths)
    size = len(trie.check)
    node, least = [b""] * size, [None] * size
    depths, bytes_, n, kids, leaves, saved = ([0] * size for _ in range(6))
    is_open = bytearray(size)
    node[0], depths[0], is_open[0] = root, depth, 1
    for i, (path, keys, (_, sizes, count, conv, goes_on)) in enumerate(zip(paths, turns, rows, strict=True)):
        shared, before = goes_on or i in (0, len(paths) - 1), 0
        if not depth:  # below, the shard above has counted the node
            n[0] += count
            least[0] = conv if least[0] is None else min(least[0], conv)
        for state, key, own in zip(trie.states(path), keys, sizes, strict=True):
            if not node[state]:
                node[state], depths[state], bytes_[state] = _child(node[before], key), depths[before] + 1, own
            n[state] += count
            least[state] = conv if least[state] is None else min(least[state], conv)
            is_open[state] |= shared
            before = state
    out = []
    for state in reversed(trie.preorder):
        parent = trie.check[state]
        if not is_open[state]:
            leaves[state] += not kids[state]
            saved[state] += (n[state] - 1) * bytes_[state]
            kids[parent] += 1
            leaves[parent] += leaves[state]
            saved[parent] += saved[state]
    for state in (0, *trie.preorder):
        parent = trie.check[state]
        above = (None, None) if not state else (node[parent], None if is_open[parent] else least[parent])
        out.append((node[state], above[0], depths[state], bool(is_open[state]), least[state], above[1], n[state], kids[state], leaves[state], saved[state], bytes_[state]))
    return out


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows ``root, path, depth, sizes, n, conv, goes_on`` -> nodes, shard by shard."""
        root, depth, rows = None, 0, []
        for batch in batches:
            for own, path, at, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (own != root or len(rows) >= limit):
                    yield to_batch(_packed(root, depth, rows), _NODES)
                    rows = []
                root, depth = own, at
                rows.append((path, *rest))
        if rows:
            yield to_batch(_packed(root, depth, rows), _NODES)

    return run


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node's ends; rows ``node, conv`` come sorted."""
    node, digest, rows = None, None, []
    for batch in batches:
        for own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != node:
                if node is not None:
                    rows.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if len(rows) >= 4096:
            yield to_batch(rows, _ENDS)
            rows = []
    if node is not None:
        rows.append((node, digest.hexdigest()))
    yield to_batch(rows, _ENDS)


def _merged(parts: DataFrame) -> DataFrame:
    """Open nodes over all shards, with the sums of their whole subtrees."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = stage(parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.max("size").alias("size"), *sums), "open-nodes")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open_children"))
    nodes = merged.join(children, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    nodes = nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).drop("open_children")
    nodes = stage(nodes.withColumn("jump", F.col("parent")), "open-sums")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for _ in range(int(deepest).bit_length()):
        # Sums hold what lies less than 2^i below, jumps lead 2^i up.
        below = nodes.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = nodes.where("jump is not null").select(F.col("node").alias("jump"), F.col("jump").alias("further"))
        nodes = nodes.join(below, "node", "left").join(further, "jump", "left")
        nodes = nodes.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "jump": F.col("further")})
        nodes = stage(nodes.drop("more_leaves", "more_saved", "further"), "open-sums")
    return nodes


def prefix_nodes(turns: DataFrame, segment: int = SEGMENT, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """One row for each distinct beginning of conversations (``turns`` as from ``whole_conversations``).

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.  The
    root has every conversation, also those without turns; without conversations there
    is no row.
    """
    rows = turns.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "key", "size")
    segments = stage(rows.mapInArrow(_segments(segment), _ddl(_SEGMENTS)), "segments")
    paths = segments.groupBy("root", "path", "depth", "sizes").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.max(F.col("end").isNull()).alias("goes_on"))
    paths = paths.repartitionByRange("root", "path").sortWithinPartitions("root", "path")
    nodes = stage(paths.mapInArrow(_shards(shard_paths), _ddl(_NODES)), "trie-nodes")
    ends = segments.where("end is not null").select(F.col("end").alias("node"), "conv").repartition("node").sortWithinPartitions("node", "conv")
    ends = ends.mapInArrow(_end_digests, _ddl(_ENDS))
    columns = ["node", "conv", "depth", "n_convs", "n_children", "n_leaves", "saved"]
    upper = _merged(nodes.where("open"))
    parents = upper.select(F.col("node").alias("parent"), F.col("conv").alias("above"))
    lower = nodes.where("not open").join(parents, "parent", "left").select(*columns, F.coalesce("parent_conv", "above").alias("parent_conv"))
    found = upper.join(parents, "parent", "left").select(*columns, F.col("above").alias("parent_conv")).unionByName(lower)
    found = found.join(ends, "node", "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
