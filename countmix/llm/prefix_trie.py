"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path of turn digests (16 bytes each), a node is a distinct
prefix.  The paths are dealt into ranges by splitters taken from a sample, and
each shard is sorted by (path, id).  A node whose members lie in several shards
is a prefix of a splitter: these nodes, the *skeleton*, are broadcast as a trie.
A shard is read once as a stream with a stack of open nodes.  Every node outside
the skeleton lies in one shard and is finished there; of a skeleton node the
shard returns a partial aggregate, and the partial aggregates are reduced by
node.  Only the sums over skeleton subtrees are left then, over a few numbers per
skeleton node.

Members' ids are hashed as they pass.  A skeleton node's ids leave the shards as
pieces of text of ``PIECE`` bytes, which one stream per node hashes in order: a
conversation that a third of all rows repeat is spread over the shards by its ids
and is never held as one group.

Bounds.  A splitter path is cut one turn after it leaves the path of the splitter
before it; of the skeleton the driver and the tasks hold at most ``SKELETON_BYTES``
(with longer shared paths the number of shards is halved until that holds).
A shard's memory is its open path and the finished children of the nodes on it.
One conversation is one row of 20 bytes a turn.

Edge cases: rows without a conversation id take no part; null roles and texts
count as empty; a null turn comes first, turns of one number are ordered by their
digest and repeated rows stay repeated turns; an empty table has no node; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators._util import ship
from .common import columns, saved

DIGEST = 16
#: Conversations in a shard, and rows sampled per shard to choose the splitters.
SHARD_ROWS = 20_000
SAMPLE = 50
#: Bytes of splitter paths that the driver and a task may hold.
SKELETON_BYTES = 64 << 20
#: Bytes of ids in one piece.
PIECE = 1 << 16
#: Rows of a result batch.
BATCH = 5_000
LEAST = -(1 << 63)


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: the turns in order, each ``turn, digest`` (32 hex
    digits) and ``words``."""
    t = columns(rows, conv_id=F.col(f"`{conv_col}`").cast("long"), turn=turn_col, role=F.coalesce(F.col(f"`{role_col}`"), F.lit("")), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    t = t.where("conv_id is not null").select(
        "conv_id", "turn", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``conv_id, path, words`` of ``conv_id, turns``."""
    return convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
                        F.transform("turns", lambda t: t["words"]).alias("words"))


def rebuilt(convs: DataFrame, leader: Callable[[Column], Column], shared: Column) -> DataFrame:
    """Every conversation with its first ``shared`` turns taken from the
    conversation ``leader(id)`` (all of them if fewer, none if there is none)."""
    most = convs.agg(F.max(shared)).first()[0] or 0
    heads = convs.select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, int(most)).alias("head"))
    heads = heads.where(F.col("head_id") == leader(F.col("head_id")))
    found = convs.withColumn("h", shared).join(heads, leader(F.col("conv_id")) == F.col("head_id"), "left")
    none = F.slice("turns", 1, 0)
    own = F.slice(F.col("turns"), F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return found.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("turns"))


class Skeleton:
    """The trie of the splitter paths.  Node 0 is the root; ``child`` maps
    (node, digest) to a node, ``parent`` holds each node's parent."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            at = 0
            for i in range(0, len(path), DIGEST):
                key = (at, path[i:i + DIGEST])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(i // DIGEST + 1)
                at = self.child[key]

    def size(self) -> int:
        return DIGEST * len(self.parent) + sum(len(p) for p, _ in self.splitters)


def shared_turns(a: bytes, b: bytes) -> int:
    n = 0
    while n < len(a) and a[n:n + DIGEST] == b[n:n + DIGEST]:
        n += DIGEST
    return n // DIGEST


def choose_splitters(sample: list[tuple[bytes, int]], shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` keys that cut the sorted sample evenly, each path as
    short as tells it from the key before."""
    keys = sorted(set(sample))
    out: list[tuple[bytes, int]] = []
    for i in range(1, shards):
        at = i * len(keys) // shards
        if not at:
            continue
        path, conv = keys[at]
        before = keys[at - 1][0]
        if path != before:
            path, conv = path[:(shared_turns(path, before) + 1) * DIGEST], LEAST
        if not out or (path, conv) > out[-1]:
            out.append((path, conv))
    return out


def build_skeleton(rows: DataFrame) -> Skeleton:
    """Splitters from a sample of ``SAMPLE`` rows a shard, chosen by a hash of the
    id; the sample decides the balance of the shards only."""
    spark = rows.sparkSession
    n = rows.count()
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(n / SHARD_ROWS)) if n else 1
    while True:
        got = rows.select("path", "conv_id").orderBy(F.xxhash64("conv_id")).limit(SAMPLE * shards)
        weight = got.agg(F.sum(F.octet_length("path"))).first()[0] or 0
        if weight <= SKELETON_BYTES or shards == 1:
            break
        shards = shards // 2
    sample = [] if shards == 1 else [(bytes(r["path"]), r["conv_id"]) for r in got.collect()]
    return Skeleton(choose_splitters(sample, shards))


class Node:
    __slots__ = ("bone", "children", "digest", "ends", "least", "leaves", "n", "pending", "saved", "words")

    def __init__(self, digest: bytes, words: int, bone: int | None):
        self.digest, self.words, self.bone = digest, words, bone
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = hashlib.sha256() if bone is None else None
        self.pending: list[tuple] = []


#: Rows of a shard: finished nodes (0), partial aggregates of skeleton nodes (1)
#: and pieces of their members' ids (2).
OUT = ("kind int, shard int, seq long, bone int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
       "saved_tokens long, words long, ends_sha256 string, piece binary")
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [pa.field(c.split()[0], _TYPES[c.split()[1]]) for c in OUT.split(", ")]


class Shard:
    """One sorted shard as a stream of (path, words, conv_id)."""

    def __init__(self, number: int, skeleton: Skeleton, emit: Callable[[tuple], None]):
        self.number, self.skeleton, self.emit = number, skeleton, emit
        self.stack = [Node(b"", 0, 0)]
        self.piece: list[bytes] = []
        self.piece_size = self.seq = 0
        self.piece_bone: int | None = None

    def add(self, path: bytes, words: list[int], conv: int) -> None:
        stack = self.stack
        depth, same = len(path) // DIGEST, 0
        while same < min(depth, len(stack) - 1) and stack[same + 1].digest == path[same * DIGEST:(same + 1) * DIGEST]:
            same += 1
        while len(stack) > same + 1:
            self._close()
        for d in range(same, depth):
            digest, above = path[d * DIGEST:(d + 1) * DIGEST], stack[-1].bone
            bone = None if above is None else self.skeleton.child.get((above, digest))
            stack.append(Node(digest, words[d], bone))
        top = stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        text = str(conv).encode()
        if top.bone is None:
            top.ends.update(text if top.n == 1 else b"," + text)
            return
        if self.piece_bone != top.bone or self.piece_size > PIECE:
            self._flush()
            self.piece_bone = top.bone
        self.piece.append(text)
        self.piece_size += len(text) + 1

    def _flush(self) -> None:
        if self.piece:
            self.emit((2, self.number, self.seq, self.piece_bone, *[None] * 9, b",".join(self.piece)))
            self.seq += 1
        self.piece, self.piece_size, self.piece_bone = [], 0, None

    def _close(self) -> None:
        node, above, depth = self.stack.pop(), self.stack[-1], len(self.stack)
        self._up(node, above)
        if node.bone is not None:
            self._partial(node, depth)
            return
        row = self._finish(node, depth)
        above.children += 1
        above.leaves += row[9]
        above.saved += row[10]
        if above.bone is None:
            above.pending.append(row)
        else:
            self.emit((0, self.number, None, above.bone, *row[4:]))

    @staticmethod
    def _up(node: Node, above: Node) -> None:
        above.n += node.n
        above.least = node.least if above.least is None else min(above.least, node.least)

    def _finish(self, node: Node, depth: int) -> tuple:
        for row in node.pending:
            self.emit((*row[:6], node.least, *row[7:]))
        return (0, self.number, None, None, node.least, depth, None, node.n, node.children, node.leaves or 1,
                node.saved + (node.n - 1) * node.words, None, node.ends.hexdigest(), None)

    def _partial(self, node: Node, depth: int) -> None:
        self.emit((1, self.number, None, node.bone, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.words, None, None))

    def close(self) -> None:
        while len(self.stack) > 1:
            self._close()
        self._flush()
        if self.stack[0].n:
            self._partial(self.stack[0], 0)


def trie(rows: DataFrame) -> DataFrame:
    """Of ``conv_id, path, words``: a row per node, ``conv_id`` (smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``."""
    spark = rows.sparkSession
    ship(spark)
    rows = saved(rows, "trie-paths")
    skeleton = build_skeleton(rows)
    shared = spark.sparkContext.broadcast(skeleton)
    shards = len(skeleton.splitters) + 1

    def deal(batches):
        cuts = shared.value.splitters
        for b in batches:
            keys = zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)
            yield b.append_column("shard", pa.array([bisect_right(cuts, k) for k in keys], pa.int32()))

    def walk(batches):
        out: list[tuple] = []
        shard = None
        for b in batches:
            for number, path, words, conv in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "words", "conv_id")), strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.close()
                    shard = Shard(number, shared.value, out.append)
                shard.add(path, words, conv)
                if len(out) >= BATCH:
                    yield _batch(out)
                    out.clear()
        if shard is not None:
            shard.close()
        if out:
            yield _batch(out)

    dealt = rows.mapInArrow(deal, "conv_id long, path binary, words array<int>, shard int")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    done = saved(dealt.mapInArrow(walk, OUT), "trie-nodes")

    bones = _skeleton_rows(done, skeleton)
    bones_df = spark.createDataFrame(bones, "bone int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = _ends(done)
    empty = hashlib.sha256().hexdigest()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = bones_df.join(ends, "bone", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    # the skeleton's size is bounded (SKELETON_BYTES), so its ids are broadcast
    of_bone = F.broadcast(bones_df.select(F.col("bone"), F.col("conv_id").alias("bone_conv")))
    local = done.where("kind = 0").join(of_bone, "bone", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "bone_conv"))
    return local.select(*names).unionByName(top.select(*names))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], _NAMES)


def _skeleton_rows(done: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Reduces the partial aggregates by node, then sums over skeleton subtrees."""
    partial = done.where("kind = 1").groupBy("bone").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"))
    found = {r["bone"]: r for r in partial.collect()}  # a row per skeleton node
    children, leaves, kept = ([found[b][c] if b in found else 0 for b in range(len(skeleton.parent))] for c in ("n_children", "n_leaves", "saved_tokens"))
    for b in reversed(range(len(skeleton.parent))):  # a child has a larger number than its parent
        if b not in found:
            continue
        leaves[b] = leaves[b] or 1
        kept[b] += (found[b]["n_convs"] - 1) * found[b]["words"]
        up = skeleton.parent[b]
        if up >= 0:
            children[up] += 1
            leaves[up] += leaves[b]
            kept[up] += kept[b]
    return [(b, r["conv_id"], skeleton.depth[b], found[skeleton.parent[b]]["conv_id"] if b else None, r["n_convs"], children[b], leaves[b], kept[b])
            for b, r in sorted(found.items())]


def _ends(done: DataFrame) -> DataFrame:
    """``bone, ends_sha256``: the pieces of a node hashed in order, as a stream."""
    pieces = done.where("kind = 2").select("bone", "shard", "seq", "piece")
    pieces = pieces.repartition("bone").sortWithinPartitions("bone", "shard", "seq")

    def run(batches):
        bone, h, out = None, None, []
        for b in batches:
            for k, piece in zip(b.column("bone").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if k != bone:
                    if h is not None:
                        out.append((bone, h.hexdigest()))
                    bone, h = k, hashlib.sha256(piece)
                else:
                    h.update(b"," + piece)
        if h is not None:
            out.append((bone, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out])], ["bone", "ends_sha256"])

    return pieces.mapInArrow(run, "bone int, ends_sha256 string")
