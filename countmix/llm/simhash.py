"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is set when more than half of a document's shingle hashes
set it.  Documents with one fingerprint form a class; classes whose
fingerprints differ in at most ``max_bits`` bits are linked, and linked classes
form components.

The join.  With ``max_bits + 1`` bands at least one band of two linked
fingerprints is equal, so each distinct fingerprint goes, rotated, into one
trie per band, below the node of that band's value.  Within such a node the
trie joins itself: pairs of nodes are traversed together from bit to bit, the
differing bits add up, and a pair of nodes is dropped once it exceeds the
budget (or when both already lie in one component).  A node is a range of the
sorted fingerprints, and a whole level of node pairs is one numpy step; pairs
wait in parts of bounded size.  Of the links a task finds it returns a
spanning forest.  A node with more than ``HOT`` fingerprints is split: its
descendants six bits below become node pairs of their own, each one task unit.

Edge cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; repeated rows and ids share classes; a row with
a null id links like any other and has the least id of its component (null if no
row of it has an id); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, texts

SEED = 42
#: Fingerprints of one task of the join, and of a node that is not split.
TASK_ROWS = 50_000
HOT = 100_000
SPLIT_BITS = 6
#: Node pairs traversed at once.
PART = 1 << 20

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of one text (unsigned)."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*[w[i:] for i in range(words)])))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    counts = np.zeros((8, 256), dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8) + _COLUMN
        counts += np.bincount(part.ravel(), minlength=2048).reshape(8, 256)
    set_in = (counts @ _BITS).ravel()
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (signed 64 bits) of each row."""
    rows = texts(docs, id_col, text_col)
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


class Links:
    """Components of the items of one task; a link joins two of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.breaks = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
        self.breaks = np.cumsum(np.append(False, root[1:] != root[:-1]))

    def joined(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """True where all items of both ranges are in one component already."""
        b = self.breaks
        return (b[lo1] == b[hi1 - 1]) & (b[lo2] == b[hi2 - 1]) & (self.root[lo1] == self.root[lo2])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def traverse(x: np.ndarray, pairs: np.ndarray, depth: int, max_bits: int, links: Links) -> None:
    """Joins node pairs of the sorted ``x`` (uint64), five rows ``lo1, hi1, lo2,
    hi2, bits``, from bit ``depth`` (0: the highest) down."""
    stack = [(depth, pairs)]
    one = np.uint64(1)
    while stack:
        depth, p = stack.pop()
        if p.shape[1] > PART:
            half = p.shape[1] // 2
            stack += [(depth, p[:, half:]), (depth, p[:, :half])]
            continue
        lo1, hi1, lo2, hi2, bits = p
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if leaf.any():
            a, b = lo1[leaf], lo2[leaf]
            near = (a != b) & (popcount(x[a] ^ x[b]) <= max_bits)
            links.add(a[near], b[near])
        p = p[:, ~leaf]
        if depth == 64 or not p.shape[1]:
            continue
        p = p[:, ~links.joined(*p[:4])]
        if not p.shape[1]:
            continue
        lo1, hi1, lo2, hi2, bits = p
        bit = one << np.uint64(63 - depth)
        above = ~((bit << one) - one) if depth else np.uint64(0)
        mid1 = np.clip(np.searchsorted(x, (x[lo1] & above) | bit), lo1, hi1)
        mid2 = np.clip(np.searchsorted(x, (x[lo2] & above) | bit), lo2, hi2)
        same = (lo1 == lo2) & (hi1 == hi2)
        new = [np.stack(c) for c in ((lo1, mid1, lo2, mid2, bits), (mid1, hi1, mid2, hi2, bits), (lo1, mid1, mid2, hi2, bits + 1))]
        new.append(np.stack((mid1, hi1, lo2, mid2, bits + 1))[:, ~same])
        p = np.concatenate(new, axis=1)
        p = p[:, (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= max_bits)]
        if p.shape[1]:
            stack.append((depth + 1, p))


def join_cells(cells: np.ndarray, keys: np.ndarray, max_bits: int, band_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the ``keys`` of each cell, as index pairs (a spanning forest).

    ``cells`` holds four numbers per key: band, band value and, of a split node,
    the two descendants that this cell pairs (-1, -1: the whole node).
    """
    order = np.lexsort((keys, *cells[::-1]))
    cells, sorted_keys = cells[:, order], keys[order]
    new = np.append(True, (cells[:, 1:] != cells[:, :-1]).any(axis=0))
    low = np.uint64(64 - band_bits)
    out_a, out_b = [], []
    starts = np.append(np.flatnonzero(new), len(order))
    most = 1 << band_bits
    for first in range(0, len(starts) - 1, most):
        at = starts[first:first + most + 1]
        base = at[0]
        lo, hi = at[:-1] - base, at[1:] - base
        rank = np.repeat(np.arange(len(lo), dtype=np.uint64), hi - lo)
        x = (rank << low) | (sorted_keys[base:at[-1]] & ((np.uint64(1) << low) - np.uint64(1)))
        s, t = cells[2, at[:-1]], cells[3, at[:-1]]
        links = Links(len(x))
        whole = s == t  # a whole node, or a descendant with itself
        zero = np.zeros(int(whole.sum()), dtype=np.int64)
        traverse(x, np.stack((lo[whole], hi[whole], lo[whole], hi[whole], zero)), band_bits, max_bits, links)
        if not whole.all():
            l, h, s, t = lo[~whole], hi[~whole], s[~whole], t[~whole]
            cut = np.searchsorted(x, x[l] >> low << low | t.astype(np.uint64) << (low - np.uint64(SPLIT_BITS)))
            traverse(x, np.stack((l, cut, cut, h, popcount((s ^ t).astype(np.uint64))))[:, (l < cut) & (cut < h)], band_bits + SPLIT_BITS, max_bits, links)
        a = np.flatnonzero(links.root != np.arange(len(x)))
        out_a.append(order[base + a])
        out_b.append(order[base + links.root[a]])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def near_pairs(classes: DataFrame, max_bits: int = 3, fp_col: str = "fp") -> DataFrame:
    """Links ``a, b`` between distinct fingerprints: what a spanning forest of
    every trie node needs (not all pairs)."""
    bands = max_bits + 1
    band_bits = 64 // bands
    fps = classes.select(F.col(fp_col).alias("fp"))
    n = fps.count()
    tasks = max(1, math.ceil(n * bands / TASK_ROWS))
    low = 64 - band_bits

    def turned(k: int):
        s = k * band_bits
        c = F.col("fp")
        return F.shiftleft(c, s).bitwiseOR(F.shiftrightunsigned(c, 64 - s)) if s else c

    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("band"), turned(k).alias("key")) for k in range(bands)])).alias("r")).select("r.*")
    rows = rows.withColumn("value", F.shiftrightunsigned("key", low))
    hot = rows.groupBy("band", "value").count().where(F.col("count") > HOT).select("band", "value", F.lit(True).alias("hot"))
    under = F.shiftrightunsigned("key", low - SPLIT_BITS).bitwiseAND((1 << SPLIT_BITS) - 1)
    near = F.array(*[F.lit(m) for m in range(1 << SPLIT_BITS) if bin(m).count("1") <= max_bits])
    others = F.transform(near, lambda m: F.struct(F.least(under, under.bitwiseXOR(m)).alias("s"), F.greatest(under, under.bitwiseXOR(m)).alias("t")))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("t")))
    rows = (rows.join(hot, ["band", "value"], "left")
            .withColumn("cell", F.explode(F.when(F.col("hot"), others).otherwise(whole)))
            .select("band", "value", "cell.s", "cell.t", "key"))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("band", "value", "s", "t"), F.lit(tasks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy().view(np.uint64)
        band = pdf["band"].to_numpy(dtype=np.int64)
        cells = np.stack([band, *(pdf[c].to_numpy(dtype=np.int64) for c in ("value", "s", "t"))])
        a, b = join_cells(cells, keys, max_bits, band_bits)
        s = (band * band_bits).astype(np.uint64)
        back = np.where(s > 0, (keys >> s) | (keys << ((np.uint64(64) - s) & np.uint64(63))), keys).view(np.int64)
        return pd.DataFrame({"a": back[a], "b": back[b]})

    return rows.groupBy("task").applyInPandas(run, "a long, b long")


def components(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``node, component`` (its smallest node) of the nodes of ``links`` (a, b),
    by alternating large and small stars; each round is written to the shared
    folder.  Minima are pre-aggregated, so a hub is no hot group."""

    def least(df):
        return df.groupBy("a").agg(F.min("b").alias("m"))

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen, rounds = mark(edges), 0
    while seen[0] and (max_rounds is None or rounds < max_rounds):
        both = edges.union(edges.select("b", "a"))
        m = least(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = least(large)
        small = large.join(m, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.union(m.select("a", F.col("m").alias("b"))).distinct(), "links")
        now, rounds = mark(edges), rounds + 1
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def rooted(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``fp, root`` of every distinct fingerprint: the least fingerprint (signed)
    of its component, over links between fingerprints, whoever holds them."""
    classes = saved(fps.select("fp").distinct(), "classes")
    comp = components(near_pairs(classes, max_bits))
    return saved(classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", F.coalesce("component", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (the smallest
    doc_id reachable over links) of every row."""
    fps = saved(fingerprints(docs, words, id_col, text_col), "fingerprints")
    roots = rooted(fps, max_bits)
    named = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = roots.join(least, "root").select("fp", "component_id")
    return fps.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """``documents`` rows of which one stays per component: the one of the smallest
    id, then of the smallest text hash (a row without an id only if none has one).
    Rows are told apart by id and text, so an id on two texts loses neither group;
    of equal rows one stays."""
    fps = saved(fingerprints(docs, words), "fingerprints")
    roots = rooted(fps, max_bits)
    rows = saved(fps.join(roots, "fp").select("root", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash").alias("key")), "members")
    best = rows.groupBy("root").agg(F.min("key").alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best")
    found = rows.join(best, "root")
    gone = found.where(~F.col("key").eqNullSafe(F.col("best"))).select("key.doc_id", "key.text_hash").distinct()
    again = found.where(F.col("key").eqNullSafe(F.col("best"))).groupBy("key").count().where("count > 1").select("key.doc_id", "key.text_hash")

    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))

    def on(side):
        return hashed["doc_id"].eqNullSafe(side["doc_id"]) & (hashed["_hash"] == side["text_hash"])

    kept = hashed.join(gone, on(gone), "left_anti")
    again = saved(again, "repeated")
    if again.isEmpty():
        return kept.drop("_hash")
    one = kept.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "_hash"])
    return kept.join(again, on(again), "left_anti").unionByName(one).drop("_hash")
