"""Benchmark decontamination by pigeonhole edit matching.

An item of ``n`` characters leaks into a document when some part of the
document is within ``k = floor(error_rate * n)`` edits of it.  Each item is cut
into ``k + 1`` pieces, of which at least one must occur unchanged (k edits
cannot touch them all).  An Aho-Corasick automaton over all pieces finds exact
piece hits in one pass over a text; around each hit Myers' bit-parallel edit
distance, with free ends, verifies the item.

Texts are compared in lower case with white space as single spaces; reported
positions are code points of the text as given.

The items are dealt into blocks of bounded size; each block is broadcast and
matched against all documents in a map-only pass.

Edge cases: null texts count as empty; an empty item (or one of white space)
matches nothing; an item too short for one error must occur exactly; repeated
items, repeated rows and ids are each reported; empty tables give an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, texts

#: Bytes of item text that are broadcast at once.
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"\S+")


def normalise(text: str) -> str:
    """Lower case (length-preserving), single spaces, trimmed."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def original_positions(text: str) -> list[int]:
    """Where each character of ``normalise(text)`` lies in ``text``."""
    at: list[int] = []
    for m in _WORD.finditer(text):
        if at:
            at.append(m.start() - 1)
        at.extend(range(m.start(), m.end()))
    return at


def myers(pattern_masks: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of ``text``, and the end of
    the first such part."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, end = n, 0
    get = pattern_masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


@dataclass
class Item:
    item_id: object
    text: str
    errors: int
    forward: dict[str, int] = field(default_factory=dict)
    backward: dict[str, int] = field(default_factory=dict)


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float):
        self.items: list[Item] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            t = normalise(text)
            if not t:
                continue
            k = int(error_rate * len(t))
            bounds = [len(t) * i // (k + 1) for i in range(k + 2)]
            for lo, hi in zip(bounds, bounds[1:]):
                pieces[t[lo:hi]].append((len(self.items), lo))
            self.items.append(Item(item_id, t, k, masks(t), masks(t[::-1])))
        self.automaton = ahocorasick.Automaton()
        for p, uses in pieces.items():
            self.automaton.add_word(p, (len(p), uses))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """``item_id, start, end, distance``: the best place of each leaked item."""
        if not self.items:
            return []
        t = normalise(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, uses) in self.automaton.iter(t):
            for i, lo in uses:
                starts[i].add(last + 1 - size - lo)
        out, at = [], None
        for i, found in starts.items():
            item, n = self.items[i], len(self.items[i].text)
            best = None
            lo = hi = None
            for s in [*sorted(found), None]:
                # hits within the error budget of one another share a window
                if lo is not None and (s is None or s > hi + 2 * item.errors):
                    best = self._verify(t, item, max(0, lo - item.errors), hi + n + item.errors, best)
                    lo = None
                if s is not None:
                    lo, hi = (s if lo is None else lo), s
            if best is not None:
                at = at if at is not None else original_positions(text)
                d, a, b = best
                out.append((item.item_id, at[a], at[b - 1] + 1, d))
        return out

    @staticmethod
    def _verify(t: str, item: Item, lo: int, hi: int, best):
        n, window = len(item.text), t[lo:hi]
        exact = window.find(item.text)
        if exact >= 0:
            found = (0, lo + exact, lo + exact + n)
        else:
            d, end = myers(item.forward, n, window)
            if d > item.errors:
                return best
            _, size = myers(item.backward, n, window[:end][::-1][:n + item.errors])
            found = (d, lo + end - size, lo + end)
        return found if best is None or found[0] < best[0] else best


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, end, distance`` of each item found in a document
    (its best place), start and end in code points of the document's text."""
    spark = docs.sparkSession
    items = columns(benchmark, item_id=item_col, text=F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")))
    rows = texts(docs, id_col, text_col)
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, start long, end long, distance long"
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def passing(block: int) -> DataFrame:
        part = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.where(F.col("block") == block).collect()])

        def run(batches):
            matcher = Matcher(part.value, error_rate)
            arrow = None
            for b in batches:
                arrow = arrow or b.column("doc_id").type
                out = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for hit in matcher.find(t)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], arrow), pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "item_id", "start", "end", "distance"])

        return rows.mapInArrow(run, schema)

    out = passing(0)
    for block in range(1, blocks):
        out = out.union(passing(block))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08) -> DataFrame:
    """``documents`` rows without a leaked item (rows without an id whose text
    leaks go as well, by their text)."""
    keyed = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    probe = keyed.select(F.struct("doc_id", "__mark").alias("key"), "text")
    bad = leaks(probe.select(F.to_json("key", {"ignoreNullFields": "false"}).alias("key"), "text"), benchmark, error_rate, id_col="key").select(F.col("doc_id").alias("__key")).distinct()
    keyed = keyed.withColumn("__key", F.to_json(F.struct("doc_id", "__mark"), {"ignoreNullFields": "false"}))
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)
