"""Merkle manifest of a table by lag and lead windows.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a group ascend by
id; while a level has several nodes, every two consecutive ones (the last run may
hold one) are hashed into a node of the next level.  What remains is the group's
subroot; the subroots, in the order of the groups, make the root the same way.

Levels.  Leaves are numbered within their group and dealt into blocks of
``2 ** LEVELS`` aligned positions, so no run of siblings crosses a block.  Within
a block one window (one shuffle, one sort) serves all its levels: at level ``l``
the node of a row stands on its first leaf, its sibling exactly ``2 ** l`` rows
away, so a ``lead`` (slot 0) or ``lag`` (slot 1) of that fixed offset, masked by
the slot and by the length of the run, supplies it, and the row of the first
child hashes the parent.  Every row of the node takes the sibling from there.
The tops of the blocks are the leaves of the next stage, a 2 ** LEVELS-th of the
rows; their proofs come back by a join on (group, block), broadcast below
``TOP_ROWS`` rows.  A group that holds a third of all rows is many blocks.

Numbering: leaves are range-partitioned by (group, id) and written in order; a
row's number is its place in its part plus the counts of the parts before.

Edge cases: nulls are fields of their own (``-``); the null group comes first and
a null id first in its group; rows that repeat an id are leaves in the order of
their hashes (equal rows are interchangeable); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators._util import bounded_broadcast
from .common import columns, saved

#: Levels of one stage, and how many tops of blocks are broadcast (each with a
#: proof of at most some 50 digests).
LEVELS = 10
TOP_ROWS = 20_000
#: Leaves of one part when they are numbered.
PART_ROWS = 200_000
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts laid end to end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` plus ``idx`` (from 0 in the order within the group ``g``) and ``n``
    (rows of the group), without a window over a whole group."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / PART_ROWS))
    keys = ["g", *order, "tie"]
    placed = (rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
              .withColumn("place", F.monotonically_increasing_id()))
    placed = saved(placed, "merkle-placed").withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    # a row per group and part: at most as many as groups and parts together
    cells = placed.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    of_group = Window.partitionBy("g")
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = saved(cells.select(F.col("g").alias("cg"), F.col("part").alias("cpart"), "first", F.sum("rows").over(of_group).alias("n"),
                               F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")), "merkle-cells")
    found = placed.join(bounded_broadcast(cells, cells.count()), placed["g"].eqNullSafe(cells["cg"]) & (placed["part"] == cells["cpart"]))
    return found.withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("cg", "cpart", "first", "before", "place", "part")


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (``g, n, idx, digest`` and more) plus ``block``, ``top`` (on the
    first row of a block: its node ``levels`` higher) and ``path``: per level with
    several nodes, from below, ``right`` (1: the node is a second child) and
    ``sibling`` (empty if it has none)."""
    nodes = nodes.withColumn("block", F.shiftright("idx", levels))
    window = Window.partitionBy("g", "block").orderBy("idx")
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = nodes.columns
    cur = nodes.withColumn("d0", F.col("digest"))
    several = [F.shiftright(F.col("n") + ((1 << lv) - 1), lv) > 1 for lv in range(levels)]
    slot = [F.shiftright("idx", lv).bitwiseAND(1) for lv in range(levels)]
    for lv in range(levels):
        step = 1 << lv
        here = F.col(f"d{lv}")
        cur = cur.withColumns({"ahead": F.lead(here, step).over(window), "back": F.lag(here, step).over(window)})
        on_first = F.col("idx") % step == 0
        in_run = F.col("idx") + step < F.col("n")
        sibling = F.when(slot[lv] == 1, F.col("back")).when(in_run, F.col("ahead"))
        parent = F.when(several[lv], digest(here, F.when(in_run, F.col("ahead")).otherwise(F.lit("")))).otherwise(here)
        cur = cur.withColumns({f"s{lv}": F.when(on_first, F.coalesce(sibling, F.lit(""))),
                               f"d{lv + 1}": F.when(F.col("idx") % (2 * step) == 0, parent)}).drop("ahead", "back")
    steps = [F.when(several[lv], F.struct(slot[lv].cast("int").alias("right"), F.last(f"s{lv}", ignorenulls=True).over(so_far).alias("sibling"))) for lv in range(levels)]
    cur = cur.select(*own, F.col(f"d{levels}").alias("top"), F.array(*steps).alias("steps"))
    return cur.withColumn("path", F.filter("steps", lambda s: s.isNotNull())).drop("steps")


def tree(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` plus ``path`` (up to the group's last node) and ``top`` (that node)."""
    climbed = climb(nodes, levels)
    tops = climbed.where("top is not null").select("g", F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"), F.col("block").alias("idx"), F.col("top").alias("digest"))
    tops = saved(tops, "merkle-tops")
    count, most = tops.agg(F.count("*"), F.max("n")).first()
    if (most or 0) > 1:
        upper = saved(tree(tops, levels), "merkle-upper")
    else:
        upper = tops.withColumns({"path": F.expr("cast(array() as array<struct<right:int,sibling:string>>)"), "top": F.col("digest")})
    upper = upper.select(F.col("g").alias("ug"), F.col("idx").alias("ublock"), F.col("path").alias("above"), F.col("top").alias("utop"))
    upper = bounded_broadcast(upper, count, TOP_ROWS)
    climbed = climbed.drop("top")
    found = climbed.join(upper, climbed["g"].eqNullSafe(upper["ug"]) & (climbed["block"] == upper["ublock"]))
    return found.select(*[c for c in climbed.columns if c not in ("path", "block")], F.concat("path", "above").alias("path"), F.col("utop").alias("top"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.when(s["right"] == 1, F.concat(s["sibling"], node)).otherwise(F.concat(node, s["sibling"]))))


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Of ``leaves`` (``g`` group, ``id``, ``leaf`` and more): the same rows plus
    ``subroot``, ``root`` and ``path`` (from the leaf to the root)."""
    placed = numbered(saved(leaves, "merkle-leaves"), ["id", "leaf"])
    placed = placed.withColumn("digest", F.col("leaf"))
    inner = tree(placed, levels)
    subroots = saved(inner.where("idx = 0").select(F.col("g").alias("lang"), F.col("top").alias("digest")), "merkle-subroots")
    # the subroots are one group, ordered by the name of theirs
    ranked = numbered(subroots.withColumn("g", F.lit(0)), ["lang"])
    outer = saved(tree(ranked, levels), "merkle-root")
    outer = outer.select(F.col("lang").alias("og"), F.col("path").alias("opath"), F.col("top").alias("root"))
    outer = bounded_broadcast(outer, outer.count(), TOP_ROWS)
    found = inner.join(outer, inner["g"].eqNullSafe(outer["og"]))
    return found.select(*leaves.columns, F.col("top").alias("subroot"), "root", F.concat("path", "opath").alias("path"))


def document_leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``g`` (lang), ``id``, ``leaf`` and ``forged``: the leaf of the row with 1
    added to ``n_chars``, where ``changed`` holds (else null)."""
    rows = columns(docs, **{c: c for c in FIELDS})
    value = {c: field(F.col(c)) for c in FIELDS}
    more = field((F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)"))
    forged = digest(*[more if c == "n_chars" else value[c] for c in FIELDS])
    return rows.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), digest(*[value[c] for c in FIELDS]).alias("leaf"),
                       F.when(F.lit(False) if changed is None else changed, forged).alias("forged"))


def document_manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, path, folded_root`` (from the forged
    leaf where ``changed`` holds) and ``verified`` (it equals the root)."""
    rows = manifest(document_leaves(docs, changed), levels)
    out = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "path", fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda s: s["sibling"]), ""))
