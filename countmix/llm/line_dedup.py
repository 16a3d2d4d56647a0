"""Line deduplication by levelled sorted runs of line hashes.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at its
ends, A-Z lower-cased.  A key of at least ``min_chars`` code points found in at
least ``min_docs`` documents is *repeated*: all its lines go, except in the
largest document id that holds it.

:class:`LineRuns` keeps what is known of the keys as runs: tables of
``h1, h2`` (128 bits of the key's hash), ``n`` (documents) and ``top`` (largest
id), one row per key, dealt into the same buckets and sorted by hash.  A new
batch of documents is reduced to one row per key, merge-joined with the runs
bucket by bucket, and loses the keys that the runs have settled already (the
anti-join): found in ``min_docs`` documents, one of them with an id as large.
What is left becomes a run of level 0.  ``fanout`` runs of a level are compacted
into one run of the next, so a batch meets few runs.  Only the batch is
shuffled; runs are read in place, as their buckets agree.

Everything is DataFrame functions.  The query feeds its table in ``batches``
ranges of ids, largest first, so that settled keys never come back.

Hot lines: a key found in over ``1 / HOT_SHARE`` of the documents of the table
goes into a run even if settled, so its count stays known; these keys (few by
that share) are looked up in a broadcast table of checked size, all others by a
shuffle on the hash, where no key has many rows.

Edge cases: a null or empty text is one empty line; documents are told apart by
their id, rows that repeat an id are one document (and each keeps its row); rows
without an id are one document that sorts below all others; a line that a
document repeats counts once for it; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._util import bounded_broadcast
from .common import columns, drop_folder, saved, scratch

#: White space that is stripped from a line.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The id of documents without one.
NO_ID = -(1 << 63)
#: Keys in more than this share of the documents are looked up by broadcast.
HOT_SHARE = 1000
#: Keys (rows of a run) in a bucket.
BUCKET_ROWS = 2_000_000


def line_key(line: Column) -> Column:
    """The key of a line."""
    cut = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(cut) == F.char_length(cut)
    return F.when(ascii_only, F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (as given), ``doc`` (long, never null) and ``text`` (never null)."""
    rows = columns(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def line_hashes(rows: DataFrame, min_chars: int = 20) -> DataFrame:
    """``doc, text_hash, pos, h1, h2`` of every line whose key is long enough."""
    lines = rows.select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class LineRuns:
    """The levelled runs; ``levels[k]`` lists the runs of level ``k``, oldest first.

    A document must come in one batch only.  ``buckets`` is fixed for the life of
    the runs: size it by the keys expected in all.
    """

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int = 3, fanout: int = 3):
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, f"line-run-{level}")
        (rows.select("h1", "h2", "n", "top").repartition(self.buckets, "h1", "h2").write.format("parquet")
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_folder(self.spark, path)

    def add(self, lines: DataFrame, hot_docs: int | None = None) -> None:
        """Takes a batch of ``doc, h1, h2``: merge-anti-joins it with the runs and
        adds the rest as a run.  A key in ``hot_docs`` documents of the batch is
        added in any case."""
        batch = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("top"))
        counts, tops = [], []
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("h1", "h2", F.col("n").alias(f"n{i}"), F.col("top").alias(f"top{i}")), ["h1", "h2"], "left")
            counts.append(F.coalesce(f"n{i}", F.lit(0)))
            tops.append(F.coalesce(f"top{i}", F.lit(NO_ID)))
        if counts:
            settled = (sum(counts[1:], counts[0]) >= self.min_docs) & (F.greatest(*tops, F.lit(NO_ID)) >= F.col("top"))
            if hot_docs is not None:
                settled &= F.col("n") < hot_docs
            batch = batch.where(~settled)
        self._write(batch, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            old = self.levels[level]
            if len(old) >= self.fanout:
                self._write(self._merged([self.spark.table(name) for name, _ in old]), level + 1)
                self.levels[level] = []
                self._drop(old)
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row per key: a merge join of the runs, bucket by bucket."""
        rows = runs[0]
        for run in runs[1:]:
            more = run.select("h1", "h2", F.col("n").alias("n2"), F.col("top").alias("top2"))
            rows = rows.join(more, ["h1", "h2"], "full").select(
                "h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("top", "top2").alias("top"))
        return rows

    def repeated(self) -> DataFrame | None:
        """``h1, h2, n, top`` of the keys in at least ``min_docs`` documents; ``n``
        is exact up to that number and a lower bound from there.  None: no batch."""
        runs = self.runs()
        return self._merged(runs).where(F.col("n") >= self.min_docs) if runs else None

    def drop(self) -> None:
        """Removes the runs and their files."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def id_ranges(lines: DataFrame, batches: int) -> list[Column]:
    """Conditions on ``doc`` that deal the rows into ranges of ids, largest first."""
    shares = [i / batches for i in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("doc", shares, 10_000)).first()[0] if shares else None
    cuts = sorted({int(c) for c in cuts or []}, reverse=True)
    doc, out, above = F.col("doc"), [], None
    for c in cuts:
        out.append(doc > c if above is None else (doc > c) & (doc <= above))
        above = c
    out.append(doc <= above if above is not None else F.lit(True))
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 6, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` (the kept lines) of every row."""
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    lines = saved(line_hashes(rows, min_chars), "line-hashes")
    n_lines, n_docs = lines.agg(F.count("*"), F.approx_count_distinct("doc")).first()
    hot_docs = max(100, n_docs // HOT_SHARE)
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(n_lines / BUCKET_ROWS))
    runs = LineRuns(spark, buckets, min_docs, fanout)
    for part in id_ranges(lines, batches):
        runs.add(lines.where(part).select("doc", "h1", "h2"), max(1, hot_docs // batches))
    repeated = saved(runs.repeated(), "repeated-lines")
    runs.drop()

    is_hot = F.col("n") >= hot_docs
    hot = repeated.where(is_hot).select("h1", "h2", F.col("top").alias("hot_top"))
    found = lines.join(bounded_broadcast(hot, hot.count()), ["h1", "h2"], "left")
    by_hot = found.where("hot_top is not null and doc < hot_top").select("doc", "text_hash", "pos")
    rest = found.where("hot_top is null").join(repeated.where(~is_hot).select("h1", "h2", "top"), ["h1", "h2"]).where("doc < top")
    gone = by_hot.unionByName(rest.select("doc", "text_hash", "pos")).groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("gone"))

    out = (rows.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc", "text_hash"], "left")
           .select("doc_id", F.split("text", "\n", -1).alias("lines"), "text", "gone"))
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return out.select("doc_id", n.cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"))
