"""Count matrix in long form and the partition aggregates over it.

The matrix is never densified: ``dtm(doc_id, term_id, cnt)`` holds one row
per non-zero, ``docs(doc_id)`` keeps empty rows visible (N counts them) and
``vocab(term_id, term)`` names the columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import bounded_broadcast, checkpoint, saved

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition index << 33 | row


def dense_index(df: DataFrame, col: str, out: str, with_count: bool = False):
    """``(out, col)``: the distinct values of ``col`` numbered 0.. in ascending
    (binary / code point) order.

    A global ``row_number()`` would pull every value into one task.  Instead
    the values are range-partitioned and sorted, each row gets its position
    inside its partition, and a per-partition offset (one number per
    partition, so a literal array) turns it into a global rank.  The sorted
    values are checkpointed so both passes see the same partitioning.
    """
    vals = df.select(col).distinct().orderBy(col)
    vals = vals.select(col, F.spark_partition_id().alias("_pid"),
                       F.monotonically_increasing_id().alias("_mid"))
    vals = checkpoint(vals)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _LOCAL_BITS)
    sizes = dict(vals.groupBy("_pid").agg((F.max(local) + 1).alias("n")).collect())
    n_part = max(sizes) + 1 if sizes else 0
    offsets, acc = [], 0
    for p in range(n_part):
        offsets.append(acc)
        acc += sizes.get(p, 0)
    if not offsets:
        offsets = [0]
    off = F.element_at(F.array(*[F.lit(o) for o in offsets]).cast("array<bigint>"),
                       F.col("_pid") + 1)
    res = vals.select((off + local).alias(out), col)
    return (res, acc) if with_count else res   # acc: exact number of values


def vocabulary(terms: DataFrame, with_count: bool = False):
    """Vocabulary ``(term_id INT, term STRING)``, term_id = alphabetical rank
    (with ``with_count``: also V, known exactly from the ranking pass)."""
    out = dense_index(terms.select("term"), "term", "term_id", with_count)
    ids = F.col("term_id").cast("int").alias("term_id")
    return (out[0].select(ids, "term"), out[1]) if with_count else out.select(ids, "term")


def index_terms(dtm: DataFrame, vocab: DataFrame, n_vocab: int | None = None) -> DataFrame:
    """Replace term strings by their id, in the same place among the columns;
    terms missing from ``vocab`` drop out."""
    v = bounded_broadcast(vocab.select("term", "term_id"), n_vocab)
    return dtm.join(v, "term").select(*["term_id" if c == "term" else c for c in dtm.columns])


def drop_empty_terms(dtm: DataFrame, vocab: DataFrame | None, min_docs: int = 1,
                     with_count: bool = False):
    """Keep vocabulary terms present (cnt > 0) in at least ``min_docs``
    documents of ``dtm(doc_id, term, cnt)`` (``vocab`` None: of all its terms);
    the survivors are re-ranked.

    ``min_docs = 1`` drops exactly the columns whose total is zero.
    """
    df = (dtm.filter(F.col("cnt") > 0).groupBy("term")
          .agg(F.count(F.lit(1)).alias("df"))
          .filter(F.col("df") >= min_docs).select("term"))
    kept = df if vocab is None else vocab.select("term").join(df, "term", "left_semi")
    return vocabulary(kept, with_count)


def sparse_rows(dtm: DataFrame, docs: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One row per document: ``(doc_id, terms ARRAY<INT>, cnts ARRAY<DOUBLE>)``,
    term ids ascending, repeated (doc, term) triplets summed.  With ``docs``,
    documents without any term get empty arrays.  A row holds at most V
    entries, whatever the corpus size; ``parts`` keeps the rows that one task
    gathers within its memory."""
    # One shuffle: hash(doc_id) already satisfies the (doc_id, term_id) grouping.
    dealt = dtm.repartition(parts, "doc_id") if parts else dtm.repartition("doc_id")
    summed = (dealt.groupBy("doc_id", "term_id")
              .agg(F.sum("cnt").alias("cnt")))
    agg = (summed.groupBy("doc_id")
           .agg(F.array_sort(F.collect_list(
               F.struct(F.col("term_id").cast("int").alias("term_id"),
                        F.col("cnt").cast("double").alias("cnt")))).alias("e")))
    if docs is not None:
        agg = docs.select("doc_id").join(agg, "doc_id", "left")  # docs: unique ids
    return agg.select(
        "doc_id",
        F.coalesce(F.col("e.term_id"), F.array().cast("array<int>")).alias("terms"),
        F.coalesce(F.col("e.cnt"), F.array().cast("array<double>")).alias("cnts"))


def term_totals(dtm: DataFrame) -> DataFrame:
    """Column sums ``(term_id, total BIGINT, n_docs BIGINT)`` of triplets that are
    unique per (doc_id, term_id), as the count matrix gives them."""
    return dtm.groupBy("term_id").agg(F.sum("cnt").cast("bigint").alias("total"),
                                      F.count(F.lit(1)).alias("n_docs"))


def dims(docs: DataFrame, vocab: DataFrame, dtm: DataFrame) -> DataFrame:
    """One row ``(n_docs, n_terms, nnz, n_tokens)``: N, V and the sparsity."""
    # one aggregation over a tagged union (no join of the three tables)
    u = (docs.select(F.lit(0).alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"),
                     F.lit(None).cast("bigint").alias("cnt"))
         .unionByName(vocab.select(F.lit(1).alias("k"), F.lit(None).cast("bigint").alias("doc_id"),
                                   F.lit(None).cast("bigint").alias("cnt")))
         .unionByName(dtm.select(F.lit(2).alias("k"), F.lit(None).cast("bigint").alias("doc_id"),
                                 F.col("cnt").cast("bigint").alias("cnt"))))
    return u.agg(
        F.countDistinct(F.when(F.col("k") == 0, F.col("doc_id"))).alias("n_docs"),
        F.count(F.when(F.col("k") == 1, F.lit(1))).alias("n_terms"),
        F.count(F.when(F.col("k") == 2, F.lit(1))).alias("nnz"),
        F.coalesce(F.sum(F.when(F.col("k") == 2, F.col("cnt"))), F.lit(0)).cast("bigint").alias("n_tokens"))


def count_matrix(df: DataFrame, row: str, col: str, weight: str | None = None) -> DataFrame:
    """Count matrix from any fact table: ``(row, col, cnt)``.

    Without ``weight`` each fact counts 1; with it the weights are summed.
    Partial aggregation runs before the shuffle on ``(row, col)``.
    """
    val = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(row, col).agg(val.alias("cnt")))


# --------------------------------------------------------------------- B ---

def cluster_sizes(assign: DataFrame, n_docs: int | None = None,
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, cluster, n, pi)`` with ``pi = n / N`` (N per key group)."""
    g = list(keys) + ["cluster"]
    sizes = assign.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    if n_docs is not None:
        return sizes.withColumn("pi", F.col("n") / F.lit(float(n_docs)))
    # Q rows per key group: a window over this tiny result is cheap.
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return sizes.withColumn("pi", F.col("n") / F.sum("n").over(w))


def meta_documents(dtm: DataFrame, assign: DataFrame, keys: tuple[str, ...] = (),
                   every_term: bool = False) -> DataFrame:
    """Sum the documents of each cluster: ``(*keys, cluster, term_id, cnt)``
    (``term`` for ``term_id`` if the triplets hold strings).  With ``every_term``
    documents without a cluster are summed too (``cluster`` null), so that no term
    of the triplets is missing.

    ``dtm JOIN assign`` on doc_id then a partially aggregated ``groupBy``;
    the shuffle carries at most (clusters x terms) rows per map task.
    """
    j = dtm.join(assign, "doc_id", "left" if every_term else "inner")
    return (j.groupBy(*keys, "cluster", "term_id" if "term_id" in dtm.columns else "term")
            .agg(F.sum("cnt").alias("cnt")))


def move_meta(meta: DataFrame, dtm: DataFrame, moves: DataFrame,
              keys: tuple[str, ...] = ()) -> DataFrame:
    """Apply moves ``(doc_id, from_cluster, to_cluster)`` to meta-documents by
    adding each moved row to its target and subtracting it from its source."""
    m = moves.join(dtm, "doc_id")
    minus = m.select(*keys, F.col("from_cluster").alias("cluster"), "term_id",
                     (-F.col("cnt")).alias("cnt"))
    plus = m.select(*keys, F.col("to_cluster").alias("cluster"), "term_id", "cnt")
    out = (meta.select(*keys, "cluster", "term_id", "cnt")
           .unionByName(minus).unionByName(plus)
           .groupBy(*keys, "cluster", "term_id").agg(F.sum("cnt").alias("cnt")))
    return out.filter(F.col("cnt") != 0)


def cluster_word_counts(meta: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Words per cluster ``(*keys, cluster, n_words)``."""
    return meta.groupBy(*keys, "cluster").agg(F.sum("cnt").alias("n_words"))


def row_normalise(df: DataFrame, row: list[str] | str, val: str, out: str | None = None,
                  few_rows: bool = True) -> DataFrame:
    """Divide ``val`` by its row total so each row sums to 1.

    ``few_rows`` (topics, clusters): totals are counted, and joined back by
    broadcast within the bound, so no key holds a whole row in one task.  Otherwise
    (one row per document) a window partitioned by the row key is used.
    """
    rows = [row] if isinstance(row, str) else list(row)
    out = out or val
    if few_rows:
        tot = checkpoint(df.groupBy(*rows).agg(F.sum(val).alias("_tot")))
        j = df.join(bounded_broadcast(tot, tot.count()), rows)
        return j.withColumn(out, F.col(val) / F.col("_tot")).drop("_tot")
    w = Window.partitionBy(*rows)
    return df.withColumn(out, F.col(val) / F.sum(val).over(w))


# ------------------------------------------------------------- container ---

@dataclass
class CountMatrix:
    """A count matrix: documents, vocabulary and non-zero triplets."""

    docs: DataFrame      # (doc_id)
    vocab: DataFrame     # (term_id, term)
    dtm: DataFrame       # (doc_id, term_id, cnt)
    N: int
    V: int

    _nnz: int | None = None

    @property
    def nnz(self) -> int:
        """Exact number of non-zeros (one count of the checkpointed triplets)."""
        if self._nnz is None:
            self._nnz = self.dtm.count()
        return self._nnz

    def partitions(self) -> int:
        """Partition count for the cached matrix: sized by non-zeros
        (``LIMITS.nnz_per_partition``), at least one per core."""
        from ..config import LIMITS
        cores = self.dtm.sparkSession.sparkContext.defaultParallelism
        return max(cores, -(-self.nnz // LIMITS.nnz_per_partition))

    def tasks(self) -> int:
        """Tasks that gather documents (``LIMITS.nnz_per_task``), at least one per core."""
        from ..config import LIMITS
        return max(self.dtm.sparkSession.sparkContext.defaultParallelism, -(-self.nnz // LIMITS.nnz_per_task))

    def rows(self) -> DataFrame:
        return sparse_rows(self.dtm, self.docs, self.tasks())

    def persist(self) -> "CountMatrix":
        """Cut lineage once: later rounds re-read the checkpoint, not the text."""
        return CountMatrix(checkpoint(self.docs), self.vocab,
                           checkpoint(self.dtm), self.N, self.V)


def build_count_matrix(docs: DataFrame, term_dtm: DataFrame, min_docs: int = 1,
                       persist: bool = True) -> CountMatrix:
    """From ``docs(doc_id)`` and string triplets ``(doc_id, term, cnt)``:
    vocabulary of terms in >= ``min_docs`` documents, indexed triplets, N, V."""
    from pyspark import StorageLevel

    term_dtm = term_dtm.persist(StorageLevel.MEMORY_AND_DISK)   # tokenise once
    vocab, V = drop_empty_terms(term_dtm, None, min_docs, True)
    vocab = checkpoint(vocab) if persist else vocab
    dtm = index_terms(term_dtm, vocab, V)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    if persist:
        d, dtm = saved(d, "docs"), saved(dtm, "triplets")
        term_dtm.unpersist()
    N = d.count()
    return CountMatrix(d, vocab, dtm, N, V)
