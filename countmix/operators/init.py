"""Starting partitions and starting topic matrices (C1-C8) plus argument rules (V1-V8)."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ._util import bounded_broadcast, saved
from .matrix import CountMatrix, dense_index, index_terms, meta_documents, row_normalise, vocabulary

# ----------------------------------------------------------- validation ---


def check_kq(K, Q, keep=1):
    """V1/V2: K and Q integers >= 2; keep an integer >= 1."""
    for name, v in (("K", K), ("Q", Q)):
        if int(v) != v or int(v) < 2:
            raise ValueError(f"{name} must be a whole number from 2 on, got {v!r}")
    if int(keep) != keep or int(keep) < 1:
        raise ValueError(f"keep must be a whole number from 1 on, got {keep!r}")


# -------------------------------------------------------------- C1 / C8 ---

def init_random(docs: DataFrame, Q: int, seed: int = 0, n_docs: int | None = None) -> DataFrame:
    """Each document uniform over clusters 1..Q, redrawn (as a whole) until
    every cluster occurs.  A draw is ``md5(doc_id:seed:attempt)``, so the result
    does not depend on partitioning.  ``N < Q`` cannot succeed and raises."""
    n = docs.count() if n_docs is None else n_docs
    if n < Q:
        raise ValueError(f"cannot split {n} documents into {Q} non-empty clusters")
    for attempt in itertools.count():
        u = hash_uniform("doc_id", F.lit(seed), F.lit(attempt))
        assign = docs.select("doc_id", (F.floor(u * Q) + 1).cast("int").alias("cluster"))
        if assign.select("cluster").distinct().count() == Q:
            return assign


def init_random_runs(docs: DataFrame, runs: dict, n_docs: int | None = None) -> DataFrame:
    """C1 for many restarts in one pass: ``runs = {run: (Q, seed)}`` gives
    ``(run, doc_id, cluster)``; run r equals ``init_random(docs, Q_r, seed_r)``.
    Each document row is repeated once per run with ``explode`` (no join);
    only runs that miss a cluster are redrawn."""
    n = docs.count() if n_docs is None else n_docs
    for r, (Q, _) in runs.items():
        if n < Q:
            raise ValueError(f"cannot split {n} documents into {Q} non-empty clusters")
    attempt = {r: 0 for r in runs}
    while True:
        spec = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(Q).alias("q"),
                                  F.lit(seed).alias("seed"), F.lit(attempt[r]).alias("attempt"))
                         for r, (Q, seed) in sorted(runs.items())])
        x = docs.select("doc_id", F.explode(spec).alias("s"))
        u = hash_uniform("doc_id", F.col("s.seed"), F.col("s.attempt"))
        assign = x.select(F.col("s.run").cast("int").alias("run"), "doc_id",
                          (F.floor(u * F.col("s.q")) + 1).cast("int").alias("cluster"))
        got = {row.run: row.k for row in
               assign.groupBy("run").agg(F.countDistinct("cluster").alias("k")).collect()}
        bad = [r for r, (Q, _) in runs.items() if got.get(r, 0) != Q]
        if not bad:
            return assign
        for r in bad:
            attempt[r] += 1


def check_assign(assign: DataFrame, docs: DataFrame, Q: int,
                 n_docs: int | None = None) -> DataFrame:
    """A user partition ``(doc_id, cluster)`` must cover every document
    exactly once and use exactly Q distinct labels; labels are relabelled
    densely 1..Q in ascending order (they need not be 1..Q on input)."""
    n = docs.count() if n_docs is None else n_docs
    a = assign.select(F.col("doc_id").cast("bigint"), F.col("cluster"))
    n_rows = a.count()
    if n_rows != n:
        raise ValueError(f"the partition must have {n} rows (one per document), not {n_rows}")
    missing = docs.select("doc_id").join(a, "doc_id", "left_anti").limit(1).count()
    dup = a.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if missing or dup:
        raise ValueError("the partition must give exactly one cluster to every document")
    labels = a.select("cluster").distinct()
    n_lab = labels.count()
    if n_lab != Q:
        raise ValueError(f"the partition must use {Q} groups, not {n_lab}")
    return _ranked(a, "cluster")[0].select("doc_id", F.col("label").alias("cluster"))


# ------------------------------------------------------------------- C3 ---

# The names an initialisation answers to.
INIT_ALIASES = {
    "random": "random", "rand": "random",
    "kmeans_lda": "kmeans_lda", "kmeans+lda": "kmeans_lda", "kmeans.lda": "kmeans_lda",
    "multmix": "multmix", "kmeans_dtm": "kmeans_dtm", "kmeans_tfidf": "kmeans_tfidf", "lda": "lda", "gmm_lda": "gmm_lda",
}


def init_clusters(cm: CountMatrix, Q: int, K: int, init="random", seed: int = 0,
                  **kw) -> DataFrame:
    """Dispatch on an init name (exact alias, case-insensitive) or call a
    user function ``f(cm, Q, K, nruns=1, seed=...) -> DataFrame(doc_id, cluster)``;
    the result is checked with :func:`check_assign`."""
    if callable(init):
        out = init(cm, Q, K, nruns=1, seed=seed)
        return check_assign(out, cm.docs, Q, cm.N)
    name = INIT_ALIASES.get(str(init).lower())
    if name is None:
        raise ValueError(f"unknown initialisation {init!r}: use one of {sorted(INIT_ALIASES)}")
    if name == "random":
        return init_random(cm.docs, Q, seed, cm.N)
    from . import gmm, starts
    from .topics import init_kmeans_lda
    if name == "kmeans_tfidf":
        kw["weighting"] = "tfidf"
    start = {"kmeans_lda": init_kmeans_lda, "multmix": starts.init_mixture, "kmeans_dtm": starts.init_kmeans,
             "kmeans_tfidf": starts.init_kmeans, "lda": starts.init_lda_map, "gmm_lda": gmm.init_gmm_lda}[name]
    return start(cm, Q, K, nruns=1, seed=seed, **kw)


# -------------------------------------------------------- C4 / C6 / C7 ---

def init_beta_random(vocab: DataFrame, K: int, V: int, seed: int = 0) -> DataFrame:
    """C4: ``(topic, term_id, p)`` with ``p = 1/V + U(0, 1e-10)`` per cell, then
    each topic row normalised (the K-row totals are broadcast).  Topics come
    from ``explode(sequence(1, K))`` per vocabulary row: no cross join."""
    cells = vocab.select("term_id", F.explode(F.sequence(F.lit(1), F.lit(K))).alias("topic"))
    u = hash_uniform(F.lit(seed), "topic", "term_id")
    cells = cells.select("topic", "term_id", (F.lit(1.0 / V) + u * F.lit(1e-10)).alias("w"))
    return row_normalise(cells, "topic", "w", "p").select("topic", "term_id", "p")


def check_beta(beta: np.ndarray, K: int, V: int, tol: float = 1e-12) -> np.ndarray:
    """A user beta must be K x V, non-negative, rows summing to 1 (within
    ``tol``, whatever the size)."""
    b = np.asarray(beta, dtype=np.float64)
    if b.shape != (K, V):
        raise ValueError(f"the given topics have shape {b.shape}, not {(K, V)}")
    off = np.abs(b.sum(1) - 1.0).max()
    if (b < 0).any() or not off <= tol:
        raise ValueError(f"the rows of the given topics must be probabilities (a row sum is off by {off:.3g})")
    return b


def check_topics(topics, tol: float = 1e-12):
    """C6/V4 for a long topic table: entries non-negative, each of the K rows
    summing to 1 (a longer sum, added in any order, may be off by rounding)."""
    rows = (topics.df.groupBy("topic").agg(F.sum("p").alias("s"), F.min("p").alias("m"))
            .collect())                                    # K rows
    bad = [r.topic for r in rows if not abs(r.s - 1.0) <= max(tol, topics.V * 2.3e-16) or r.m < 0]
    if bad or len(rows) != topics.K:
        raise ValueError(f"topics must be {topics.K} rows of probabilities; rows {sorted(bad)} are not")
    return topics


def _ranked(df: DataFrame, col: str):
    """The rows of ``df`` whose ``col`` is not null with ``label``, the rank 1.. of
    its value among the distinct ones in ascending order, and their number.
    The ranks are a table that is joined: broadcast when few, shuffled else."""
    df = df.filter(F.col(col).isNotNull())
    labels, n = dense_index(df, col, "_rank", with_count=True)
    labels = labels.select(F.col(col).alias("_value"), (F.col("_rank") + 1).cast("int").alias("label"))
    return df.join(bounded_broadcast(labels, n), F.col(col) == F.col("_value")), n


def assign_from_labels(df: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """A partition ``(doc_id, cluster)`` from a label column; labels ranked 1..G."""
    ranked, _ = _ranked(df.select(F.col(id_col).alias("_id"), label_col), label_col)
    return ranked.select(F.col("_id").alias("doc_id"), F.col("label").alias("cluster"))


def beta_from_groups(dtm: DataFrame, groups: DataFrame, group_col: str,
                     vocab: DataFrame | None = None, V: int | None = None, smoothing: float = 0.0):
    """Topics from labelled rows.  Rows with the same label are summed and
    each label's counts are normalised; topics are the labels ranked 1..K in
    ascending order.  With ``smoothing > 0`` every vocabulary term gets
    ``(cnt + s) / (total + s V)`` so no probability is 0.  Triplets may hold term
    strings: these are grouped first, and only the groups' rows get their ids.
    Without ``vocab`` it is that of all triplets, read off the saved sums, so the
    triplets are worked out once.  Returns Topics (and the vocabulary, if not given)."""
    ranked, K = _ranked(groups.select("doc_id", group_col), group_col)
    a = ranked.select("doc_id", F.col("label").alias("cluster"))
    counts = meta_documents(dtm, a, every_term=vocab is None).withColumnRenamed("cluster", "topic")
    if vocab is None:
        counts = saved(counts, "sums")
        vocab, V = vocabulary(counts.select("term"), with_count=True)
        counts = counts.where("topic is not null")
        return _topics_of(counts, K, vocab, V, smoothing), vocab
    return _topics_of(counts, K, vocab, vocab.count() if V is None else V, smoothing)


def _topics_of(counts: DataFrame, K: int, vocab: DataFrame, V: int, smoothing: float):
    """Topics of the sums ``(topic, term or term_id, cnt)``."""
    from .topics import Topics

    counts = counts.withColumn("cnt", F.col("cnt").cast("double"))
    if "term" in counts.columns:
        counts = index_terms(counts, vocab, V)
    if smoothing <= 0:
        counts = saved(counts, "counts")    # read for the totals and for the shares
        df = row_normalise(counts, "topic", "cnt", "p").select("topic", "term_id", "p")
        return Topics.from_df(df, K, V)
    # a term's counts (at most K) meet its vocabulary row; cells are laid out after the join
    own = counts.groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "cnt"))).alias("own"))
    own = saved(vocab.select("term_id").join(own, "term_id", "left"), "counts")
    cells = own.select("term_id", "own", F.explode(F.sequence(F.lit(1), F.lit(K))).alias("topic"))
    full = cells.select("topic", "term_id", (F.coalesce(F.col("own")[F.col("topic")], F.lit(0.0))
                                             + F.lit(float(smoothing))).alias("w"))
    df = row_normalise(full, "topic", "w", "p").select("topic", "term_id", "p")
    return Topics.from_df(df, K, V)
