"""Topic inference (D1-D7) and the LDA-based initialisations.

Two physical strategies for the VE-step on meta-documents:

* ``numpy``: beta (K x V) is shipped once as a broadcast variable and every
  meta-document is solved by the Arrow-batched kernel in ``applyInPandas``
  (one group per cluster, at most V rows per group).
* ``spark``: when K x V is over the broadcast bound, topics and meta-documents
  are a table of blocks of terms (:mod:`.parts`); one evaluation of all runs is
  one job and only the Q x K gamma values come back to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LIMITS
from ..functions.kernel import single_thread_blas, ve_dense, ve_sparse
from ..functions.special import digamma, lgamma
from . import parts
from ._util import checkpoint, drop_folder, release_shuffles, saved, scratch, ship, stored
from .matrix import CountMatrix

VE_SCHEMA = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("cluster", T.IntegerType()),
    T.StructField("n_words", T.DoubleType()),
    T.StructField("elbo", T.DoubleType()),
    T.StructField("iters", T.IntegerType()),
    T.StructField("gamma", T.ArrayType(T.DoubleType())),
])


# ---------------------------------------------------------------- topics ---

@dataclass
class Topics:
    """A topic matrix: long DataFrame ``(topic 1..K, term_id, p)`` and, when
    K x V is within the broadcast bound, its dense numpy twin."""

    df: DataFrame
    K: int
    V: int
    _mat: np.ndarray | None = None
    _bc: object = field(default=None, repr=False)

    @property
    def fits_broadcast(self) -> bool:
        return LIMITS.fits_driver(self.K * self.V)

    def matrix(self) -> np.ndarray:
        """Dense K x V array (collected once; only within the bound)."""
        if self._mat is None:
            if not self.fits_broadcast:
                raise MemoryError(f"beta {self.K}x{self.V} exceeds the broadcast bound")
            m = np.zeros((self.K, self.V))
            for b in self.df.select("topic", "term_id", "p").toArrow().to_batches():
                topic, term, p = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                m[topic - 1, term] = p
            self._mat = m
        return self._mat

    def broadcast(self):
        if self._bc is None:
            self._bc = self.df.sparkSession.sparkContext.broadcast(self.matrix())
        return self._bc

    def release(self):
        if self._bc is not None:
            self._bc.unpersist()
            self._bc = None

    @staticmethod
    def from_matrix(spark: SparkSession, mat: np.ndarray) -> "Topics":
        """From a K x V array (driver-side state within the bound)."""
        mat = np.asarray(mat, dtype=np.float64)
        K, V = mat.shape
        k, v = np.nonzero(mat)
        pdf = pd.DataFrame({"topic": (k + 1).astype("int32"), "term_id": v.astype("int32"),
                            "p": mat[k, v]})
        df = spark.createDataFrame(pdf, "topic int, term_id int, p double")
        return Topics(df, K, V, mat)

    @staticmethod
    def from_df(df: DataFrame, K: int, V: int) -> "Topics":
        return Topics(df.select(F.col("topic").cast("int"), F.col("term_id").cast("int"),
                                F.col("p").cast("double")), K, V)


# ------------------------------------------------------------ VE (D2-D5) ---

def ve_meta(meta: DataFrame, topics, alpha: float = 1.0, max_iter: int = 100,
            tol: float = 1e-9, gamma0: dict | None = None, strategy: str = "auto",
            accelerate: bool = False) -> DataFrame:
    """VE-step with beta locked on each meta-document ``(run, cluster, term_id, cnt)``.

    ``topics`` is one :class:`Topics` for every run or a dict ``{run: Topics}``;
    each distinct beta is broadcast once and all runs are solved in one job.
    Returns ``(run, cluster, n_words, elbo, iters, gamma ARRAY<DOUBLE>)``;
    gamma is the un-normalised gamma of the cluster (sums to K alpha + N_q).
    ``gamma0`` maps ``(run, cluster)`` to a warm-start vector; ``accelerate``
    uses SQUAREM (same fixed point) instead of ``max_iter`` plain updates.
    """
    if "run" not in meta.columns:
        meta = meta.withColumn("run", F.lit(0))
    by_run = topics if isinstance(topics, dict) else None
    distinct = {}
    for t in (by_run.values() if by_run else [topics]):
        distinct.setdefault(id(t), t)
    cells = sum(t.K * t.V for t in distinct.values())
    if strategy == "auto":
        strategy = "numpy" if LIMITS.fits_driver(cells) else "spark"
    if strategy == "spark":
        return _ve_meta_parts(meta, topics, alpha, max_iter, tol, gamma0, accelerate)
    ship(meta.sparkSession)
    keys = list(distinct)
    mats = {i: distinct[k].matrix() for i, k in enumerate(keys)}
    run_key = ({r: keys.index(id(t)) for r, t in by_run.items()} if by_run else None)
    bc = meta.sparkSession.sparkContext.broadcast({"mats": mats, "run_key": run_key})
    g0 = dict(gamma0 or {})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        single_thread_blas()
        run, cl = int(pdf["run"].iloc[0]), int(pdf["cluster"].iloc[0])
        st = bc.value
        beta = st["mats"][0 if st["run_key"] is None else st["run_key"][run]]
        pdf = pdf.sort_values("term_id")
        terms = pdf["term_id"].to_numpy()
        cnts = pdf["cnt"].to_numpy(dtype=np.float64)
        start = g0.get((run, cl))
        start = None if start is None else np.asarray(start)[None, :]
        if accelerate:
            g, el = ve_dense(cnts[None, :], beta[:, terms], alpha, max_iter, tol, start, True)
            gamma, elbo, it = g, el, np.array([-1])
        else:
            gamma, elbo, it = ve_sparse(np.zeros(len(terms), dtype=np.int64), terms, cnts, 1,
                                        beta, alpha, max_iter, tol, start)
        return pd.DataFrame({"run": [run], "cluster": [cl], "n_words": [cnts.sum()],
                             "elbo": [float(elbo[0])], "iters": [int(it[0])],
                             "gamma": [gamma[0].tolist()]})

    m = meta.select(F.col("run").cast("int"), F.col("cluster").cast("int"),
                    F.col("term_id").cast("int"), F.col("cnt").cast("double"))
    m = m.filter(F.col("cnt") > 0)
    return m.groupBy("run", "cluster").applyInPandas(solve, VE_SCHEMA)


def _ve_meta_parts(meta, topics, alpha, max_iter, tol, gamma0, accelerate):
    """Beyond the broadcast bound: all meta-documents of all runs in one job per
    evaluation, over topics and meta-documents split by terms."""
    spark = meta.sparkSession
    tot = {(r.run, r.cluster): r.n for r in
           meta.groupBy("run", "cluster").agg(F.sum("cnt").cast("double").alias("n")).collect()}
    runs = sorted({r for r, _ in tot})
    by_run = {r: topics[r] for r in runs} if isinstance(topics, dict) else dict.fromkeys(runs, topics)
    sets: dict[int, Topics] = {}
    set_of = {}
    for r, t in by_run.items():
        set_of[r] = next((s for s, x in sets.items() if x is t), len(sets))
        sets[set_of[r]] = t
    if not sets:
        return spark.createDataFrame([], VE_SCHEMA)
    blocks = parts.TermParts(spark, sets, meta, set_of, list(tot))
    cands, keys = parts.meta_candidates(blocks, tot)
    start = None
    if gamma0:
        start = np.ones((len(keys), max(blocks.K.values())))
        for i, key in enumerate(keys):
            K = by_run[key[0]].K
            start[i, :K] = gamma0.get(key, np.full(K, alpha + tot[key] / K))
    g, el, it = blocks.solve(cands, alpha, max_iter, tol, start, accelerate)
    res = [(int(r), int(c), float(tot[(r, c)]), float(el[i]), int(it[i]), [float(v) for v in g[i, :by_run[r].K]])
           for i, (r, c) in enumerate(keys)]
    return spark.createDataFrame(res, VE_SCHEMA)


def gamma_long(ve: DataFrame) -> DataFrame:
    """``(run, cluster, topic, gamma, theta)`` from a VE result."""
    x = ve.select("run", "cluster", F.posexplode("gamma").alias("pos", "gamma"))
    x = x.withColumn("topic", (F.col("pos") + 1).cast("int")).drop("pos")
    w = Window.partitionBy("run", "cluster")
    return x.withColumn("theta", F.col("gamma") / F.sum("gamma").over(w))


def total_bound(ve: DataFrame, sizes: DataFrame, n_docs: int) -> DataFrame:
    """``(run, bound)`` = sum_q ELBO_q + n_q ln(n_q / N).  A cluster whose
    documents are all empty has no meta row and contributes ELBO 0."""
    s = sizes.select("run", "cluster", "n") if "run" in sizes.columns else \
        sizes.select(F.lit(0).alias("run"), "cluster", "n")
    j = s.join(ve.select("run", "cluster", "elbo"), ["run", "cluster"], "left")
    term = F.coalesce("elbo", F.lit(0.0)) + F.col("n") * F.log(F.col("n") / F.lit(float(n_docs)))
    return j.groupBy("run").agg(F.sum(term).alias("bound"))


def icl_value(bound: float, K: int, V: int, Q: int, N: int) -> float:
    """ICL = bound - K(V-1)/2 ln Q - (Q-1)/2 ln N (the topic penalty uses ln Q)."""
    return bound - K * (V - 1) / 2.0 * np.log(Q) - (Q - 1) / 2.0 * np.log(N)


def icl_col(bound, K, V, Q, N):
    """E7 as a Column expression over Column arguments."""
    return (bound - K * (V - F.lit(1.0)) / F.lit(2.0) * F.log(Q)
            - (Q - F.lit(1.0)) / F.lit(2.0) * F.log(N))


# ------------------------------------------------------------ LDA (D1) ---

@dataclass
class LdaResult:
    topics: Topics
    loglik: float
    trace: list
    start: int


def _random_beta(K, V, seed, start):
    """Random start of one EM run: ``1/V + U(0,1)`` per cell, rows normalised.
    Drawn with a counter-based generator keyed by (seed, start)."""
    rng = np.random.default_rng([int(seed), int(start)])
    b = 1.0 / V + rng.random((K, V))
    return b / b.sum(1, keepdims=True)


def fit_lda(rows: DataFrame, V: int, K, alpha: float = 1.0, nstart: int = 1,
            em_max_iter: int = 100, em_tol: float = 1e-4, var_max_iter: int = 20,
            var_tol: float = 1e-6, seed: int = 0, beta0: np.ndarray | None = None,
            return_all: bool = False, n_partitions: int | None = None):
    """LDA by variational EM, alpha fixed, beta estimated, ``nstart`` restarts
    (``K`` may be a list: one topic count per start, for model selection).

    All restarts share one scan per EM iteration: the E-step ``mapInPandas``
    solves every document under every active start's beta and emits expected
    topic-term counts per batch; a ``groupBy(start, topic, term_id).sum``
    finishes them.  The K x V M-step is a row normalisation.  The best start by
    final bound is kept.  Within the bounds of ``LIMITS`` beta is driver state; beyond
    them beta stays a table and blocks of documents join it
    (:func:`_fit_lda_joined`): same starts, same updates.

    ``beta0``: a K x V array or a :class:`Topics`.  With ``return_all`` the result
    is ``{start: (array or Topics, bound)}``.
    """
    Ks = list(K) if isinstance(K, (list, tuple)) else [K] * max(nstart, 1)
    nstart = len(Ks)
    if beta0 is not None:
        Ks = [beta0.K if isinstance(beta0, Topics) else np.asarray(beta0).shape[0]]
    if not LIMITS.fits_driver(sum(Ks) * V):
        final, trace = _fit_lda_joined(rows, V, Ks, alpha, em_max_iter, em_tol, var_max_iter,
                                       var_tol, seed, beta0, n_partitions)
        if return_all:
            return final
        best = max(sorted(final), key=lambda s: final[s][1])
        return LdaResult(final[best][0], final[best][1], trace[best], best)
    spark = rows.sparkSession
    ship(spark)
    from pyspark import StorageLevel
    if n_partitions:
        rows = rows.repartition(n_partitions)
    rows = rows.select("terms", "cnts").persist(StorageLevel.MEMORY_AND_DISK)  # every EM iteration rescans
    if beta0 is not None:
        betas = {0: beta0.matrix() if isinstance(beta0, Topics) else np.asarray(beta0, dtype=float)}
    else:
        betas = {s: _random_beta(Ks[s], V, seed, s) for s in range(nstart)}
    active = set(betas)
    ll_prev = {s: None for s in betas}
    trace = {s: [] for s in betas}
    final = {}
    out_schema = "start int, topic int, term_id int, ss double"
    it = 0
    while active:
        keys = sorted(active)
        bc = spark.sparkContext.broadcast([betas[s] for s in keys])

        def estep(batches, keys=keys, bc=bc):
            single_thread_blas()
            stack = bc.value
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                lens = pdf["terms"].map(len).to_numpy()
                seg = np.repeat(np.arange(len(pdf)), lens)
                terms = np.concatenate(pdf["terms"].to_numpy()) if lens.sum() else np.zeros(0, int)
                cnts = np.concatenate(pdf["cnts"].to_numpy()) if lens.sum() else np.zeros(0)
                parts = []
                for i, s in enumerate(keys):
                    g, elbo, _, (uniq, ss) = ve_sparse(seg, terms.astype(np.int64), cnts, len(pdf),
                                                       stack[i], alpha, var_max_iter, var_tol,
                                                       with_stats=True)
                    kk, uu = np.nonzero(ss)
                    parts.append(pd.DataFrame({"start": s, "topic": (kk + 1).astype("int32"),
                                               "term_id": uniq[uu].astype("int32"),
                                               "ss": ss[kk, uu]}))
                    parts.append(pd.DataFrame({"start": [s], "topic": [0], "term_id": [-1],
                                               "ss": [float(elbo.sum())]}))
                yield pd.concat(parts, ignore_index=True)

        stats = (rows.select("terms", "cnts").mapInPandas(estep, out_schema)
                 .groupBy("start", "topic", "term_id").agg(F.sum("ss").alias("ss"))
                 .toPandas())
        bc.unpersist()
        for s in keys:
            st = stats[stats["start"] == s]
            ll = float(st.loc[st["topic"] == 0, "ss"].sum())
            body = st[st["topic"] > 0]
            m = np.zeros((Ks[s], V))
            m[body["topic"].to_numpy() - 1, body["term_id"].to_numpy()] = body["ss"].to_numpy()
            tot = m.sum(1, keepdims=True)
            tot[tot == 0] = 1.0
            trace[s].append(ll)
            # ll is the bound under the beta used in this E-step
            done = (it + 1 >= em_max_iter or (ll_prev[s] is not None and
                    abs((ll_prev[s] - ll) / ll_prev[s]) < em_tol))
            if done:
                final[s] = (betas[s], ll)
                active.discard(s)
            else:
                betas[s] = m / tot
                ll_prev[s] = ll
        it += 1
    rows.unpersist()
    if return_all:
        return {s: (mat, ll) for s, (mat, ll) in final.items()}
    best = max(sorted(final), key=lambda s: final[s][1])
    mat, ll = final[best]
    return LdaResult(Topics.from_matrix(spark, mat), ll, trace[best], best)


# ---------------------------------------- LDA with beta kept as a table ---

def _start_columns(spark: SparkSession, V: int, Ks: list, seed: int) -> DataFrame:
    """``(term_id, b ARRAY<DOUBLE>)``: the random starts of :func:`_random_beta`,
    topics of all starts side by side, not yet normalised.  A task jumps to its
    terms in each start's number stream."""
    def fn(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            out = np.empty((len(ids), sum(Ks)))
            cuts = np.flatnonzero(np.diff(ids) != 1) + 1
            for run in np.split(np.arange(len(ids)), cuts):
                col = 0
                for s, K in enumerate(Ks):
                    for k in range(K):
                        bits = np.random.PCG64(np.random.SeedSequence([int(seed), s]))
                        bits.advance(k * V + int(ids[run[0]]))
                        out[run, col] = 1.0 / V + np.random.Generator(bits).random(len(run))
                        col += 1
            yield pd.DataFrame({"term_id": ids.astype("int32"), "b": list(out)})

    return spark.range(V).mapInPandas(fn, "term_id int, b array<double>")


def _topic_columns(topics: Topics) -> DataFrame:
    """A long topic table as ``(term_id, b ARRAY<DOUBLE>)``."""
    cols = [F.sum(F.when(F.col("topic") == k + 1, F.col("p")).otherwise(0.0)) for k in range(topics.K)]
    return topics.df.groupBy("term_id").agg(F.array(*cols).alias("b"))


def _normalised(cols: DataFrame, n: int) -> DataFrame:
    """Each of the ``n`` topics divided by its sum (n numbers on the driver)."""
    tot = cols.agg(*[F.sum(F.col("b")[i]).alias(f"t{i}") for i in range(n)]).first()
    by = F.array(*[F.lit(float(t or 0.0) or 1.0) for t in tot])
    return cols.select("term_id", F.zip_with("b", by, lambda x, t: x / t).alias("b"))


#: Blocks of documents a core solves one after another.
BLOCKS_PER_CORE = 3


def _blocks(rows: DataFrame, n_partitions: int | None, *cols: str):
    """Sparse rows with a stable ``block``, the distinct terms of each block
    (bounded by the block's non-zeros), both checkpointed, and how many blocks:
    several for each core, because they fall on tasks by their hash and some
    converge later than others."""
    n = max(n_partitions or rows.rdd.getNumPartitions(), BLOCKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    rows = checkpoint(rows.repartition(n).select(F.spark_partition_id().alias("block"), "terms", "cnts", *cols))
    terms = rows.select("block", F.explode("terms").alias("term_id")).distinct()
    return rows, checkpoint(terms), n


def _met(rows: DataFrame, mine: DataFrame, n: int):
    """Blocks and their topics' rows, for ``applyInPandas``, in ``n`` tasks; a number
    given here is kept, while the adaptive shuffle would join small blocks to few tasks."""
    return rows.repartition(n, "block").groupBy("block").cogroup(mine.repartition(n, "block").groupBy("block"))


def _local(docs: pd.DataFrame, beta: pd.DataFrame):
    """A block's flat triplets in the block's own term numbers, and its beta."""
    if len(beta):
        beta = beta.sort_values("term_id")
        ids, mat = beta["term_id"].to_numpy(), np.stack(beta["b"].to_numpy()).T
    else:                                   # only empty documents
        ids, mat = np.zeros(0, np.int64), np.zeros((1, 0))
    lens = docs["terms"].map(len).to_numpy()
    seg = np.repeat(np.arange(len(docs)), lens)
    terms = np.concatenate(docs["terms"].to_numpy()).astype(np.int64) if lens.sum() else np.zeros(0, np.int64)
    cnts = np.concatenate(docs["cnts"].to_numpy()).astype(np.float64) if lens.sum() else np.zeros(0)
    at = np.searchsorted(ids, terms)
    known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == terms) if len(ids) else np.zeros(len(terms), bool)
    return ids, mat, seg[known], at[known], cnts[known]   # a term of probability 0 everywhere is left out


def _block_estep(lo: np.ndarray, alpha: float, var_max_iter: int, var_tol: float):
    """E-step of one block under all starts (topics ``lo[i]:lo[i + 1]`` are start i):
    the summed statistics per term, and the bounds as term -1."""
    def estep(docs: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        single_thread_blas()
        if not len(docs):
            return pd.DataFrame(columns=["term_id", "ss"], dtype=object)
        ids, mat, seg, at, cnts = _local(docs, b)
        ss, elbo = np.zeros((len(ids), lo[-1])), []
        for i in range(len(lo) - 1):
            part = mat[lo[i]:lo[i + 1]] if len(ids) else np.zeros((lo[i + 1] - lo[i], 0))
            _, el, _, (uniq, st) = ve_sparse(seg, at, cnts, len(docs), part, alpha, var_max_iter,
                                             var_tol, with_stats=True)
            ss[uniq, lo[i]:lo[i + 1]] = st.T
            elbo.append(float(el.sum()))
        return pd.DataFrame({"term_id": np.append(ids, -1).astype("int32"), "ss": [*ss, np.array(elbo)]})

    return estep


def _fit_lda_joined(rows, V, Ks, alpha, em_max_iter, em_tol, var_max_iter, var_tol, seed, beta0,
                    n_partitions):
    """D1 beyond the broadcast bound: beta is a table ``(term_id, b)``; each EM
    iteration sends every block of documents the rows of its own terms, solves
    the block, and sums the statistics by term.  Only topic totals and bounds
    (starts x K numbers) reach the driver.  An iteration's tables and shuffle files
    are removed as soon as the next one stands on its own."""
    spark = rows.sparkSession
    ship(spark)
    rows, block_terms, n_blocks = _blocks(rows, n_partitions)
    old = scratch(spark, "beta")
    start = _start_columns(spark, V, Ks, seed) if beta0 is None else \
        _topic_columns(beta0 if isinstance(beta0, Topics) else Topics.from_matrix(spark, beta0))
    beta = _normalised(stored(start, old), sum(Ks))
    active = list(range(len(Ks)))
    ll_prev, trace, final, it = {}, {s: [] for s in active}, {}, 0
    while active:
        sizes = [Ks[s] for s in active]
        lo = np.concatenate([[0], np.cumsum(sizes)])

        mine = block_terms.join(beta, "term_id")
        mine = mine.toDF(*mine.columns)         # both sides come from one table
        solved = (_met(rows, mine, n_blocks)
                  .applyInPandas(_block_estep(lo, alpha, var_max_iter, var_tol),
                                 "term_id int, ss array<double>"))
        at = scratch(spark, "statistics")
        stats = stored(solved, at)
        bounds = stats.where("term_id = -1").agg(*[F.sum(F.col("ss")[i]).alias(f"l{i}") for i in range(len(active))]).first()
        going = []
        for i, s in enumerate(active):
            ll = float(bounds[i])
            trace[s].append(ll)
            prev = ll_prev.get(s)
            if it + 1 >= em_max_iter or (prev is not None and abs((prev - ll) / prev) < em_tol):
                long = beta.select("term_id", F.posexplode(F.slice("b", int(lo[i]) + 1, Ks[s])).alias("k", "p"))
                long = long.where("p > 0").select((F.col("k") + 1).alias("topic"), "term_id", "p")
                final[s] = (Topics.from_df(saved(long, "topics"), Ks[s], V), ll)
            else:
                going.append(i)
                ll_prev[s] = ll
        if going:
            keep = [c for i in going for c in range(lo[i], lo[i + 1])]
            summed = (stats.where("term_id >= 0").groupBy("term_id")
                      .agg(F.array(*[F.sum(F.col("ss")[int(c)]) for c in keep]).alias("b")))
            new = scratch(spark, "beta")
            beta = _normalised(stored(summed, new), len(keep))
            drop_folder(spark, old)
            old = new
        drop_folder(spark, at)
        del mine, solved, stats
        release_shuffles(spark)
        active = [active[i] for i in going]
        it += 1
    drop_folder(spark, old)
    return final, trace


def doc_gamma(rows: DataFrame, topics: Topics, alpha: float = 1.0, max_iter: int = 100,
              tol: float = 1e-6) -> DataFrame:
    """Per-document VE-step: ``(doc_id, gamma ARRAY<DOUBLE>, theta ARRAY<DOUBLE>)``."""
    ship(rows.sparkSession)
    schema = "doc_id long, gamma array<double>, theta array<double>"
    if not topics.fits_broadcast:   # each block of documents meets the rows of its own terms
        blocks, terms, n = _blocks(rows, None, "doc_id")
        K = topics.K

        def solve_block(docs: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            single_thread_blas()
            ids, mat, seg, at, cnts = _local(docs, b)
            mat = mat if len(ids) else np.zeros((K, 0))
            g, _, _ = ve_sparse(seg, at, cnts, len(docs), mat, alpha, max_iter, tol)
            return pd.DataFrame({"doc_id": docs["doc_id"], "gamma": list(g),
                                 "theta": list(g / g.sum(1, keepdims=True))})

        mine = terms.join(_topic_columns(topics), "term_id")
        mine = mine.toDF(*mine.columns)         # both sides come from one table
        return _met(blocks, mine, n).applyInPandas(solve_block, schema)
    bc = topics.broadcast()

    def solve(batches):
        single_thread_blas()
        for pdf in batches:
            lens = pdf["terms"].map(len).to_numpy()
            seg = np.repeat(np.arange(len(pdf)), lens)
            terms = np.concatenate(pdf["terms"].to_numpy()).astype(np.int64) if lens.sum() else np.zeros(0, np.int64)
            cnts = np.concatenate(pdf["cnts"].to_numpy()) if lens.sum() else np.zeros(0)
            g, _, _ = ve_sparse(seg, terms, cnts, len(pdf), bc.value, alpha, max_iter, tol)
            th = g / g.sum(1, keepdims=True)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(),
                                "gamma": list(g), "theta": list(th)})

    return rows.mapInPandas(solve, schema)


# ------------------------------------------------------------- C2 / C5 ---

def init_beta_lda(cm: CountMatrix, K: int, alpha: float = 1.0, nstart: int = 5,
                  seed: int = 0, em_max_iter: int = 100, em_tol: float = 1e-4,
                  var_max_iter: int = 20, var_tol: float = 1e-6, rows: DataFrame | None = None) -> Topics:
    """Beta from the best of ``nstart`` variational-EM LDA fits.

    The reference seeds its VEM fit with collapsed-Gibbs starts; a Gibbs
    sampler is sequential, so the starts here are VEM starts with different
    seeds, all sharing each E-step scan."""
    rows = cm.rows() if rows is None else rows
    from ._util import sized_shuffles
    with sized_shuffles(cm.dtm.sparkSession, cm.partitions()):
        res = fit_lda(rows, cm.V, K, alpha, nstart, em_max_iter, em_tol, var_max_iter, var_tol,
                      seed, n_partitions=cm.partitions())
    return res.topics


def init_kmeans_lda(cm: CountMatrix, Q: int, K: int, nruns: int = 1, seed: int = 0,
                    alpha: float = 1.0, nstart: int = 4, var_max_iter: int = 5000,
                    em_max_iter: int = 100, rows: DataFrame | None = None, **_) -> DataFrame:
    """K-topic LDA (alpha 1, beta estimated, ``nstart`` starts), then
    Q-means (MLlib ``KMeans``) on the document topic proportions, keeping the
    lowest within-cluster cost over ``nruns`` seeds; clusters 1..Q."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ._util import sized_shuffles
    rows = cm.rows() if rows is None else rows
    with sized_shuffles(cm.dtm.sparkSession, cm.partitions()):
        lda = fit_lda(rows, cm.V, K, alpha, nstart, em_max_iter, 1e-4, var_max_iter, 1e-6, seed,
                      n_partitions=cm.partitions())
    theta = doc_gamma(rows, lda.topics, alpha, var_max_iter, 1e-6)
    feats = theta.select("doc_id", array_to_vector("theta").alias("features")).persist()
    best, best_cost = None, None
    for r in range(max(1, nruns)):
        model = KMeans(k=Q, seed=seed * 1000 + r, maxIter=100).fit(feats)
        cost = model.summary.trainingCost
        if best_cost is None or cost < best_cost:
            best, best_cost = model, cost
    out = best.transform(feats).select("doc_id", (F.col("prediction") + 1).cast("int").alias("cluster"))
    out = checkpoint(out)
    feats.unpersist()
    lda.topics.release()
    return out
