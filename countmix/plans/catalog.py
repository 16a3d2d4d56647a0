"""Registered queries: each takes ``(spark, data_dir)`` and returns a DataFrame.

Every query reads the given tables (``documents``, ``labels``,
``conversations``, ``events``, ``orders``, ``lineitem``, ``part``) in full and
runs the library's operators on them.  Computed columns are aliased (and
doubles rounded) exactly as in the matching oracle SQL of
:mod:`countmix.plans.oracle`.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gmm, init, matrix, report, starts, stream_lda, text, topics
from ..operators import fit as fitmod
from ..operators._util import saved
from ..operators.fit import Controls
from ..operators.select import select_model
from ..sources import read_table

# Fixed parameters of the registered queries.
SEED = 42
TOP_N = 10
ENTROPY_S = 2.0
MIN_DOCS = 1            # every term with a non-zero total
GAUSS_RIDGE = 1e-6     # share of the mean variance added to every covariance
SMOOTHING = 0.5         # source-group topics are smoothed so no term has p = 0
VE_ITERS = 3            # fixed gamma iterations of the VE oracle queries
STOP_SHARE = 0.5        # stop list: terms in at least half of the documents
FIT_Q, FIT_K = 6, 4
FIT_CONTROLS = Controls()      # the library's defaults: every loop runs to its tolerance
UNTIL_CONVERGED = sys.maxsize  # epochs: a fit ends when no document moves


# ------------------------------------------------------------ shared parts ---

def _docs(spark, sf, cols=("doc_id", "text", "lang", "source")):
    return read_table(spark, sf, "documents", list(cols))


def _tokens(docs):
    """Tokens of the documents, dealt by ``doc_id`` while still whole texts: what
    follows groups and joins by document without another shuffle."""
    return text.tokens(text.dealt(docs, text.part_count(docs)))


def _term_dtm(spark, sf):
    docs = _docs(spark, sf)
    return docs, text.document_term_matrix(_tokens(docs))


def _indexed(spark, sf):
    """docs, vocabulary over every term, and indexed triplets."""
    docs, tdtm = _term_dtm(spark, sf)
    vocab, V = matrix.vocabulary(text.tokens(docs).select("term"), with_count=True)
    return docs, vocab, matrix.index_terms(tdtm, vocab, V)


def _lang_topics(spark, sf):
    """Vocabulary and topics defined by the documents' language."""
    docs, tdtm = _term_dtm(spark, sf)
    beta, vocab = init.beta_from_groups(tdtm, docs, "lang")
    return vocab, beta


def _lang_meta(spark, sf):
    """Meta-documents of the languages; the vocabulary is read off the saved sums."""
    docs, tdtm = _term_dtm(spark, sf)
    meta = saved(matrix.meta_documents(tdtm, init.assign_from_labels(docs, "lang"), every_term=True), "sums")
    vocab, V = matrix.vocabulary(meta.select("term"), with_count=True)
    return matrix.index_terms(meta.where("cluster is not null"), vocab, V)


def _pruned(spark, sf):
    """Count matrix of the documents over all their terms."""
    docs, tdtm = _term_dtm(spark, sf)
    return docs, matrix.build_count_matrix(docs, tdtm, min_docs=MIN_DOCS)


def _ve_state(spark, sf):
    """Meta-documents by language, topics by source (smoothed), VE_ITERS
    gamma iterations: the state shared by the D and batch-round queries."""
    docs, cm = _pruned(spark, sf)
    assign = init.assign_from_labels(docs, "lang")
    beta = init.beta_from_groups(cm.dtm, docs, "source", cm.vocab, cm.V, SMOOTHING)
    meta = matrix.meta_documents(cm.dtm, assign)
    ve = topics.ve_meta(meta, beta, 1.0, VE_ITERS, 0.0)
    return docs, cm, assign, beta, ve


# ----------------------------------------------------------------- queries ---

def top_terms_by_lang(spark, sf):
    """Entropy-weighted top terms of the
    topics defined by the documents' language."""
    vocab, beta = _lang_topics(spark, sf)
    top = report.top_terms(beta.df, vocab, beta.K, TOP_N, ENTROPY_S)
    return top.select("topic", "term", F.round("weight", 9).alias("weight"),
                      F.col("rank").cast("int").alias("rank"))


def term_frequencies(spark, sf):
    """Raw term frequencies (doc_id, term, cnt)."""
    _, tdtm = _term_dtm(spark, sf)
    return tdtm.select("doc_id", "term", F.col("cnt").cast("bigint").alias("cnt"))


def vocabulary(spark, sf):
    """Alphabetical vocabulary (term_id, term)."""
    _, vocab, _ = _indexed(spark, sf)
    return vocab


def vocabulary_de(spark, sf):
    """The vocabulary restricted to terms with a non-zero total in the
    German documents, re-ranked."""
    docs, tdtm = _term_dtm(spark, sf)
    vocab = matrix.vocabulary(tdtm.select("term"))
    de = tdtm.join(docs.filter(F.col("lang") == "de").select("doc_id"), "doc_id", "left_semi")
    return matrix.drop_empty_terms(de, vocab, 1)


def sparse_rows(spark, sf):
    """One row per document (empty ones too), term ids ascending."""
    docs, _, dtm = _indexed(spark, sf)
    return matrix.sparse_rows(dtm, docs.select("doc_id"), text.part_count(docs))


def term_totals(spark, sf):
    """A10: column sums and document frequency per term id."""
    _, _, dtm = _indexed(spark, sf)
    return matrix.term_totals(dtm)


def dims(spark, sf):
    """N, V, nnz and token count."""
    docs, vocab, dtm = _indexed(spark, sf)
    return matrix.dims(docs, vocab, dtm)


def count_matrix_customer_parttype(spark, sf):
    """Customers x part types, weighted by quantity."""
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"])
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    p = read_table(spark, sf, "part", ["p_partkey", "p_type"])
    facts = (li.join(o, li.l_orderkey == o.o_orderkey)
             .join(p, li.l_partkey == p.p_partkey))
    cm = matrix.count_matrix(facts, "o_custkey", "p_type", "l_quantity")
    return cm.select("o_custkey", "p_type", F.round("cnt", 4).alias("cnt"))


def count_matrix_user_event(spark, sf):
    """Users x event types, counting events."""
    ev = read_table(spark, sf, "events", ["user_id", "event_type"])
    return matrix.count_matrix(ev, "user_id", "event_type")


def stopword_removal(spark, sf):
    """A5: drop the terms present in at least half of the documents."""
    docs = _docs(spark, sf, ("doc_id", "text"))
    toks = text.tokens(docs)
    tdtm = text.document_term_matrix(toks)
    stop = text.frequent_terms(tdtm, docs.count(), STOP_SHARE)
    return text.document_term_matrix(text.drop_terms(toks, stop))


def term_mapping(spark, sf):
    """A4: map terms through a term -> canonical table (plural 's' folded onto
    an existing stem), then count."""
    docs = _docs(spark, sf, ("doc_id", "text"))
    toks = text.tokens(docs)
    smap = text.suffix_map(toks.select("term"), "s")
    return text.document_term_matrix(text.map_terms(toks, smap))


def cluster_sizes_lang(spark, sf):
    """B1, B2: sizes and proportions of the language partition."""
    docs = _docs(spark, sf, ("doc_id", "lang"))
    assign = init.assign_from_labels(docs, "lang")
    s = matrix.cluster_sizes(assign, docs.count())
    return s.select("cluster", "n", F.round("pi", 12).alias("pi"))


def meta_documents_lang(spark, sf):
    """Documents summed per language cluster."""
    meta = _lang_meta(spark, sf)
    return meta.select("cluster", "term_id", F.col("cnt").cast("bigint").alias("cnt"))


def cluster_word_counts_lang(spark, sf):
    """Words per language cluster."""
    meta = _lang_meta(spark, sf)
    w = matrix.cluster_word_counts(meta)
    return w.select("cluster", F.col("n_words").cast("bigint").alias("n_words"))


def init_random_partition(spark, sf):
    """Seeded uniform partition into 6 clusters."""
    docs = _docs(spark, sf, ("doc_id",))
    return init.init_random(docs, 6, SEED)


def init_beta_random(spark, sf):
    """C4: near-uniform random topics over the full vocabulary."""
    _, vocab, _ = _indexed(spark, sf)
    V = vocab.count()
    b = init.init_beta_random(vocab, 4, V, SEED)
    return b.select("topic", "term_id", F.round("p", 15).alias("p"))


def beta_by_lang(spark, sf):
    """topics = row-normalised counts of each language."""
    vocab, t = _lang_topics(spark, sf)
    return t.df.select("topic", "term_id", F.round("p", 12).alias("p"))


def beta_by_source_smoothed(spark, sf):
    """C7 with smoothing on the pruned vocabulary: one topic per source."""
    docs, cm = _pruned(spark, sf)
    t = init.beta_from_groups(cm.dtm, docs, "source", cm.vocab, cm.V, SMOOTHING)
    return t.df.select("topic", "term_id", F.round("p", 12).alias("p"))


def topic_weights_by_lang(spark, sf):
    """entropy-corrected weight of every (topic, term)."""
    vocab, t = _lang_topics(spark, sf)
    w = report.entropy_weight(t.df, t.K, ENTROPY_S)
    return w.select("topic", "term_id", F.round("p", 12).alias("p"),
                    F.round("weight", 12).alias("weight"))


def ve_gamma_lang_source(spark, sf):
    """Gamma and theta of each language meta-document under the
    source topics (VE_ITERS fixed iterations)."""
    _, _, _, _, ve = _ve_state(spark, sf)
    g = topics.gamma_long(ve)
    return g.select("cluster", "topic", F.round("gamma", 4).alias("gamma"),
                    F.round("theta", 9).alias("theta"))


def ve_elbo_lang_source(spark, sf):
    """D3: per-meta-document evidence lower bound."""
    _, _, _, _, ve = _ve_state(spark, sf)
    return ve.select("cluster", F.col("n_words").cast("bigint").alias("n_words"),
                     F.round("elbo", 2).alias("elbo"))


def ve_converged_lang_source(spark, sf):
    """D2, D3 to convergence: gamma and lower bound of each language
    meta-document under the source topics, solved as the fits solve it."""
    docs, cm = _pruned(spark, sf)
    assign = init.assign_from_labels(docs, "lang")
    beta = init.beta_from_groups(cm.dtm, docs, "source", cm.vocab, cm.V, SMOOTHING)
    loop = FIT_CONTROLS.loop
    ve = topics.ve_meta(matrix.meta_documents(cm.dtm, assign), beta, loop.alpha,
                        loop.var_max_iter, loop.var_tol, accelerate=loop.accelerate)
    return ve.select("cluster", "n_words", "elbo", "gamma")


def bound_icl_lang_source(spark, sf):
    """Total bound of the language partition and its ICL."""
    docs, cm, assign, beta, ve = _ve_state(spark, sf)
    sizes = matrix.cluster_sizes(assign, cm.N)
    Q = sizes.count()
    b = topics.total_bound(ve, sizes, cm.N)
    icl = topics.icl_col(F.col("bound"), F.lit(float(beta.K)), F.lit(float(cm.V)),
                         F.lit(float(Q)), F.lit(float(cm.N)))
    return b.select(F.round("bound", 2).alias("bound"), F.round(icl, 2).alias("icl"))


def _batch_round(spark, sf):
    docs, cm, assign, beta, ve = _ve_state(spark, sf)
    gam = {(r.run, r.cluster): r.gamma for r in ve.collect()}   # Q x K values
    sizes = {0: [r.n for r in sorted(matrix.cluster_sizes(assign, cm.N).collect(),
                                     key=lambda r: r.cluster)]}
    E = fitmod.e_table(spark, gam)
    bdf = beta.df.withColumn("run", F.lit(0))
    lnz = fitmod.cluster_log_z(bdf, E)
    sc = fitmod.batch_scores(cm.dtm, cm.docs, lnz, len(gam) * cm.V, sizes, cm.N)
    best = fitmod.best_clusters(sc)
    return docs, cm, assign, best


def batch_round_lang_source(spark, sf):
    """E1, E2 (batch form): one simultaneous reassignment of every document
    from the language partition under the source topics."""
    _, _, _, best = _batch_round(spark, sf)
    return best.select("doc_id", "cluster", F.round("score", 4).alias("score"))


def move_meta_lang_source(spark, sf):
    """Apply the batch round's moves to the language meta-documents by
    signed addition of the moved rows (no rebuild from scratch)."""
    _, cm, assign, best = _batch_round(spark, sf)
    meta = matrix.meta_documents(cm.dtm, assign)
    moves = (best.select("doc_id", F.col("cluster").alias("to_cluster"))
             .join(assign.withColumnRenamed("cluster", "from_cluster"), "doc_id")
             .filter(F.col("to_cluster") != F.col("from_cluster")))
    out = matrix.move_meta(meta, cm.dtm, moves)
    return out.select("cluster", "term_id", F.col("cnt").cast("bigint").alias("cnt"))


def tidy_beta_lang(spark, sf):
    """F1: tidy topics (topic, term, beta) of the language topics."""
    vocab, t = _lang_topics(spark, sf)
    tb = report.tidy_beta(t.df, vocab)
    return tb.select("topic", "term", F.round("beta", 12).alias("beta"))


def contingency_lang_quality(spark, sf):
    """language x quality label (documents with a label)."""
    docs = _docs(spark, sf, ("doc_id", "lang"))
    lab = read_table(spark, sf, "labels", ["doc_id", "quality"])
    return report.contingency(docs, lab)


def ari_lang_source(spark, sf):
    """adjusted Rand index between the language and source partitions."""
    docs = _docs(spark, sf, ("doc_id", "lang", "source"))
    a = report.adjusted_rand_index(docs.select("doc_id", "lang"), docs.select("doc_id", "source"))
    return a.select(F.round("ari", 12).alias("ari"))


def top_terms_by_role(spark, sf):
    """A1-A6, C7, F3 on the conversations: top terms of each speaker role."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    d = conv.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "role", "text")
    tdtm = text.document_term_matrix(text.tokens(d))
    vocab, V = matrix.vocabulary(tdtm.select("term"), with_count=True)
    dtm = matrix.index_terms(tdtm, vocab, V)
    beta = init.beta_from_groups(dtm, d, "role", vocab)
    top = report.top_terms(beta.df, vocab, beta.K, TOP_N, ENTROPY_S)
    return top.select("topic", "term", F.round("weight", 9).alias("weight"),
                      F.col("rank").cast("int").alias("rank"))


# ------------------------------------------------- fits (no SQL oracle) ---

def _fit_batch(spark, sf):
    docs, cm = _pruned(spark, sf)
    return docs, cm, fitmod.fit(cm, FIT_Q, FIT_K, "random", "lda", FIT_CONTROLS,
                                max_epochs=UNTIL_CONVERGED, nruns=2, mode="batch", seed=SEED)


def fit_batch_documents(spark, sf):
    """E2-E4, E6, E8-E10 (batch mode) with C1, C5, D1: the clustering."""
    _, _, res = _fit_batch(spark, sf)
    return res.assign


def bound_table_batch(spark, sf):
    """F4 on the batch fit's bound trace."""
    _, cm, res = _fit_batch(spark, sf)
    return report.bound_table(res.trace, cm.N, res.keep)


def ari_fit_lang(spark, sf):
    """F6 between the batch clustering and the language labels."""
    docs, _, res = _fit_batch(spark, sf)
    return report.adjusted_rand_index(res.assign, docs.select("doc_id", "lang"))


def fit_greedy_documents(spark, sf):
    """E1-E6, E9 (greedy mode): exact sequential moves from the language
    partition under the source topics, until no move is left."""
    docs, cm = _pruned(spark, sf)
    assign = init.assign_from_labels(docs, "lang")
    beta = init.beta_from_groups(cm.dtm, docs, "source", cm.vocab, cm.V, SMOOTHING)
    res = fitmod.fit(cm, 4, beta.K, assign, beta, FIT_CONTROLS,
                     max_epochs=UNTIL_CONVERGED, mode="greedy")
    return res.assign


def move_table_lang_source(spark, sf):
    """E1 (exact form): for every document and every cluster the bound change
    of moving it there (staying scores 0), language partition, source topics."""
    docs, cm = _pruned(spark, sf)
    assign = init.assign_from_labels(docs, "lang")
    beta = init.beta_from_groups(cm.dtm, docs, "source", cm.vocab, cm.V, SMOOTHING)
    return fitmod.move_table(cm, assign, beta, FIT_CONTROLS)


def select_model_grid(spark, sf):
    """ICL grid over K in (2, 3) and Q in (2, 3), 2 restarts, batch mode."""
    _, cm = _pruned(spark, sf)
    sel = select_model(cm, [2, 3], [2, 3], "random", "lda", FIT_CONTROLS,
                       max_epochs=UNTIL_CONVERGED, nruns=2, mode="batch", seed=SEED)
    return sel.grid


def lda_topics(spark, sf):
    """LDA by variational EM, K = 4, the default number of starts."""
    _, cm = _pruned(spark, sf)
    ctl = FIT_CONTROLS.init
    res = topics.fit_lda(cm.rows(), cm.V, 4, ctl.alpha, FIT_CONTROLS.beta_starts, ctl.em_max_iter,
                         ctl.em_tol, ctl.var_max_iter, ctl.var_tol, SEED)
    return res.topics.df


def lda_minibatch_topics(spark, sf):
    """The same model by streamed minibatches, with the default controls."""
    _, cm = _pruned(spark, sf)
    ctl = FIT_CONTROLS.init
    return stream_lda.fit_lda_minibatch(cm.rows(), cm.V, 4, ctl.alpha, FIT_CONTROLS.beta_starts,
                                        var_max_iter=ctl.var_max_iter, var_tol=ctl.var_tol, seed=SEED).best.df


def kmeans_lda_partition(spark, sf):
    """K-means (Q = 6) on the LDA topic proportions of every document."""
    _, cm = _pruned(spark, sf)
    return topics.init_kmeans_lda(cm, 6, 4, nruns=2, seed=SEED,
                                  em_max_iter=FIT_CONTROLS.init.em_max_iter)


def tfidf_unit_rows(spark, sf):
    """C3 option: TF-IDF rows of length 1."""
    _, cm = _pruned(spark, sf)
    return starts.tfidf(cm.dtm, cm.N, cm.V, cm.tasks()).select("doc_id", "term_id", F.round("w", 9).alias("w"))


def mixture_two_steps(spark, sf):
    """C3 option: two EM steps of the mixture of multinomials from the languages."""
    docs, cm = _pruned(spark, sf)
    start = init.assign_from_labels(docs, "lang")
    Q = start.agg(F.max("cluster")).first()[0] or 0
    if not Q:
        return spark.createDataFrame([], "doc_id long, cluster int, loglik double")
    fit = starts.fit_mixture(cm, start, Q, SMOOTHING, max_iter=2, tol=0.0)
    best = F.array_position("r", F.array_max("r")).cast("int")
    return fit.resp.select("doc_id", best.alias("cluster"), F.round("ll", 4).alias("loglik"))


def kmeans_two_steps(spark, sf):
    """C3 option: two rounds of k-means on the TF-IDF rows from the languages."""
    docs, cm = _pruned(spark, sf)
    start = init.assign_from_labels(docs, "lang")
    Q = start.agg(F.max("cluster")).first()[0] or 0
    if not Q:
        return spark.createDataFrame([], "doc_id long, cluster int")
    fit = starts.fit_kmeans(starts.tfidf(cm.dtm, cm.N, cm.V, cm.tasks()), cm.docs, Q, cm.V, start, max_iter=2)
    return fit.assign.select("doc_id", "cluster")


def mixture_partition(spark, sf):
    """C3 option: the mixture of multinomials, Q = 6, to convergence."""
    _, cm = _pruned(spark, sf)
    return starts.init_mixture(cm, FIT_Q, seed=SEED)


def kmeans_partition(spark, sf):
    """C3 option: k-means on the TF-IDF rows, Q = 6, to convergence."""
    _, cm = _pruned(spark, sf)
    return starts.init_kmeans(cm, FIT_Q, seed=SEED, weighting="tfidf")


def gaussian_two_steps(spark, sf):
    """C3 option: two EM steps of a full-covariance Gaussian mixture from the languages,
    on the logarithms of each document's characters and words."""
    docs = _docs(spark, sf).where("doc_id is not null")
    body = F.coalesce("text", F.lit(""))
    points = docs.select("doc_id", F.array(F.log(F.length(body) + 1.0), F.log(F.size(F.split(body, " ")) + 0.0)).alias("x"))
    start = init.assign_from_labels(docs, "lang")
    Q = start.agg(F.max("cluster")).first()[0] or 0
    if not Q:
        return spark.createDataFrame([], "doc_id long, cluster int, loglik double")
    model = gmm.fit_gmm(points, Q, start=start, tol=0.0, max_iter=1, ridge=GAUSS_RIDGE)
    return gmm.assign_points(points, model).select("doc_id", "cluster", F.round("ll", 5).alias("loglik"))


def gmm_lda_partition(spark, sf):
    """C3 option: Gaussian mixture (Q = 6) on the LDA topic proportions, to convergence."""
    _, cm = _pruned(spark, sf)
    return gmm.init_gmm_lda(cm, FIT_Q, FIT_K, nruns=2, seed=SEED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "top_terms_by_lang": top_terms_by_lang,
    "term_frequencies": term_frequencies,
    "vocabulary": vocabulary,
    "vocabulary_de": vocabulary_de,
    "sparse_rows": sparse_rows,
    "term_totals": term_totals,
    "dims": dims,
    "count_matrix_customer_parttype": count_matrix_customer_parttype,
    "count_matrix_user_event": count_matrix_user_event,
    "stopword_removal": stopword_removal,
    "term_mapping": term_mapping,
    "cluster_sizes_lang": cluster_sizes_lang,
    "meta_documents_lang": meta_documents_lang,
    "cluster_word_counts_lang": cluster_word_counts_lang,
    "init_random_partition": init_random_partition,
    "init_beta_random": init_beta_random,
    "beta_by_lang": beta_by_lang,
    "beta_by_source_smoothed": beta_by_source_smoothed,
    "topic_weights_by_lang": topic_weights_by_lang,
    "ve_gamma_lang_source": ve_gamma_lang_source,
    "ve_elbo_lang_source": ve_elbo_lang_source,
    "ve_converged_lang_source": ve_converged_lang_source,
    "bound_icl_lang_source": bound_icl_lang_source,
    "batch_round_lang_source": batch_round_lang_source,
    "move_meta_lang_source": move_meta_lang_source,
    "tidy_beta_lang": tidy_beta_lang,
    "contingency_lang_quality": contingency_lang_quality,
    "ari_lang_source": ari_lang_source,
    "top_terms_by_role": top_terms_by_role,
    "fit_batch_documents": fit_batch_documents,
    "bound_table_batch": bound_table_batch,
    "ari_fit_lang": ari_fit_lang,
    "fit_greedy_documents": fit_greedy_documents,
    "move_table_lang_source": move_table_lang_source,
    "select_model_grid": select_model_grid,
    "lda_topics": lda_topics,
    "lda_minibatch_topics": lda_minibatch_topics,
    "kmeans_lda_partition": kmeans_lda_partition,
    "tfidf_unit_rows": tfidf_unit_rows,
    "mixture_two_steps": mixture_two_steps,
    "kmeans_two_steps": kmeans_two_steps,
    "mixture_partition": mixture_partition,
    "kmeans_partition": kmeans_partition,
    "gaussian_two_steps": gaussian_two_steps,
    "gmm_lda_partition": gmm_lda_partition,
}
