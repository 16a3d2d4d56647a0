import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import count_matrix_of, planted_docs
from countmix.functions.kernel import ve_dense, warm_start
from countmix.operators import init, matrix, report, topics
from countmix.operators.fit import Controls, FitResult, VemControl, fit, move_table
from countmix.operators.select import select_model

TIGHT = Controls(init=VemControl(em_max_iter=30, var_max_iter=100, var_tol=1e-8),
                 loop=VemControl(alpha=1.0, estimate_beta=False, var_max_iter=100000,
                                 var_tol=1e-12), beta_starts=2)


@pytest.fixture(scope="module")
def planted(spark):
    docs, truth = planted_docs(spark, per_cluster=4, clusters=3)
    cm = count_matrix_of(docs)
    beta = init.beta_from_groups(cm.dtm, truth.withColumnRenamed("cluster", "g"), "g",
                                 cm.vocab, cm.V, smoothing=0.5)
    return docs, truth, cm, beta


def dense(cm):
    pdf = cm.dtm.toPandas()
    ids = sorted(r.doc_id for r in cm.docs.collect())
    pos = {d: i for i, d in enumerate(ids)}
    X = np.zeros((cm.N, cm.V))
    X[[pos[d] for d in pdf.doc_id], pdf.term_id.to_numpy()] = pdf.cnt.to_numpy()
    return ids, X


def sequential_greedy(X, Y, beta, alpha, tol, max_epochs):
    """Plain sequential loop over documents, the reference's order and rules."""
    N, V = X.shape
    Q = int(Y.max())
    Y = Y.copy()
    meta = np.zeros((Q, V))
    for d in range(N):
        meta[Y[d] - 1] += X[d]
    sizes = np.bincount(Y - 1, minlength=Q)
    gam, elbo = ve_dense(meta, beta, alpha, 100000, tol, accelerate=True)
    words = meta.sum(1)
    for _ in range(max_epochs):
        y0 = Y.copy()
        b0 = elbo.sum()
        for d in range(N):
            a = Y[d] - 1
            if sizes[a] <= 1:
                continue
            others = [q for q in range(Q) if q != a]
            cand = meta[[a] + others].copy()
            cand[0] -= X[d]
            cand[1:] += X[d]
            nd = X[d].sum()
            g0 = warm_start(gam[[a] + others], words[[a] + others],
                            words[[a] + others] + np.r_[-nd, np.full(Q - 1, nd)], alpha)
            g, el = ve_dense(cand, beta, alpha, 100000, tol, g0, accelerate=True)
            delta = np.zeros(Q)
            na = sizes[a]
            for k, q in enumerate(others):
                nq = sizes[q]
                delta[q] = (el[0] - elbo[a] + el[k + 1] - elbo[q] + (na - 1) * math.log((na - 1) / N)
                            + (nq + 1) * math.log((nq + 1) / N) - na * math.log(na / N)
                            - nq * math.log(nq / N))
            best = int(np.argmax(delta))
            if best != a:
                k = others.index(best)
                meta[a] -= X[d]
                meta[best] += X[d]
                words[a] -= nd
                words[best] += nd
                sizes[a] -= 1
                sizes[best] += 1
                elbo[a], elbo[best] = el[0], el[k + 1]
                gam[a], gam[best] = g[0], g[k + 1]
                Y[d] = best + 1
        if (Y == y0).all() and elbo.sum() == b0:
            break
    pi = sum(n * math.log(n / N) for n in sizes if n > 0)
    return Y, elbo.sum() + pi


def test_greedy_matches_sequential_loop(spark, planted):
    docs, truth, cm, beta = planted
    start = init.init_random(cm.docs, 3, seed=3)
    res = fit(cm, 3, beta.K, start, beta, TIGHT, max_epochs=4, mode="greedy")
    ids, X = dense(cm)
    y0 = dict((r.doc_id, r.cluster) for r in start.collect())
    Y, bound = sequential_greedy(X, np.array([y0[d] for d in ids]), beta.matrix(), 1.0, 1e-12, 4)
    got = dict((r.doc_id, r.cluster) for r in res.assign.collect())
    assert [got[d] for d in ids] == list(Y)
    assert abs(res.bound - bound) < 1e-6 * abs(bound)


def test_planted_corpus_recovered(spark, planted):
    docs, truth, cm, beta = planted
    start = init.init_random(cm.docs, 3, seed=11)
    res = fit(cm, 3, beta.K, start, beta, TIGHT, max_epochs=5, mode="greedy")
    ari = report.adjusted_rand_index(res.assign, truth).collect()[0].ari
    assert ari == pytest.approx(1.0)


def test_fit_invariants(spark, planted):
    """The reference's own checks: class, K, Q, Q clusters, N rows, ICL < 0,
    bound < 0, non-decreasing trace, beta K x V stochastic, gamma Q x K."""
    docs, truth, cm, beta = planted
    res = fit(cm, 3, 3, truth, "random", TIGHT, max_epochs=1, keep=1, mode="greedy")
    assert isinstance(res, FitResult)
    assert (res.K, res.Q) == (3, 3)
    a = res.assign.collect()
    assert len(a) == cm.N and len({r.cluster for r in a}) == 3
    assert res.icl < 0 and res.bound < 0
    tr = [r.bound for r in res.trace.orderBy("iteration").collect()]
    assert tr == sorted(tr)
    B = res.topics.matrix()
    assert B.shape == (3, cm.V) and np.allclose(B.sum(1), 1.0)
    assert res.gamma.count() == 3 * 3


def test_batch_fit_monotone_and_partition_independent(spark, planted):
    docs, truth, cm, beta = planted
    start = init.init_random(cm.docs, 3, seed=5)
    out = {}
    for p in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        res = fit(cm, 3, beta.K, start, beta, TIGHT, max_epochs=6, mode="batch")
        out[p] = sorted((r.doc_id, r.cluster) for r in res.assign.collect())
        tr = [r.bound for r in res.trace.orderBy("iteration").collect()]
        assert all(b2 >= b1 - 1e-6 * abs(b1) for b1, b2 in zip(tr, tr[1:]))
        assert res.sizes.agg(F.sum("n")).collect()[0][0] == cm.N
        assert res.sizes.filter("n = 0").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out["1"] == out["8"]


def test_move_table_matches_brute_force(spark, planted):
    docs, truth, cm, beta = planted
    start = init.init_random(cm.docs, 3, seed=9)
    mt = {(r.doc_id, r.to_cluster): r.delta for r in move_table(cm, start, beta, TIGHT).collect()}
    ids, X = dense(cm)
    y = dict((r.doc_id, r.cluster) for r in start.collect())
    Y = np.array([y[d] for d in ids])
    B = beta.matrix()
    N = cm.N

    def bound_of(Yv):
        meta = np.zeros((3, cm.V))
        for i in range(N):
            meta[Yv[i] - 1] += X[i]
        _, el = ve_dense(meta, B, 1.0, 100000, 1e-13)
        n = np.bincount(Yv - 1, minlength=3)
        return el.sum() + sum(k * math.log(k / N) for k in n if k > 0)

    base = bound_of(Y)
    sizes = np.bincount(Y - 1, minlength=3)
    for i, d in enumerate(ids):
        for q in (1, 2, 3):
            if q == Y[i] or sizes[Y[i] - 1] <= 1:
                assert mt[(d, q)] == 0.0
                continue
            Z = Y.copy()
            Z[i] = q
            assert mt[(d, q)] == pytest.approx(bound_of(Z) - base, rel=1e-6, abs=1e-5)


def test_validation_errors(spark, planted):
    docs, truth, cm, beta = planted
    with pytest.raises(ValueError):
        fit(cm, 3, 1, "random", "random", TIGHT)                      # K < 2
    with pytest.raises(ValueError):
        fit(cm, 3, 3, "random", "random", TIGHT, keep=0)              # keep < 1
    with pytest.raises(ValueError):
        fit(cm, 3, 3, truth.limit(5), "random", TIGHT)                # wrong length
    with pytest.raises(ValueError):
        fit(cm, 3, 3, truth.withColumn("cluster", F.lit(1)), "random", TIGHT)  # too few groups
    with pytest.raises(ValueError):
        fit(cm, 3, 3, "no_such_init", "random", TIGHT)                # unknown init
    with pytest.raises(ValueError):
        fit(cm, 3, 3, truth, np.ones((3, cm.V + 1)) / (cm.V + 1), TIGHT)  # bad beta shape
    with pytest.raises(ValueError):
        fit(cm, 3, 3, truth, "nmf", TIGHT)                            # unknown beta method
    with pytest.raises(ValueError):
        select_model(cm, [2, 3], [2], truth, "random", TIGHT)         # partition with 2 Qs
    with pytest.raises(ValueError):
        select_model(cm, [3], [2, 3], truth, np.ones((2, cm.V)) / cm.V, TIGHT)  # beta with 2 Ks


def test_labels_relabelled_densely(spark, planted):
    docs, truth, cm, beta = planted
    odd = truth.withColumn("cluster", F.col("cluster") * 10 + 3)
    a = init.check_assign(odd, cm.docs, 3)
    assert sorted({r.cluster for r in a.collect()}) == [1, 2, 3]


def test_init_functions_give_q_clusters(spark):
    from conftest import planted_docs as pd_
    docs, _ = pd_(spark, per_cluster=5, clusters=2, words_per_doc=10)
    cm = count_matrix_of(docs)
    for name in ("random", "rand", "kmeans_lda", "kmeans+lda", "KMEANS.LDA"):
        a = init.init_clusters(cm, 3, 2, name, seed=1)
        assert a.select("cluster").distinct().count() == 3
        assert a.count() == cm.N


def test_lda_beta_is_stochastic(spark, planted):
    docs, truth, cm, beta = planted
    res = topics.fit_lda(cm.rows(), cm.V, 3, 1.0, 2, 30, 1e-4, 100, 1e-8, seed=1)
    B = res.topics.matrix()
    assert B.shape == (3, cm.V) and np.allclose(B.sum(1), 1.0)
    tr = res.trace
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(tr, tr[1:]))


def test_select_model_grid(spark, planted):
    docs, truth, cm, beta = planted
    sel = select_model(cm, [2, 3], [2, 3], "random", "random", TIGHT, max_epochs=3, nruns=2)
    g = sel.grid.collect()
    assert len(g) == 4
    best = max(g, key=lambda r: r.icl)
    assert (sel.model.K, sel.model.Q) == (best.k, best.q)
    assert sel.model.icl == pytest.approx(best.icl)


def test_dense_index_matches_sorted(spark):
    df = spark.createDataFrame([(t,) for t in ["b", "a", "é", "z", "a", "B", "ab"]], "term string")
    v = matrix.vocabulary(df).collect()
    want = sorted({"b", "a", "é", "z", "B", "ab"}, key=lambda s: s.encode())
    assert [r.term for r in sorted(v, key=lambda r: r.term_id)] == want


def test_batch_guard_keeps_clusters_non_empty(spark, planted):
    """Uniform topics: every document prefers the largest cluster, so the
    guard must keep one member in each cluster (the one losing least)."""
    docs, truth, cm, beta = planted
    uniform = np.full((3, cm.V), 1.0 / cm.V)
    start = init.init_random(cm.docs, 4, seed=2)
    res = fit(cm, 4, 3, start, uniform, TIGHT, max_epochs=4, mode="batch")
    sizes = {r.cluster: r.n for r in res.sizes.collect()}
    assert set(sizes) == {1, 2, 3, 4} and min(sizes.values()) >= 1
    assert sum(sizes.values()) == cm.N
    tr = [r.bound for r in res.trace.orderBy("iteration").collect()]
    assert all(b2 >= b1 - 1e-6 * abs(b1) for b1, b2 in zip(tr, tr[1:]))


def test_estimate_beta_in_loop(spark, planted):
    """Beta re-estimated on the meta-documents after each round / move;
    it stays a stochastic K x V matrix and the fit still ends."""
    import dataclasses
    docs, truth, cm, beta = planted
    ctl = dataclasses.replace(TIGHT, loop=dataclasses.replace(TIGHT.loop, estimate_beta=True,
                                                              em_max_iter=5, var_max_iter=200,
                                                              var_tol=1e-8))
    start = init.init_random(cm.docs, 3, seed=4)
    for mode in ("batch", "greedy"):
        res = fit(cm, 3, beta.K, start, beta, ctl, max_epochs=2, mode=mode)
        B = res.topics.matrix()
        assert np.allclose(B.sum(1), 1.0) and res.bound < 0


def test_alpha_mismatch_warns_and_report_types(spark, planted):
    docs, truth, cm, beta = planted
    ctl = Controls(init=VemControl(alpha=2.0), loop=TIGHT.loop, beta_starts=1)
    with pytest.warns(UserWarning):
        res = fit(cm, 3, beta.K, truth, beta, ctl, max_epochs=1, mode="batch")
    assert report.report_table(res, cm.vocab, "bound").count() >= 1
    assert report.report_table(res, cm.vocab, "topics", n_words=3).count() >= 3 * 3
    with pytest.raises(ValueError):
        report.report_table(res, cm.vocab, "histogram")


PLAIN30 = Controls(init=TIGHT.init, loop=VemControl(alpha=1.0, estimate_beta=False,
                                                    var_max_iter=30, var_tol=0.0,
                                                    accelerate=False), beta_starts=1)


def test_distributed_ve_matches_numpy(spark, planted):
    """Beyond the broadcast bound the VE-step runs as Spark jobs (digamma as a
    Column, join + aggregates per iteration): same gamma and bound."""
    docs, truth, cm, beta = planted
    meta = matrix.meta_documents(cm.dtm, truth)
    a = {r.cluster: r for r in topics.ve_meta(meta, beta, 1.0, 30, 0.0, strategy="numpy").collect()}
    b = {r.cluster: r for r in topics.ve_meta(meta, beta, 1.0, 30, 0.0, strategy="spark").collect()}
    assert set(a) == set(b)
    for q in a:
        assert a[q].elbo == pytest.approx(b[q].elbo, rel=1e-9)
        assert np.allclose(a[q].gamma, b[q].gamma, rtol=1e-9)


def test_batch_fit_beyond_broadcast_bound(spark, planted, monkeypatch):
    """With tiny bounds the batch fit scores by a shuffle join on term_id and
    solves VE-steps as Spark jobs; it must make the same decisions."""
    import countmix.operators._util as U
    import countmix.operators.fit as FMOD
    import countmix.operators.topics as TMOD
    from countmix.config import Limits
    docs, truth, cm, beta = planted
    start = init.init_random(cm.docs, 3, seed=5)
    ref = fit(cm, 3, beta.K, start, beta, PLAIN30, max_epochs=3, mode="batch")
    tiny = Limits(max_broadcast_rows=1, max_broadcast_bytes=1)
    for mod in (U, FMOD, TMOD):
        monkeypatch.setattr(mod, "LIMITS", tiny)
    beta2 = init.beta_from_groups(cm.dtm, truth.withColumnRenamed("cluster", "g"), "g",
                                  cm.vocab, cm.V, smoothing=0.5)
    got = fit(cm, 3, beta2.K, start, beta2, PLAIN30, max_epochs=3, mode="batch")
    assert sorted(map(tuple, got.assign.collect())) == sorted(map(tuple, ref.assign.collect()))
    assert got.bound == pytest.approx(ref.bound, rel=1e-9)


def test_registered_queries_run_to_convergence(spark):
    """The catalog's controls are the library's, and its VE query ends at a fixed
    point: a further iteration changes no bound."""
    from countmix.operators import init, matrix, topics
    from countmix.operators.fit import Controls
    from countmix.plans import catalog
    assert catalog.FIT_CONTROLS == Controls()
    sf = "/root/testdata/sf0.001"
    docs, cm = catalog._pruned(spark, sf)
    got = {r.cluster: r for r in catalog.ve_converged_lang_source(spark, sf).collect()}
    beta = init.beta_from_groups(cm.dtm, docs, "source", cm.vocab, cm.V, catalog.SMOOTHING)
    meta = matrix.meta_documents(cm.dtm, init.assign_from_labels(docs, "lang"))
    more = topics.ve_meta(meta, beta, 1.0, 1, 0.0, gamma0={(0, q): np.array(r.gamma) for q, r in got.items()}).collect()
    assert {r.cluster for r in more} == set(got)
    for r in more:
        assert abs(r.elbo - got[r.cluster].elbo) <= 1e-7 * abs(r.elbo)
