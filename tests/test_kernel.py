import math

import numpy as np

from countmix.functions.kernel import ve_dense, ve_sparse, warm_start
from countmix.functions.special import digamma, lgamma


def test_special_functions():
    xs = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 10.0, 1e4])
    assert np.allclose(lgamma(xs), [math.lgamma(v) for v in xs], rtol=1e-12, atol=1e-9)
    assert abs(digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10
    # psi(x+1) = psi(x) + 1/x
    assert np.allclose(digamma(xs + 1), digamma(xs) + 1 / xs, atol=1e-10)


def _data():
    rng = np.random.default_rng(0)
    K, V = 4, 60
    beta = rng.dirichlet(np.ones(V), K)
    X = rng.poisson(2, (6, V)).astype(float)
    X[3] = 0
    return beta, X


def test_sparse_equals_dense_and_gamma_sums():
    beta, X = _data()
    seg, terms = np.nonzero(X)
    g1, e1, _ = ve_sparse(seg, terms, X[seg, terms], len(X), beta, 1.0, 500, 1e-12)
    g2, e2 = ve_dense(X, beta, 1.0, 500, 1e-12)
    assert np.allclose(g1, g2) and np.allclose(e1, e2)
    assert np.allclose(g1.sum(1), 4 * 1.0 + X.sum(1))
    assert e1[3] == 0.0                      # empty document: bound 0


def test_bound_monotone_in_iterations():
    beta, X = _data()
    seg, terms = np.nonzero(X)
    prev = None
    for m in range(1, 10):
        _, e, _ = ve_sparse(seg, terms, X[seg, terms], len(X), beta, 1.0, m, 0.0)
        if prev is not None:
            assert (e - prev >= -1e-9).all()
        prev = e


def test_warm_start_same_fixed_point():
    beta, X = _data()
    g, e = ve_dense(X, beta, 1.0, 5000, 1e-14)
    Y = X.copy()
    Y[0, :5] += 1
    g0 = warm_start(g, X.sum(1), Y.sum(1), 1.0)
    gw, ew = ve_dense(Y, beta, 1.0, 5000, 1e-14, g0)
    gc, ec = ve_dense(Y, beta, 1.0, 5000, 1e-14)
    assert np.allclose(ew, ec, rtol=1e-9)


def test_lda_stats_sum_to_tokens():
    beta, X = _data()
    seg, terms = np.nonzero(X)
    *_, (u, ss) = ve_sparse(seg, terms, X[seg, terms], len(X), beta, 1.0, 50, 1e-8, with_stats=True)
    assert abs(ss.sum() - X.sum()) < 1e-8
