"""Variational E-step of LDA with the topic matrix held fixed (numpy only).

For counts n_v, symmetric Dirichlet ``alpha`` and topics ``beta`` (K x V):

    e_k   = psi(gamma_k) - psi(sum gamma)
    z_v   = sum_k beta_kv exp(e_k)
    ELBO  = lnG(K alpha) - K lnG(alpha) + (alpha - 1) sum_k e_k + sum_v n_v ln z_v
            - lnG(sum gamma) + sum_k lnG(gamma_k) - sum_k (gamma_k - 1) e_k
    gamma_k <- alpha + exp(e_k) sum_v n_v beta_kv / z_v

``gamma`` starts at ``alpha + (sum n)/K``.  Iteration t evaluates the bound at
the current gamma; it stops once ``|dELBO| <= tol * |ELBO_prev|`` or after
``max_iter`` gamma updates, and returns the last gamma with its own bound.
Each row (segment) converges independently.  A term whose probability is 0 in
every topic is left out of the bound and of the update (the same rule as the
inner join of the distributed path).  The updated gamma always sums to
``K alpha + sum n``, so it is already the un-normalised gamma of a cluster.

These functions run inside Spark tasks (``applyInPandas`` / ``mapInPandas``)
on Arrow batches; they never see more than one task's share of the data.
"""

from __future__ import annotations

import numpy as np

from .special import digamma, lgamma

_BLAS_PINNED = False


def single_thread_blas() -> None:
    """Pin the BLAS bundled with numpy to one thread in this process.

    Spark already runs one task per core; a multi-threaded BLAS inside every
    Python worker would oversubscribe the cores.  Sessions built with
    :func:`countmix.session.get_spark` set the thread variables for workers;
    this covers any other session (a no-op when no OpenBLAS is found)."""
    global _BLAS_PINNED
    if _BLAS_PINNED:
        return
    _BLAS_PINNED = True
    try:
        import ctypes
        import glob
        import os
        base = os.path.dirname(os.path.dirname(np.__file__))
        for path in glob.glob(os.path.join(base, "numpy.libs", "*openblas*")):
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads",
                         "openblas_set_num_threads64_", "openblas_set_num_threads"):
                fn = getattr(lib, name, None)
                if fn is not None:
                    fn(1)
                    return
    except Exception:  # pragma: no cover - best effort only
        pass


def _bound(gamma, e, ll, alpha, K):
    const = lgamma(np.array(K * alpha)) - K * lgamma(np.array(alpha))
    gsum = gamma.sum(1)
    return (const + (alpha - 1.0) * e.sum(1) + ll - lgamma(gsum)
            + lgamma(gamma).sum(1) - ((gamma - 1.0) * e).sum(1))


def _converged(prev, cur, tol):
    with np.errstate(invalid="ignore"):
        return np.abs(cur - prev) <= tol * np.abs(prev)


def _segsum(x, starts, nz, n):
    """Per-segment sums of a flat array whose segments are contiguous."""
    out = np.zeros(n)
    if nz.any():
        out[nz] = np.add.reduceat(x, starts[nz])
    return out


def ve_sparse(seg, terms, cnts, n_seg, beta, alpha, max_iter=100, tol=1e-9,
              gamma0=None, with_stats=False):
    """VE-step for ``n_seg`` sparse count vectors given as flat triplets.

    seg   int array (nnz,)  row index in [0, n_seg)
    terms int array (nnz,)  column index into beta
    cnts  float array (nnz,)
    Returns ``gamma (n_seg, K)``, ``elbo (n_seg,)``, ``iters (n_seg,)`` and,
    with ``with_stats``, the expected topic counts ``(uniq_terms, ss (K, U))``
    summed over all rows (the M-step statistics of LDA).  Rows are processed
    as contiguous segments (``np.repeat`` / ``np.add.reduceat``), so every
    pass over the non-zeros is sequential.
    """
    beta = np.asarray(beta, dtype=np.float64)
    K = beta.shape[0]
    seg = np.asarray(seg, dtype=np.int64)
    terms = np.asarray(terms, dtype=np.int64)
    cnts = np.asarray(cnts, dtype=np.float64)
    if len(seg) > 1 and (np.diff(seg) < 0).any():
        order = np.argsort(seg, kind="stable")
        seg, terms, cnts = seg[order], terms[order], cnts[order]
    lens_all = np.bincount(seg, minlength=n_seg)
    tot = np.bincount(seg, weights=cnts, minlength=n_seg)
    if gamma0 is None:
        gamma = alpha + np.repeat((tot / K)[:, None], K, axis=1)
    else:
        gamma = np.array(gamma0, dtype=np.float64, copy=True)
    out_gamma = np.empty((n_seg, K))
    out_elbo = np.empty(n_seg)
    out_iter = np.zeros(n_seg, dtype=np.int64)

    ids = np.arange(n_seg)          # original row of each active row
    lens, B, c = lens_all, beta[:, terms], cnts
    prev = np.full(n_seg, np.nan)
    frozen = np.zeros(n_seg, bool)  # finished rows not yet compacted away
    t = 0
    while True:
        n = len(ids)
        nz = lens > 0
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        gsum = gamma.sum(1)
        e = digamma(gamma) - digamma(gsum)[:, None]
        ee = np.exp(e)
        z = B[0] * np.repeat(ee[:, 0], lens)
        for k in range(1, K):
            z += B[k] * np.repeat(ee[:, k], lens)
        if len(z) == 0 or z.min() > 0:          # usual case: no masking passes
            pos = None
            ll = _segsum(c * np.log(z), starts, nz, n)
        else:
            pos = z > 0
            with np.errstate(divide="ignore"):
                lz = np.where(pos, np.log(np.where(pos, z, 1.0)), 0.0)
            ll = _segsum(c * lz, starts, nz, n)
        elbo = _bound(gamma, e, ll, alpha, K)
        done = _converged(prev, elbo, tol) if t > 0 else np.zeros(n, bool)
        if t >= max_iter:
            done[:] = True
        new = done & ~frozen
        if new.any():
            out_gamma[ids[new]] = gamma[new]
            out_elbo[ids[new]] = elbo[new]
            out_iter[ids[new]] = t
        frozen |= done
        if frozen.all():
            break
        r = c / z if pos is None else np.where(pos, c / np.where(pos, z, 1.0), 0.0)
        S = np.empty((n, K))
        for k in range(K):
            S[:, k] = _segsum(B[k] * r, starts, nz, n)
        gamma = np.where(frozen[:, None], gamma, alpha + ee * S)
        prev = np.where(frozen, prev, elbo)
        if frozen.sum() * 4 >= n:            # compact once a quarter has finished
            keep = ~frozen
            tok = np.repeat(keep, lens)
            B, c = B[:, tok], c[tok]
            lens, ids = lens[keep], ids[keep]
            gamma, prev = gamma[keep], prev[keep]
            frozen = np.zeros(len(ids), bool)
        t += 1

    if not with_stats:
        return out_gamma, out_elbo, out_iter
    uniq, inv = np.unique(terms, return_inverse=True)
    ee = np.exp(digamma(out_gamma) - digamma(out_gamma.sum(1))[:, None])
    Bf = beta[:, terms]
    w = Bf * np.repeat(ee, lens_all, axis=0).T          # K x nnz
    z = w.sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        phi = np.where(z > 0, cnts / z, 0.0) * w
    ss = np.empty((K, len(uniq)))
    for k in range(K):
        ss[k] = np.bincount(inv, weights=phi[k], minlength=len(uniq))
    return out_gamma, out_elbo, out_iter, (uniq, ss)


def warm_start(gamma_ref, n_ref, n_new, alpha):
    """Start for a count vector close to a solved one: the solved gamma's
    excess over alpha rescaled to the new total (rows of arrays)."""
    gamma_ref = np.asarray(gamma_ref, dtype=np.float64)
    scale = np.where(np.asarray(n_ref) > 0, np.asarray(n_new) / np.maximum(n_ref, 1e-300), 0.0)
    K = gamma_ref.shape[-1]
    start = alpha + (gamma_ref - alpha) * scale[..., None]
    empty_ref = np.asarray(n_ref) <= 0
    if np.any(empty_ref):
        start[empty_ref] = alpha + (np.asarray(n_new)[empty_ref] / K)[..., None]
    return start


def _map(gamma, X, Bt, mask, alpha, K):
    """Bound at gamma and one gamma update F(gamma), for dense rows."""
    e = digamma(gamma) - digamma(gamma.sum(1))[:, None]
    ee = np.exp(e)
    z = ee @ Bt
    ok = mask & (z > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ll = (X * np.log(np.where(ok, z, 1.0))).sum(1)
    elbo = _bound(gamma, e, ll, alpha, K)
    r = np.where(ok, X / np.where(ok, z, 1.0), 0.0)
    return elbo, alpha + ee * (r @ Bt.T)


def _squarem(X, Bt, mask, alpha, max_iter, tol, gamma):
    """SQUAREM-accelerated gamma iteration (Varadhan & Roland 2008, step
    scheme 3) with a monotone guard: an extrapolated point whose bound is
    below the cycle's start is replaced by the plain two-step point, so the
    bound never decreases and the fixed point is the plain iteration's.
    ``max_iter`` counts gamma updates (maps)."""
    K = Bt.shape[0]
    C = X.shape[0]
    out_gamma = np.empty((C, K))
    out_elbo = np.empty(C)
    ids = np.arange(C)
    elbo0, g1 = _map(gamma, X, Bt, mask, alpha, K)
    g0 = gamma
    prev = np.full(C, np.nan)
    evals, t = 1, 0
    while True:
        done = _converged(prev, elbo0, tol) if t > 0 else np.zeros(len(ids), bool)
        if evals >= max_iter:
            done[:] = True
        if done.any():
            out_gamma[ids[done]] = g0[done]
            out_elbo[ids[done]] = elbo0[done]
            keep = ~done
            if not keep.any():
                break
            X, mask, ids = X[keep], mask[keep], ids[keep]
            g0, g1, elbo0 = g0[keep], g1[keep], elbo0[keep]
        e1, g2 = _map(g1, X, Bt, mask, alpha, K)
        r = g1 - g0
        v = g2 - 2.0 * g1 + g0
        nr = np.sqrt((r * r).sum(1))
        nv = np.sqrt((v * v).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(nv > 0, -nr / nv, -1.0)
        a = np.minimum(a, -1.0)[:, None]
        gp = g0 - 2.0 * a * r + a * a * v
        bad = ~np.isfinite(gp).all(1) | (gp <= 0).any(1)
        gp[bad] = g2[bad]
        ep, gp1 = _map(gp, X, Bt, mask, alpha, K)
        evals += 3
        reject = ~(ep >= elbo0)
        if reject.any():
            e2, g21 = _map(g2[reject], X[reject], Bt, mask[reject], alpha, K)
            gp[reject], ep[reject], gp1[reject] = g2[reject], e2, g21
            evals += 1
        prev = elbo0
        g0, elbo0, g1 = gp, ep, gp1
        t += 1
    return out_gamma, out_elbo


def ve_dense(counts, beta, alpha, max_iter=100, tol=1e-9, gamma0=None, accelerate=False):
    """VE-step for a small batch of dense count rows ``counts (C, V)``.

    Used for meta-documents and greedy candidates (a meta-document plus or
    minus one document): BLAS products over the batch.  Columns that are zero
    in every row are dropped first.  ``accelerate`` switches the plain
    iteration to SQUAREM (same fixed point, far fewer maps on large counts).
    """
    counts = np.asarray(counts, dtype=np.float64)
    beta = np.asarray(beta, dtype=np.float64)
    cols = np.flatnonzero(counts.any(0))
    X = counts[:, cols]
    Bt = beta[:, cols]
    K = Bt.shape[0]
    C = X.shape[0]
    mask = X > 0
    tot = X.sum(1)
    if gamma0 is None:
        gamma = alpha + np.repeat((tot / K)[:, None], K, axis=1)
    else:
        gamma = np.array(gamma0, dtype=np.float64, copy=True)
    if accelerate:
        return _squarem(X, Bt, mask, alpha, max_iter, tol, gamma)
    out_gamma = np.empty((C, K))
    out_elbo = np.empty(C)
    ids = np.arange(C)
    prev = np.full(C, np.nan)
    t = 0
    while True:
        gsum = gamma.sum(1)
        e = digamma(gamma) - digamma(gsum)[:, None]
        ee = np.exp(e)
        z = ee @ Bt
        ok = mask & (z > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = (X * np.log(np.where(ok, z, 1.0))).sum(1)
        elbo = _bound(gamma, e, ll, alpha, K)
        done = _converged(prev, elbo, tol) if t > 0 else np.zeros(len(ids), bool)
        if t >= max_iter:
            done[:] = True
        if done.any():
            out_gamma[ids[done]] = gamma[done]
            out_elbo[ids[done]] = elbo[done]
        if done.all():
            break
        r = np.where(ok, X / np.where(ok, z, 1.0), 0.0)
        gamma = alpha + ee * (r @ Bt.T)
        prev = elbo
        if done.any():
            keep = ~done
            X, mask, ids = X[keep], mask[keep], ids[keep]
            gamma, prev = gamma[keep], prev[keep]
        t += 1
    return out_gamma, out_elbo
