"""Operators 9 and 10: against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from countmix.llm import lsh, simhash


def slow_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(v >> k & 1 for v in h) * 2 > len(h))


def slow_components(values, ids, bits=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [min(x for x in groups[find(i)] if x is not None) for i in range(len(values))]


def documents():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "éta", "theta"]
    base = [" ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(120)) for _ in range(6)]
    out = ["", None, " \t\n", "one", "ONE", "one two", "x" * 30000]
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = "changed"
            out.append("  ".join(w))
    return out + [base[0]] * 20


@pytest.mark.parametrize("hot", [100_000, 2])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    texts = documents()
    ids = [i * 3 + 1 for i in range(len(texts))]
    ids[10] = ids[11]  # an id that repeats
    df = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts)], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    values = [slow_fingerprint(t or "") for t in texts]
    want = sorted((d, f"{v:016x}", c) for d, v, c in zip(ids, values, slow_components(values, ids)))
    assert sorted(map(tuple, got)) == want
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


def test_links_through_rows_without_an_id(spark, monkeypatch):
    """Fingerprints 0 (no id), 0b111 (id 1), 0b111111 (id 7): one component."""
    rows = spark.createDataFrame([(None, 10, 0), (1, 11, 0b111), (7, 12, 0b111111), (None, 13, -1)], "doc_id long, text_hash long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: rows)
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert got == {"0" * 16: 1, "0" * 14 + "07": 1, "0" * 14 + "3f": 1, "f" * 16: None}


def test_an_id_on_two_texts_loses_no_group(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve thirteen"
    rows = [(1, a), (5, a), (5, b), (9, b), (None, b), (3, "x"), (3, "x"), (None, "only without an id y"), (None, "only without an id y")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, a), (5, b), (3, "x"), (None, "only without an id y")], key=str)


def test_trie_join_finds_all_links():
    rng = np.random.default_rng(0)
    x = []
    for b in rng.integers(0, 2**64, 60, dtype=np.uint64):
        for _ in range(rng.integers(1, 30)):
            v = b
            for _ in range(rng.integers(0, 5)):
                v ^= np.uint64(1) << np.uint64(rng.integers(64))
            x.append(v)
    x = np.unique(np.array(x, dtype=np.uint64))
    near = simhash.popcount(x[:, None] ^ x[None, :]) <= 3

    def groups(pairs):
        links = simhash.Links(len(x))
        links.add(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        return links.root

    found = []
    for k in range(4):
        s = np.uint64(16 * k)
        key = (x << s) | (x >> (np.uint64(64) - s)) if k else x
        whole = np.full(len(x), -1)
        a, b = simhash.join_cells(np.stack([np.full(len(x), k), (key >> np.uint64(48)).astype(np.int64), whole, whole]), key, 3, 16)
        found += list(zip(a, b))
    assert (groups(found) == groups(list(zip(*np.nonzero(near))))).all()


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(20, 40)] + [(5, i) for i in range(100, 160)] + [(7, 7)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(21, 41)}, **{i: 5 for i in range(100, 160)}}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def vectors(n=1200, d=16, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    x[50:80] = x[49]  # equal vectors
    return x


def test_nearest_recall_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(lsh, "BLOCK_VECTORS", 300)
    monkeypatch.setattr(lsh, "BLOCK_QUERIES", 20)
    x = vectors()
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    bad = [(10_000, None, 1), (10_020, [0.0] * 16, 1), (10_040, [None] + [1.0] * 15, 1), (10_060, [float("nan")] * 16, 1), (10_080, [float("inf")] * 16, 1), (None, rows[0][1], 1), (10_100, [1.0], 1), rows[20]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = lsh.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    y = x.astype(np.float64)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1200, 20))
    for q, found in by.items():
        s = y @ y[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(s)), -s))[:20]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(order.tolist()))
        total += 20
    assert hits / total >= 0.9
    # a query with 29 equals: the smallest ids, itself left out
    assert [r.vec_id for r in by[60]] == [i for i in range(49, 80) if i != 60][:20]


def test_budget_with_a_shared_component():
    """Vectors that agree in a component are neighbours like any others."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12))
    budget = lambda v: lsh.fit_index(v, float(np.linalg.norm(v, axis=1).max()), 5, 4, 6, 0.8, 0.9).budget
    alike = np.concatenate([np.full((400, 1), 1e-3), x[:, 1:]], axis=1)
    unlike = np.concatenate([rng.permutation(400)[:, None] * 1e-9 + 1e-3, x[:, 1:]], axis=1)
    assert budget(alike) == pytest.approx(budget(unlike), rel=1e-3)


def test_nearest_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in lsh.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert lsh.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0
