"""One answer from every physical path, and the traces and rules around them."""

import numpy as np
import pytest
from conftest import count_matrix_of, planted_docs
from pyspark.sql import functions as F

from countmix.config import Limits
from countmix.functions.special import digamma
from countmix.operators import fit as fitmod
from countmix.operators import init, matrix, report, topics
from countmix.operators.fit import Controls, VemControl


def zero_state(spark):
    """A planted corpus and topics in which one used term has probability 0."""
    docs, truth = planted_docs(spark)
    cm = count_matrix_of(docs)
    beta = np.random.default_rng(3).random((3, cm.V))
    beta[:, 4] = 0.0
    beta /= beta.sum(1, keepdims=True)
    return cm, truth, topics.Topics.from_matrix(spark, beta)


def test_zero_probability_term_is_left_out_on_every_path(spark):
    cm, truth, beta = zero_state(spark)
    meta = matrix.meta_documents(cm.dtm, truth)
    got = {}
    for name, strategy, fast in (("plain", "numpy", False), ("fast", "numpy", True), ("joined", "spark", False)):
        rows = topics.ve_meta(meta, beta, 1.0, 100_000, 1e-12, None, strategy, fast).collect()
        got[name] = np.array([r.elbo for r in sorted(rows, key=lambda r: r.cluster)])
        assert np.isfinite(got[name]).all()
    without = meta.where("term_id <> 4")
    same = topics.ve_meta(without, beta, 1.0, 100_000, 1e-12, None, "numpy", False).collect()
    want = np.array([r.elbo for r in sorted(same, key=lambda r: r.cluster)])
    for name, elbo in got.items():
        assert np.allclose(elbo, want, rtol=1e-7), name


def test_moves_are_finite_and_classes_of_terms_are_exact(spark):
    cm, truth, beta = zero_state(spark)
    controls = Controls(loop=VemControl(estimate_beta=False, var_max_iter=10**6, var_tol=1e-12))
    table = fitmod.move_table(cm, truth, beta, controls).collect()
    assert len(table) == cm.N * 3 and all(np.isfinite(r.delta) for r in table)
    m = beta.matrix()
    cols, of = fitmod.term_classes(np.concatenate([m, m[:, :5]], axis=1))
    assert cols.shape[1] <= cm.V and (cols[:, of[:cm.V]] == m).all()


def test_scores_joined_equal_scores_of_the_fit(spark):
    """The SQL form (oracle-checked) and the kernel that fits use agree."""
    cm, truth, beta = zero_state(spark)
    empty = spark.createDataFrame([(999,)], "doc_id long")
    docs = cm.docs.select("doc_id").unionByName(empty)
    gammas = {(0, q): np.array([1.0 + q, 2.0, 5.0 - q]) for q in (1, 2, 3)}
    sizes = {0: np.array([3, 3, 4])}
    lnz = fitmod.cluster_log_z(beta.df.withColumn("run", F.lit(0)), fitmod.e_table(spark, gammas))
    want = {r.doc_id: (r.cluster, r.score) for r in fitmod.best_clusters(fitmod.batch_scores(cm.dtm, docs, lnz, 3 * cm.V, sizes, 10)).collect()}
    g = np.array([gammas[(0, q)] for q in (1, 2, 3)])
    with np.errstate(divide="ignore"):
        L = np.log(np.exp(digamma(g) - digamma(g.sum(1))[:, None]) @ beta.matrix())
    rows = matrix.sparse_rows(cm.dtm, docs).withColumn("cur", F.create_map(F.lit(0), F.lit(1)))
    got = {r.doc_id: (r.cluster, r.score) for r in fitmod.best_clusters_numpy(rows, L, np.log(sizes[0] / 10), np.zeros(3, int), np.array([1, 2, 3])).collect()}
    assert set(got) == set(want) and len(got) == 10
    for d in want:
        assert got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9


def test_batch_trace_counts_visits_and_keeps(spark):
    docs, _ = planted_docs(spark)
    cm = count_matrix_of(docs)
    res = fitmod.fit(cm, 3, 3, "random", "random", Controls(), max_epochs=6, mode="batch", seed=2)
    rows = sorted(res.trace.collect(), key=lambda r: r.iteration)
    assert [r.iteration for r in rows] == [k * cm.N for k in range(len(rows))]
    assert rows[-1].bound == res.bound
    table = sorted(report.bound_table(res.trace, cm.N, res.keep).collect(), key=lambda r: r.iteration)
    assert [r.epoch for r in table] == list(range(1, len(rows) + 1)) and all(r.epoch_start for r in table)
    some = fitmod.fit(cm, 3, 3, "random", "random", Controls(), max_epochs=6, keep=2 * cm.N, mode="batch", seed=2)
    its = sorted(r.iteration for r in some.trace.collect())
    last = (len(rows) - 1) * cm.N
    assert its == sorted({*range(0, last + 1, 2 * cm.N), last})


def test_reestimated_topics_end_the_trace(spark):
    docs, _ = planted_docs(spark)
    cm = count_matrix_of(docs)
    controls = Controls(loop=VemControl(estimate_beta=True, var_max_iter=2000, var_tol=1e-9, em_max_iter=5))
    res = fitmod.fit(cm, 3, 3, "random", "random", controls, max_epochs=2, mode="batch", seed=2)
    assert max(res.trace.collect(), key=lambda r: r.iteration).bound == res.bound


def test_one_topic_weight_and_topic_checks(spark):
    beta = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75)], "topic int, term_id int, p double")
    assert {r.term_id: r.weight for r in report.entropy_weight(beta, 1).collect()} == {0: 0.25, 1: 0.75}
    bad = topics.Topics.from_df(beta.withColumn("p", F.col("p") * 1.01), 1, 2)
    with pytest.raises(ValueError):
        init.check_topics(bad)
    good = np.full((2, 50_000), 1 / 50_000)
    assert init.check_beta(good, 2, 50_000).shape == good.shape
    with pytest.raises(ValueError):
        init.check_beta(good * (1 + 1e-9), 2, 50_000)


def test_many_labels_rank_in_order(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("label"), F.lpad((F.col("id") * 7 % 3000).cast("string"), 5, "0")).alias("name"))
    got = {r.doc_id: r.cluster for r in init.assign_from_labels(df, "name").collect()}
    assert got == {i: i * 7 % 3000 + 1 for i in range(5000)}


def test_checkpoint_folder_must_be_set_on_a_cluster():
    from countmix.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_lda_beyond_the_broadcast_bound_is_the_same(spark, monkeypatch):
    """The table path (beta never on the driver) repeats the array path."""
    from countmix.config import Limits
    docs, _ = planted_docs(spark)
    cm = count_matrix_of(docs)
    args = dict(alpha=1.0, em_max_iter=6, em_tol=1e-9, var_max_iter=200, var_tol=1e-10, seed=5, return_all=True, n_partitions=3)
    want = topics.fit_lda(cm.rows(), cm.V, [2, 3], **args)
    gamma = {r.doc_id: r.theta for r in topics.doc_gamma(cm.rows(), topics.Topics.from_matrix(spark, want[1][0]), 1.0, 500, 1e-10).collect()}
    monkeypatch.setattr(topics, "LIMITS", Limits(max_broadcast_bytes=64))
    got = topics.fit_lda(cm.rows(), cm.V, [2, 3], **args)
    for s in want:
        m = np.zeros_like(want[s][0])
        for r in got[s][0].df.collect():
            m[r.topic - 1, r.term_id] = r.p
        assert np.allclose(m, want[s][0], atol=1e-8)
        assert abs(got[s][1] - want[s][1]) < 1e-6 * abs(want[s][1])
    same = {r.doc_id: r.theta for r in topics.doc_gamma(cm.rows(), got[1][0], 1.0, 500, 1e-10).collect()}
    assert all(np.allclose(same[d], gamma[d], atol=1e-6) for d in gamma) and len(same) == len(gamma)


def test_default_fit_runs_at_any_vocabulary(spark, monkeypatch):
    from countmix.config import Limits
    docs, truth = planted_docs(spark)
    cm = count_matrix_of(docs)
    controls = Controls(init=VemControl(em_max_iter=4, var_max_iter=50), loop=VemControl(estimate_beta=False, var_max_iter=60, var_tol=1e-6), beta_starts=1)
    for module in (topics, fitmod):
        monkeypatch.setattr(module, "LIMITS", Limits(max_broadcast_bytes=64))
    res = fitmod.fit(cm, 3, 3, truth, controls=controls, max_epochs=1, seed=1)
    assert res.assign.count() == cm.N and np.isfinite(res.bound)


def test_scores_in_small_runs_are_the_same(spark, monkeypatch):
    from countmix.config import Limits
    cm, truth, beta = zero_state(spark)
    rows = matrix.sparse_rows(cm.dtm, cm.docs).withColumn("cur", F.create_map(F.lit(0), F.lit(1)))
    L = np.log(np.random.default_rng(0).random((3, cm.V)))

    def scores():
        got = fitmod.best_clusters_numpy(rows, L, np.zeros(3), np.zeros(3, int), np.array([1, 2, 3])).collect()
        return sorted((r.doc_id, r.cluster, round(r.score, 9)) for r in got)

    want = scores()
    monkeypatch.setattr(fitmod, "LIMITS", Limits(score_cells=10))
    assert scores() == want


def test_joined_lda_removes_its_iterations(spark, monkeypatch):
    import glob

    from countmix.session import ensure_checkpoint_dir
    monkeypatch.setattr(topics, "LIMITS", Limits(max_broadcast_bytes=64))
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    kept = lambda: sum(bool(glob.glob(f"{d}/**/*.parquet", recursive=True) or glob.glob(f"{d}/part-*")) for d in glob.glob(f"{folder}/*"))
    rows = spark.createDataFrame([(d, [d % 5, 5 + d % 3], [1.0 + d % 4, 2.0]) for d in range(40)], "doc_id long, terms array<int>, cnts array<double>")
    before = kept()
    res = topics.fit_lda(rows, 8, 2, nstart=1, em_max_iter=6, em_tol=0.0, n_partitions=2)
    assert len(res.trace) == 6 and res.topics.df.count() > 0
    assert kept() - before <= 3     # blocks, their terms and the fitted topics


def test_topics_of_string_triplets_equal_those_of_ids(spark):
    from countmix.operators import init, matrix
    trip = spark.createDataFrame([(1, "aa", 2), (1, "bb", 1), (2, "bb", 3), (3, "cc", 1), (None, "cc", 9)], "doc_id long, term string, cnt long")
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "x"), (4, "z"), (5, None)], "doc_id long, g string")
    vocab, V = matrix.vocabulary(trip.select("term"), with_count=True)
    ids = matrix.index_terms(trip, vocab, V)
    assert ids.columns == ["doc_id", "term_id", "cnt"]
    for s in (0.0, 0.5):
        a, b = (sorted(map(tuple, init.beta_from_groups(t, docs, "g", vocab, V, s).df.collect())) for t in (trip, ids))
        assert a == b
    want = {(k + 1, t): (c + 0.5) / (sum(row) + 1.5) for k, row in enumerate([[2, 1, 1], [0, 6, 0], [0, 0, 0]]) for t, c in enumerate(row)}
    got = {(r.topic, r.term_id): r.p for r in init.beta_from_groups(trip, docs, "g", vocab, V, 0.5).df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_sums_of_groups_give_the_vocabulary(spark):
    """Without a vocabulary it is that of all triplets, also of rows without a label."""
    from countmix.operators import init, matrix
    trip = spark.createDataFrame([(1, "aa", 2), (1, "bb", 1), (2, "bb", 3), (3, "cc", 1), (5, "dd", 4), (None, "ee", 9)], "doc_id long, term string, cnt long")
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (2, None), (3, "x"), (4, "z"), (5, None), (None, "x")], "doc_id long, g string")
    vocab, V = matrix.vocabulary(trip.select("term"), with_count=True)
    for s in (0.0, 0.5):
        t, own = init.beta_from_groups(trip, docs, "g", smoothing=s)
        assert (t.K, t.V) == (3, 5) and sorted(map(tuple, own.collect())) == sorted(map(tuple, vocab.collect()))
        assert sorted(map(tuple, t.df.collect())) == sorted(map(tuple, init.beta_from_groups(trip, docs, "g", vocab, V, s).df.collect()))
    a = init.assign_from_labels(docs, "g")
    meta = matrix.meta_documents(trip, a, every_term=True)
    assert sorted(map(tuple, meta.where("cluster is not null").collect())) == sorted(map(tuple, matrix.meta_documents(trip, a).collect()))
    assert sorted((r.term, r.cnt) for r in meta.where("cluster is null").collect()) == [("dd", 4), ("ee", 9)]


def test_language_queries_split_texts_once(spark, tmp_path, monkeypatch):
    from countmix.operators import text
    from countmix.plans import catalog
    rows = [(1, "one two two", "en", "s"), (2, "zwei drei", "de", "s"), (3, "nur hier", None, "t"), (None, "four", "en", "t"), (4, None, "fr", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, tokens = [], text.tokens
    monkeypatch.setattr(text, "tokens", lambda *a, **k: calls.append(1) or tokens(*a, **k))
    for name, n in (("topic_weights_by_lang", 4), ("top_terms_by_lang", 4), ("tidy_beta_lang", 4), ("meta_documents_lang", 4), ("cluster_word_counts_lang", 2)):
        del calls[:]
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == n
        assert len(calls) == 1
    # ids count the terms of documents without a language or an id
    assert [tuple(r) for r in catalog.meta_documents_lang(spark, str(tmp_path)).orderBy("cluster", "term_id").collect()] == [(1, 0, 1), (1, 6, 1), (2, 4, 1), (2, 5, 2)]


def test_normalising_strips_in_one_pass(spark):
    from pyspark.sql import functions as F
    from countmix.functions import normalise_text
    got = spark.createDataFrame([(" A1-b\u2014\u00b2c\u2160 $d\t\n e+ ",), ("\U0001d7ce\U0001f600x.",), (None,)], "t string")
    assert [r[0] for r in got.select(normalise_text("t")).collect()] == ["abc d e", "x", None]
    assert str(normalise_text(F.col("t"))).count("regexp_replace") == 2


def test_default_driver_state_fits_a_small_driver():
    # collected, unpacked, pickled: about five copies beside the JVM of a driver of 1.5 GB
    assert 5 * Limits().max_broadcast_bytes <= 256 * 1024 * 1024
    assert 40 * Limits().max_driver_cells <= 256 * 1024 * 1024
