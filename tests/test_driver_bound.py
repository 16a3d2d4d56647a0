"""Topics past the number of cells that the driver may collect stay tables."""

import numpy as np
import pytest

from countmix.config import Limits
from countmix.operators import fit as fitmod
from countmix.operators import matrix, text, topics


@pytest.fixture()
def cm(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"term{chr(97 + int(t))}" for t in rng.integers(0, 12, 30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return matrix.build_count_matrix(docs, text.document_term_matrix(text.tokens(docs)))


def test_bound_in_cells():
    few = Limits(max_driver_cells=5)
    assert few.fits_driver(5) and not few.fits_driver(6)
    assert not Limits(max_broadcast_bytes=8).fits_driver(2)
    # 0.1 GB of the check tables: 896,189 terms and 4 topics
    assert not Limits().fits_driver(4 * 896_189)


def test_topics_are_not_collected_past_it(spark, cm, monkeypatch):
    beta = np.random.default_rng(3).dirichlet(np.ones(cm.V), 2)
    dense = topics.Topics.from_matrix(spark, beta)
    table = topics.Topics.from_df(dense.df, 2, cm.V)
    assert np.array_equal(topics.Topics.from_df(dense.df, 2, cm.V).matrix(), beta)
    want = {r["doc_id"]: r["gamma"] for r in topics.doc_gamma(cm.rows(), dense, max_iter=20).collect()}
    for mod in (topics, fitmod):
        monkeypatch.setattr(mod, "LIMITS", Limits(max_driver_cells=2 * cm.V - 1))
    assert not table.fits_broadcast
    with pytest.raises(MemoryError):
        table.matrix()
    got = {r["doc_id"]: r["gamma"] for r in topics.doc_gamma(cm.rows(), table, max_iter=20).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], rtol=1e-9) for d in want)
