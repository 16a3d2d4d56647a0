import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from countmix.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8)
    yield s


def _letters(n: int) -> str:
    """A letters-only word for an integer (the normaliser strips digits)."""
    out = ""
    for _ in range(4):
        out = chr(97 + n % 26) + out
        n //= 26
    return "q" + out


def planted_docs(spark, per_cluster=3, clusters=3, words_per_doc=40, seed=7):
    """Planted corpus: cluster c draws its words from its own disjoint list."""
    import numpy as np
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    doc = 0
    for c in range(clusters):
        vocab = [_letters(c * 100 + j) for j in range(12)]
        for _ in range(per_cluster):
            words = rng.choice(vocab, size=words_per_doc)
            rows.append((doc, " ".join(words)))
            truth.append((doc, c + 1))
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tr = spark.createDataFrame(truth, "doc_id long, cluster int")
    return docs, tr


def count_matrix_of(docs, min_docs=1):
    from countmix.operators import matrix, text
    return matrix.build_count_matrix(docs, text.document_term_matrix(text.tokens(docs)), min_docs)
