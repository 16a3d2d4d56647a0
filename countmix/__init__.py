"""countmix: clustering of count data (documents x terms, customers x products,
users x events) with a mixture of meta-documents sharing LDA topics, on Spark.

Typical use::

    from countmix import get_spark, text, matrix, fit
    spark = get_spark()
    docs = spark.read.parquet(".../documents.parquet").select("doc_id", "text")
    cm = matrix.build_count_matrix(docs, text.document_term_matrix(text.tokens(docs)))
    res = fit(cm, Q=6, K=4, mode="batch")
"""

from .operators import init, matrix, report, text, topics
from .operators.fit import Controls, FitResult, VemControl, fit
from .operators.select import select_model
from .session import get_spark

__all__ = ["init", "matrix", "report", "text", "topics", "Controls", "FitResult",
           "VemControl", "fit", "select_model", "get_spark"]
