import os
import tempfile

from pyspark.sql import functions as F


def test_stream_term_counts_equals_batch(spark):
    from countmix.operators import text
    from countmix.streaming.counts import stream_term_counts
    src = "/root/testdata/sf0.001/documents.parquet"
    schema = spark.read.parquet(src).schema
    # the file source reads a directory; keep only the documents table's file
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet")
              .parquet(os.path.dirname(src)))
    out = tempfile.mkdtemp(prefix="countmix-stream-")
    q = stream_term_counts(stream, os.path.join(out, "tf"), os.path.join(out, "ckpt"),
                           trigger_once=True)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(out, "tf")).drop("batch_id")
    docs = spark.read.parquet(src)
    want = text.document_term_matrix(text.tokens(docs))
    assert got.count() == want.count()
    assert got.exceptAll(want.select("doc_id", "term", "cnt")).count() == 0
