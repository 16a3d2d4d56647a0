"""The text-to-triplets operators (A1-A6) on a Structured Streaming source.

Nothing here is new semantics: each micro-batch runs the same
:func:`countmix.operators.text.tokens` and
:func:`countmix.operators.text.document_term_matrix` as the batch path and
writes ``(doc_id, term, cnt)`` triplets to its own partition ``batch_id`` of a
parquet sink.  A document
arrives whole in one micro-batch, so per-batch counts are final counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import MIN_TERM_LENGTH
from ..operators import text


def stream_term_counts(stream: DataFrame, sink_path: str, checkpoint_location: str,
                       min_len: int = MIN_TERM_LENGTH,
                       trigger_once: bool = False) -> StreamingQuery:
    """Start a query writing the term frequencies of a ``(doc_id, text)``
    stream to ``sink_path`` (parquet, partitioned by batch_id).  ``checkpoint_location`` must
    be reliable storage; the query restarts from it after a failure."""

    def write(batch: DataFrame, batch_id: int) -> None:
        toks = text.tokens(batch.select("doc_id", "text"), min_len=min_len)
        # a retried batch replaces what its first try left
        out = f"{sink_path.rstrip('/')}/batch_id={batch_id}"
        text.document_term_matrix(toks).write.mode("overwrite").parquet(out)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
