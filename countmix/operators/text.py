"""Text to tokens to document-term triplets.

All steps are JVM expressions or joins; a corpus of any size streams through
one narrow stage until the single shuffle of :func:`document_term_matrix`,
which pre-aggregates (doc, term) pairs map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import MIN_TERM_LENGTH, normalise_text, split_terms
from ._util import bounded_broadcast


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           min_len: int = MIN_TERM_LENGTH, normalise: bool = True) -> DataFrame:
    """``(doc_id, term)`` with one row per token occurrence (repeats kept).

    Normalises (lower, no digits, no punctuation, single spaces), splits on
    spaces and keeps terms of at least ``min_len`` characters.
    """
    text = normalise_text(text_col) if normalise else F.col(text_col)
    out = df.select(F.col(id_col).alias("doc_id"),
                    F.explode(split_terms(text)).alias("term"))
    return out.filter(F.length("term") >= max(int(min_len), 1))


def part_count(df: DataFrame, text_col: str = "text", part_bytes: int | None = None) -> int:
    """Parts of about ``part_bytes`` of text (``LIMITS.text_part_bytes``), at least one
    per core."""
    size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-size // (part_bytes or LIMITS.text_part_bytes)))


def dealt(df: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` dealt by id into ``parts``.  As their number is given, parts are
    not put together again by their shuffled size: what a text becomes (tokens and
    their counts) is many times that and has to fit into a task."""
    return df.select(id_col, text_col).repartition(parts, id_col)


def map_terms(toks: DataFrame, term_map: DataFrame, n_map: int | None = None) -> DataFrame:
    """Replace terms through a ``(term, canonical)`` table; unmapped terms stay.

    The map is broadcast when its exact size is within the bound, otherwise
    both sides are shuffled on ``term``.
    """
    m = term_map.select("term", "canonical").dropDuplicates(["term"])
    m = bounded_broadcast(m, n_map)
    return (toks.join(m, "term", "left")
            .select("doc_id", F.coalesce("canonical", "term").alias("term")))


def drop_terms(toks: DataFrame, stop: DataFrame, n_stop: int | None = None) -> DataFrame:
    """Remove every occurrence of the terms in ``stop(term)`` (left anti join)."""
    s = bounded_broadcast(stop.select("term").distinct(), n_stop)
    return toks.join(s, "term", "left_anti").select("doc_id", "term")


def document_term_matrix(toks: DataFrame) -> DataFrame:
    """Raw term frequencies as non-zero triplets ``(doc_id, term, cnt BIGINT)``."""
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


def frequent_terms(dtm: DataFrame, n_docs: int, min_share: float) -> DataFrame:
    """Terms present in at least ``min_share`` of the ``n_docs`` documents.

    A data-derived stop list for :func:`drop_terms`.
    """
    df = dtm.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.filter(F.col("df") >= F.lit(min_share * n_docs)).select("term")


def suffix_map(terms: DataFrame, suffix: str = "s") -> DataFrame:
    """``(term, canonical)``: a term ending in ``suffix`` maps to its stem when
    the stem is itself a term (a light stand-in for stemming; see README)."""
    t = terms.select("term").distinct()
    cand = (t.filter(F.col("term").endswith(suffix)
                     & (F.length("term") > len(suffix)))
            .withColumn("canonical", F.expr(f"substring(term, 1, length(term) - {len(suffix)})")))
    stems = t.select(F.col("term").alias("canonical"))
    return cand.join(stems, "canonical", "left_semi").select("term", "canonical")
