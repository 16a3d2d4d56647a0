"""The corpus pipeline: five operators of ``countmix.llm`` one after another.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before kept; all but the last return the columns of ``documents``.  Null texts
count as empty, repeated rows and null ids are kept apart by their text, and an
empty table passes through.
"""

from __future__ import annotations

from countmix.llm import bpe, decontam, kneser_ney, queries, secret_scan, simhash
from countmix.llm.common import saved
from countmix.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs, sf_dir):
    """Documents whose perplexity their language's threshold keeps."""
    return kneser_ney.keep_good(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document (the smallest id) of each group of near duplicates."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontam.drop_leaks(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    """Texts with live credentials masked; widely copied examples stay."""
    return secret_scan.redact(docs.select(*COLUMNS), owner_col="source", repo_col="lang")


def encoding(spark, docs, sf_dir):
    """``doc_id, n_tokens, ids`` of each document."""
    return bpe.encode_documents(docs, queries.TOKENIZER).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: SQL cannot express the language model or the encoding; tests/llm compares
#: the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what each returns is written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
