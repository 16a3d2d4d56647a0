"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import bpe, decontam, hpylm, kneser_ney, line_dedup, lsh, merkle, prefix_trie, secret_scan, seqfile, simhash, wrappers, zdict
from .common import held_out, saved
from .oracle import SQL

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as Arrow files, read the files back."""
    docs = read_table(spark, sf_dir, "documents")
    manifest = seqfile.write_sequences(docs, TOKENIZER)
    return seqfile.read_digests(spark, manifest)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the hierarchical Pitman-Yor
    model of the documents that are not held out."""
    return hpylm.score(read_table(spark, sf_dir, "documents"), held_out("doc_id", 1))


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's inferred wrapper."""
    return wrappers.extract(read_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = zdict.score(docs, zdict.train(docs, labels, ~held_out("doc_id", 0)))
    return out.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", "predicted", "gain")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, within 8 % edits."""
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by batched merge rounds."""
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, its documents of one
    language are a repository."""
    return secret_scan.report(read_table(spark, sf_dir, "documents"), owner_col="source", repo_col="lang")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether its language's threshold keeps it."""
    return kneser_ney.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found of every vector whose id 20 divides."""
    return lsh.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; rows whose id's crc32 7
    divides are checked with a changed ``n_chars``."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = merkle.document_manifest(read_table(spark, sf_dir, "documents"), changed)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    convs = saved(prefix_trie.conversations(read_table(spark, sf_dir, "conversations")), "conversations")
    rebuilt = prefix_trie.rebuilt(convs, lambda c: c - c % 20, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    return prefix_trie.trie(prefix_trie.paths(rebuilt))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_html_wrappers": op3_html_wrappers,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_nearest": op10_nearest,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}
