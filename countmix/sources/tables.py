"""Readers.  Everything is ``spark.read``; columns are pruned at the scan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import dense_index


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """One parquet table of a data directory, projected to ``columns``."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet",
                   id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """Corpus source: one row per document, ``(doc_id BIGINT, text STRING, ...)``.

    ``fmt='text'`` reads one document per file (``wholetext``); its id is the
    rank of the file's path, so ids neither depend on partitioning nor collide.
    ``keep`` may name ``path`` and partition columns of the folder.
    """
    keep = list(keep or [])
    if fmt == "text":
        df = spark.read.text(path, wholetext=True)
        df = df.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"),
                       *[c for c in keep if c != "path"])
        ids = dense_index(df.select("path"), "path", "doc_id")
        return df.join(ids, "path").select("doc_id", "text", *keep)
    df = spark.read.format(fmt).load(path)
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"),
                     F.col(text_col).alias("text"), *keep)
