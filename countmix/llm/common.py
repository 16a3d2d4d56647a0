"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._util import drop_folder, release_shuffles, saved, scratch, ship, stored  # noqa: F401

#: Words are separated by exactly these characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def columns(df: DataFrame, **names: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in names.items()])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its scan has fewer splits than that (a small
    input); a larger input stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str | Column) -> DataFrame:
    """``doc_id, text`` (null: empty) and more columns, spread over the cores."""
    ship(df.sparkSession)
    return spread(columns(df, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")), **more))


def block_count(df: DataFrame, block_bytes: int, column: str = "text") -> int:
    """How many blocks of about ``block_bytes`` of text the rows make."""
    total = df.agg(F.sum(F.octet_length(column).cast("long") + 64)).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def held_out(id_col: str, remainder: int) -> Column:
    """True where crc32 of the decimal id, mod 5, is ``remainder`` (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == remainder, F.lit(False))
