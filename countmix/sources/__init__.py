"""Data sources: parquet / any ``spark.read`` format."""

from .tables import read_documents, read_table

__all__ = ["read_documents", "read_table"]
