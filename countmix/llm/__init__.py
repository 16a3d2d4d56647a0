"""Operators of a training-data pipeline (token files, language models, HTML
wrappers, filters, deduplication, nearest neighbours).

Every operator takes DataFrames and column names, so extra columns of the
input never clash with its own; null texts count as empty.
"""
