"""Operators: text, count matrix, initialisation, topics, fit, selection, reports."""
