"""Registered queries (name -> Spark plan) and their DuckDB oracle SQL."""
