"""Column expressions and in-task numeric kernels."""

from .hashing import hash_uniform, hash_uniform_sql
from .special import digamma, digamma_sql, lgamma
from .text import normalise_text, normalise_text_sql, split_terms

__all__ = ["hash_uniform", "hash_uniform_sql", "digamma", "digamma_sql", "lgamma",
           "normalise_text", "normalise_text_sql", "split_terms"]
