"""Column expressions for text normalisation (JVM-side regex, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normalisation order of the corpus preparation step:
# lower-case, strip digits, strip punctuation, collapse whitespace.
# What is stripped goes in one pass over the text.
DROPPED = r"[\p{N}\p{P}\p{S}]+"
WHITESPACE = r"[\t\n\x0B\f\r ]+"
# Shortest term kept by the document-term matrix builder (word lengths 3..inf).
MIN_TERM_LENGTH = 3


def normalise_text(col: Column | str) -> Column:
    """lower -> drop digits -> drop punctuation/symbols -> single spaces, trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(c)
    c = F.regexp_replace(c, DROPPED, "")
    c = F.regexp_replace(c, WHITESPACE, " ")
    return F.trim(c)


def split_terms(col: Column | str) -> Column:
    """Split normalised text on spaces into an array (repeats kept)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split(c, " ")


def normalise_text_sql(x: str) -> str:
    """The same normalisation as DuckDB SQL (RE2 has the same classes)."""
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), "
            f"'\\p{{N}}+', '', 'g'), '[\\p{{P}}\\p{{S}}]+', '', 'g'), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'))")
