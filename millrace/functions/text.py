"""Text columns: tokens, words, sentences.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def words(text: Column) -> Column:
    """Parts between white space, none empty."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim removes only blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Split behind . ! ? where white space follows; stripped, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def estimated_tokens(text: Column) -> Column:
    """1.3 tokens per word, rounded down."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("bigint")
