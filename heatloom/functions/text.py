"""Column expressions over text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the English news tokeniser.
NEWS_STOPWORDS = [
    "the", "a", "an", "of", "or", "in", "for", "by", "on", "but", "is", "not", "with", "as",
    "was", "if", "they", "are", "this", "and", "it", "have", "from", "at", "my", "be", "that",
    "to",
]

# Patterns of the tokenisers and of the file-safe key.
ALL_DIGITS = "^[0-9]*$"
UNSAFE_KEY_CHARS = r"[^(a-zA-Z0-9一-龥)]"
EMPTY_KEY = "Null"


def ws_words(text: Column) -> Column:
    """Lower-cased words between white space, empty ones dropped."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def space_words(text: Column) -> Column:
    """Words between single blanks, case kept, empty ones dropped."""
    return F.array_remove(F.split(text, " "), "")


def is_numeric(term: Column) -> Column:
    return term.rlike(ALL_DIGITS)


def digit_free(term: Column) -> Column:
    return ~term.rlike("[0-9]")


def safe_key(key: Column) -> Column:
    """Key usable as a folder name: letters, digits, CJK and parentheses only."""
    stripped = F.regexp_replace(key, UNSAFE_KEY_CHARS, "")
    return F.when(stripped == "", EMPTY_KEY).otherwise(stripped)


def format_tokens(tokens: Column) -> Column:
    """Tokens as one blank-separated line; brackets, parentheses and blanks inside them go."""
    joined = F.array_join(tokens, ",")
    return F.translate(F.regexp_replace(joined, r"[\[\]() ]", ""), ",", " ")


def percent(value: Column, digits: int = 4) -> Column:
    """A share as a percentage with a fixed number of digits."""
    return F.concat(F.format_string(f"%.{digits}f", value * 100.0), F.lit("%"))
