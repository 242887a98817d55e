"""SQL pieces for whole texts that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates normalised words: ASCII that is neither letter nor digit.
BREAK = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The same but for the line feed, as a plain pattern.
BREAK_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_sql(text: str) -> str:
    """Lower-cased words of a text without signs; null has none."""
    return f"array_remove(split(lower(coalesce({text}, '')), '{BREAK}'), '')"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def row_key() -> Column:
    """128 bits that stand for a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))))
