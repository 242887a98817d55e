"""Predicates and projections on text columns, all within code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column | str) -> Column:
    """Text without Unicode white space at either end; ``trim`` takes blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    """True if the text begins with one of the prefixes; without prefixes, false."""
    return reduce(lambda a, b: a | b, (F.startswith(text, F.lit(p)) for p in prefixes), F.lit(False))


def is_heading(style: Column, text: Column, prefixes: Sequence[str] = ()) -> Column:
    """A paragraph of a heading style, or one that begins like a heading; never a blank one."""
    plain = strip(text)
    return (plain != "") & (F.startswith(F.coalesce(style, F.lit("")), F.lit("Heading")) | starts_with_any(plain, prefixes))


def count_inside(text: Column, key: str) -> Column:
    """How often ``key`` occurs in the text, without regard to case and without overlaps."""
    low = F.lower(text)
    return F.when(F.lit(key) == "", 0).otherwise((F.length(low) - F.length(F.replace(low, F.lit(key.lower())))) / max(1, len(key.lower()))).cast("long")


def format_3dp(value: Column) -> Column:
    """A number with three decimals, any other text as it is.

    What is rounded is the exact value of the double, and an exact half goes to
    the even digit.  From 1e12 on Java's formatter is used.
    """
    number = value.try_cast("double")
    size = F.abs(number)
    # A double is split into two halves whose products with 1000 are exact.
    high = size * 134217729.0 - (size * 134217729.0 - size)
    one, two = high * 1000.0, (size - high) * 1000.0
    first, second = one - F.floor(one), two - F.floor(two)
    carried = F.when((first - 1.0) + second >= 0, 1).otherwise(0)
    whole = F.floor(one) + F.floor(two) + carried
    over = (first - 0.5 - carried) + second
    n = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(F.startswith(number.cast("string"), F.lit("-")), "-").otherwise("")
    exact = F.concat(sign, F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    shown = F.when(size < 1e12, exact).otherwise(F.format_string("%.3f", number))
    return F.when(number.isNotNull(), shown).otherwise(value)


def after_prefix(text: Column, prefix: str) -> Column:
    """What follows the prefix, or the whole text if it does not begin with it."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def lines_of(text: Column) -> Column:
    """The lines of a text without line feeds at its ends; any Unicode line boundary ends a line, and none is left empty at the end."""
    plain = F.regexp_replace(text, r"^\n+|\n+$", "")
    parts = F.split(plain, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    # A boundary at the end, or an empty text, has no line after it.
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
