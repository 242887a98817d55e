"""Counts of terms, keyed lookups and ordered concatenation.

Defined results.  A null text has no terms, and a null in a key is no key.  Of
rows that tie in order the one with the greatest values counts.  Without rows,
counts are 0, all terms are missing, and keyed tables are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_inside
from .ordering import BLOCK


def _stack(names: Sequence[str], values: Sequence[Column], name: str, value: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias(name), v.alias(value)) for i, (n, v) in enumerate(zip(names, values, strict=True))]))


def keyword_frequency(rows: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(ord, key, n): occurrences of each key, in one pass with partial sums."""
    sums = rows.agg(*[F.coalesce(F.sum(count_inside(F.col(text), k)), F.lit(0)).alias(f"k{i}") for i, k in enumerate(keys)])
    return sums.select(_stack(keys, [F.col(f"k{i}") for i in range(len(keys))], "key", "n").alias("x")).select("x.*")


def required_terms_missing(rows: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """(ord, term): the terms that no text contains, in one pass."""
    seen = rows.agg(*[F.coalesce(F.max(F.contains(F.col(text), F.lit(t))), F.lit(False)).alias(f"t{i}") for i, t in enumerate(terms)])
    return seen.select(_stack(terms, [F.col(f"t{i}") for i in range(len(terms))], "term", "seen").alias("x")).select("x.*").where("NOT seen").drop("seen")


def last_wins(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row for each key: the values of its last row, which is what a map filled in order holds."""
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    last = known.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.max(F.struct(F.col(order).alias("o"), F.struct(*values).alias("v"))).alias("last"))
    return last.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"last.v.{v}").alias(v) for v in values])


def lookup(keyed: DataFrame, key: dict[str, object], value: str) -> DataFrame:
    """The value of one key as a one-row table; an error if the key is missing."""
    test = F.lit(True)
    for k, v in key.items():
        test = test & (F.col(k) == F.lit(v))
    missing = F.raise_error(F.lit(f"no such key: {key}")).cast(keyed.schema[value].dataType)
    return keyed.where(test).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") > 0, F.col(value)).otherwise(missing).alias(value))


def ordered_concat(rows: DataFrame, key: str = "doc_id", separator: str = "\n", block: int = BLOCK) -> DataFrame:
    """(key, text): the texts of each document in order of idx; nulls are left out, of equal places the smaller text is first.

    Blocks of ``block`` places are joined first, so that lists of texts are
    bounded; what is joined at last is one string a block, and the result itself.
    """
    known = rows.where(F.col("text").isNotNull()).select(F.col(key).alias("g"), F.col("idx").alias("at"), "text")
    first = F.floor(F.col("at") / block).alias("b")
    lists = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda p: p[text]), separator)
    blocks = known.groupBy("g", first).agg(lists("at", "text").alias("part"))
    joined = blocks.groupBy("g").agg(lists("b", "part").alias("text"))
    return joined.select(F.col("g").alias(key), "text")
