"""Tables and report lines: pivots of mixed rows, templates, appended tables, ordered lists.

Null keys are no keys; of several rows of a key the last in ``order`` counts, of
ties there the one with the greatest value.  Empty inputs give empty results,
but for ``report``, which always has its lines.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import number_rows


def has_keys(rows: DataFrame, names: Sequence[str]) -> bool:
    """Whether a table has all columns ``names``: the key test of a record, once for the whole table."""
    return set(names) <= set(rows.columns)


def item_map(rows: DataFrame, order: str) -> DataFrame:
    """(key, value): ``value`` by ``item``, or the whole row as JSON by ``model``; the last row wins.

    A table with neither pair of columns has no keys.
    """
    if has_keys(rows, ["item", "value"]):
        key, value = F.col("item"), F.col("value").cast("string")
    elif has_keys(rows, ["model"]):
        key, value = F.col("model"), F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != order]))
    else:
        return rows.limit(0).select(F.lit("").alias("key"), F.lit("").alias("value"))
    known = rows.select(key.alias("key"), value.alias("value"), F.col(order).alias("place")).where("key IS NOT NULL")
    return known.groupBy("key").agg(F.max(F.struct("place", "value")).alias("last")).select("key", "last.value")


def fill_template(keyed: DataFrame, template: str, keys: Mapping[str, str], key: str = "key", value: str = "value") -> DataFrame:
    """One row ``text``: ``template`` with ``{name}`` replaced by the value of ``keys[name]``; a missing key is an error.

    The template is cut once, so that braces in a value stay.  A null value is
    empty; names that ``keys`` does not have stay as they are.
    """
    asked = list(dict.fromkeys(keys.values()))
    number = {k: i for i, k in enumerate(asked)}
    hits = [F.max(F.when(F.col(key) == k, F.struct(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v")))).alias(f"k{i}") for i, k in enumerate(asked)]
    found = keyed.where(F.col(key).isin(asked)).agg(*hits, F.lit(0).alias("one"))
    parts = []
    for piece in re.split(r"(\{[^{}]*\})", template):
        name = piece[1:-1] if piece.startswith("{") else None
        if name in keys:
            hit = F.col(f"k{number[keys[name]]}")
            parts.append(F.when(hit.isNotNull(), hit["v"]).otherwise(F.raise_error(F.lit(f"no such key: {keys[name]}")).cast("string")))
        else:
            parts.append(F.lit(piece))
    return found.select(F.concat(*parts).alias("text"))


def table_rows(header: Sequence[str], body: DataFrame, order: str) -> DataFrame:
    """(row, col, text): a header as row 0 and then the rows of ``body`` in ``order``, null first.

    ``body`` has an array ``cells``; one with more cells than the header is an
    error, one with fewer, or null, leaves the rest blank.  Rows are numbered by
    ranges that are written once; cells are not gathered.
    """
    spark, n = body.sparkSession, len(header)
    numbered = number_rows(body.select(F.col(order).alias("place"), "cells"), ["place"], name="before").select((F.col("before") + 1).alias("row"), "cells")
    ragged = F.raise_error(F.lit(f"a row has more than {n} cells")).cast("array<string>")
    whole = F.when(F.size("cells") > n, ragged).otherwise(F.expr(f"transform(sequence(0, {n - 1}), i -> coalesce(get(cells, i), ''))"))
    cells = numbered.select("row", F.posexplode(whole).alias("col", "text"))
    top = spark.createDataFrame([(0, i, h) for i, h in enumerate(header)], "row long, col int, text string")
    return top.unionByName(cells)


def listed(rows: DataFrame, value: str, order: str, key: str | None = None, most: int = 10_000) -> DataFrame:
    """``values``: the values of each key, or of all rows, as a list in order.

    A list is one row, so that it has a stated bound: more than ``most`` values
    are an error, not a cut.
    """
    grouped = rows.groupBy(*([key] if key else []))
    sizes = F.count(value)
    made = F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))), lambda x: x["v"])
    return grouped.agg(F.when(sizes > most, F.raise_error(F.lit(f"more than {most} values")).cast("array<string>")).otherwise(made).alias("values"))


def report(paragraphs: DataFrame, terms: Sequence[str], keys: Sequence[str], prefixes: Sequence[str], cells: DataFrame | None = None) -> DataFrame:
    """(section, ord, name, n): paragraph count, how often keys occur, missing terms, headings, and tables.

    ``cells`` are table cells (doc_id, table_idx, ...); if given, their tables are
    counted and their texts are searched for the terms, but not for the keys.
    """
    from ..functions import count_inside, is_heading

    text = F.col("text")
    heads = F.coalesce(is_heading(F.lit(None).cast("string"), text, prefixes), F.lit(False))
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(heads.cast("long")), F.lit(0)).alias("heads")]
    sums += [F.coalesce(F.sum(count_inside(text, k)), F.lit(0)).alias(f"k{i}") for i, k in enumerate(keys)]
    sums += [F.coalesce(F.max(F.contains(text, F.lit(t)).cast("long")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)]
    lines = [("paragraphs", 0, "", F.col("n")), ("headings", 0, "", F.col("heads"))]
    lines += [("keyword", i, k, F.col(f"k{i}")) for i, k in enumerate(keys)] + [("found", i, t, F.col(f"t{i}")) for i, t in enumerate(terms)]
    made = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("ord"), F.lit(name).alias("name"), n.cast("long").alias("n")) for s, i, name, n in lines])
    out = paragraphs.agg(*sums).select(F.explode(made).alias("x")).select("x.*")
    if cells is None:
        return out
    inside = [F.coalesce(F.max(F.contains(text, F.lit(t)).cast("long")), F.lit(0)) for t in terms]
    seen = F.array(*[F.struct(F.lit("found").alias("section"), F.lit(i).alias("ord"), F.lit(t).alias("name"), n.alias("n")) for i, (t, n) in enumerate(zip(terms, inside, strict=True))])
    more = [cells.select("doc_id", "table_idx").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("tables").alias("section"), F.lit(0).alias("ord"), F.lit("").alias("name"), "n")]
    if terms:
        more.append(cells.agg(seen.alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    for part in more:
        out = out.unionByName(part)
    return out.groupBy("section", "ord", "name").agg(F.max("n").alias("n"))
