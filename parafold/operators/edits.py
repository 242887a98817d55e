"""Edits of ordered paragraphs: (key, idx, text) in, the same out.

Order is the column ``idx``.  Every edit is a projection, a filter, or a window
or aggregate by document, so that documents are spread over tasks.

Defined results.  A null text has no prefix and stays as it is; a blank one is
like any other.  A null key is a document of its own for edits that renumber or
delete, and has no match to replace or to insert after.  Of rows with the same
key and idx any may count as the first.  Empty tables give empty results.  Other
columns are kept, whatever their names; new rows have null in them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import starts_with_any, strip
from .ordering import key_struct


def rewrite_by_prefix(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace a text by that of the first rule whose prefix it has; rules are few and need no join."""
    plain, out = strip("text"), None
    for prefix, replacement in rules:
        test = F.startswith(plain, F.lit(prefix))
        out = F.when(test, F.lit(replacement)) if out is None else out.when(test, F.lit(replacement))
    return rows if out is None else rows.withColumn("text", out.otherwise(F.col("text")))


def drop_repeats(rows: DataFrame, key: str = "doc_id", least: int = 100, exempt: Sequence[str] = ()) -> DataFrame:
    """Keep the first of equal stripped texts of ``least`` characters or more in a document.

    Nulls, shorter texts and those with an exempt prefix stay and are not
    remembered.  Repeats meet by a hash of the text, in one aggregate.
    """
    plain = strip("text")
    free = F.coalesce((F.length(plain) < least) | starts_with_any(plain, exempt), F.lit(True))
    own = rows.select(F.struct("*").alias("row"), free.alias("free"), key_struct(key).alias("g"), F.col("idx").alias("at"), plain.alias("plain"))
    # The least row of a group, by place; an aggregate is combined before it is shuffled, a window is not.
    first = own.where(~F.col("free")).groupBy("g", "plain").agg(F.min_by("row", "at").alias("row"))
    return own.where("free").select("row.*").unionByName(first.select("row.*"))


def delete_range(rows: DataFrame, start: str, end: str, key: str = "doc_id") -> DataFrame:
    """Delete from the latest start marker before the first end marker that has one; the end stays.

    Without such a pair a document stays as it is.
    """
    plain = strip("text")
    before = W.partitionBy("g").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    own = rows.select(F.struct("*").alias("row"), key_struct(key).alias("g"), F.col("idx").alias("at"), F.startswith(plain, F.lit(start)).alias("s"), F.startswith(plain, F.lit(end)).alias("e"))
    opened = own.where("s OR e").select("g", "at", "e", F.max(F.when(F.col("s"), F.col("at"))).over(before).alias("from")).where("e AND from IS NOT NULL")
    ranges = opened.groupBy("g").agg(F.min(F.struct("at", "from")).alias("r"))
    inside = (F.col("at") >= F.col("r.from")) & (F.col("at") < F.col("r.at"))
    return own.join(ranges, "g", "left").where(F.col("r").isNull() | ~F.coalesce(inside, F.lit(False))).select("row.*")


def delete_by_prefix(rows: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Delete the paragraphs whose stripped text begins with one of ``prefixes``; without prefixes none."""
    return rows.where(~F.coalesce(starts_with_any(strip("text"), prefixes), F.lit(False)))


def first_match(rows: DataFrame, prefix: str, key: str = "doc_id", required: bool = False) -> DataFrame:
    """(key, first): the least idx with the prefix in each document; if ``required``, an error where there is none."""
    hit = F.min(F.when(F.startswith(strip("text"), F.lit(prefix)), F.col("idx")))
    found = rows.groupBy(key).agg(hit.alias("first"))
    if required:
        missing = F.raise_error(F.lit(f"no paragraph begins with {prefix!r}")).cast("int")
        return found.withColumn("first", F.coalesce("first", missing))
    return found.where("first IS NOT NULL")


def replace_first(rows: DataFrame, prefix: str, text: str, key: str = "doc_id") -> DataFrame:
    """Give the first paragraph with the prefix in each document another text; null keys and texts stay as they are."""
    own = rows.select(F.struct("*").alias("_row"), F.col(key).alias("_g"), F.col("idx").alias("_at"))
    joined = own.join(first_match(rows, prefix, key).select(F.col(key).alias("_g"), F.col("first").alias("_first")), "_g", "left")
    new = F.when(F.col("_at") == F.col("_first"), F.lit(text)).otherwise(F.col("_row").getField("text"))
    return joined.select(*[new.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in rows.columns])


def _items(items: Sequence[str]) -> Column:
    return F.posexplode(F.array(*[F.lit(x) for x in items]))


def insert_after(rows: DataFrame, prefix: str, items: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Put the items, in order, after the first match of each document and number anew.

    A document without a match is numbered anew only.
    """
    if not items:
        return rows
    own = rows.select(F.struct("*").alias("row"), F.col(key).alias("g"), F.col("idx").alias("at"), F.lit(-1).alias("sub"))
    new = first_match(rows, prefix, key).where(F.col(key).isNotNull()).select(F.col(key).alias("g"), F.col("first").alias("at"), _items(items).alias("sub", "new"))
    both = own.unionByName(new, allowMissingColumns=True)
    place = (F.row_number().over(W.partitionBy("g").orderBy("at", "sub")) - 1).cast(rows.schema["idx"].dataType)
    return both.withColumn("place", place).select(*[_filled(c, key) for c in rows.columns])


def _filled(column: str, key: str) -> Column:
    """A column of an old row, or what a new row has there."""
    old = F.col("row").getField(column)
    if column == "idx":
        return F.col("place").alias(column)
    return {"text": F.coalesce(F.col("new"), old), key: F.col("g")}.get(column, old).alias(column)


def append_rows(rows: DataFrame, items: Sequence[str], key: str = "doc_id", **values: Column) -> DataFrame:
    """Put the items at the end of each document; ``values`` are other columns of the new rows."""
    if not items:
        return rows
    last = rows.groupBy(F.col(key).alias("g")).agg(F.max("idx").alias("last"))
    new = last.select("g", "last", _items(items).alias("sub", "item"))
    place = (F.coalesce(F.col("last"), F.lit(-1)) + 1 + F.col("sub")).cast(rows.schema["idx"].dataType)
    return rows.unionByName(new.select(F.col("g").alias(key), place.alias("idx"), F.col("item").alias("text"), *[v.alias(c) for c, v in values.items()]), allowMissingColumns=True)


def runs_of(text: Column, bold_prefix: str | None = None) -> Column:
    """Runs (text, bold) of a paragraph: a bold prefix and the rest, if it begins with the prefix, else one plain run; null for null."""
    plain = F.struct(text.alias("text"), F.lit(False).alias("bold"))
    if not bold_prefix:
        return F.when(text.isNotNull(), F.array(plain))
    rest = F.substring(text, len(bold_prefix) + 1, 2**31 - 1)
    split = F.array(F.struct(F.lit(bold_prefix).alias("text"), F.lit(True).alias("bold")), F.struct(rest.alias("text"), F.lit(False).alias("bold")))
    return F.when(F.startswith(text, F.lit(bold_prefix)), split).when(text.isNotNull(), F.array(plain))


def append_paragraphs(rows: DataFrame, items: Sequence[str], style: str | None = None, bold_prefix: str | None = None, key: str = "doc_id") -> DataFrame:
    """Put paragraphs of a style at the end of each document, with ``runs`` of a bold prefix and the rest.

    ``rows`` may have ``style`` and ``runs``; a paragraph without runs has its text
    as one plain run.  A list of items with the style of a bullet is a list.
    """
    own = rows if "style" in rows.columns else rows.withColumn("style", F.lit(None).cast("string"))
    own = own.withColumn("runs", F.coalesce("runs", runs_of(F.col("text")))) if "runs" in own.columns else own.withColumn("runs", runs_of(F.col("text")))
    return append_rows(own, items, key, style=F.lit(style).cast("string"), runs=runs_of(F.col("item"), bold_prefix))
