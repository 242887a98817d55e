"""Alignment of series in time, and segments of rest, without a window over a whole key.

Times of different rows are compared by their order, so that times may be
numbers, dates or time stamps, but for ``align_nearest``, whose times are numbers.

Defined results.  A null key is a key of its own; a row with a null time stands
before all others.  Of right rows at one time that with the greatest values
counts.  Empty tables give empty or null results; other columns are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordering import BLOCK, blocks_with_halo, carry_last, key_struct, number_rows, with_lag


def _merged(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str]) -> DataFrame:
    """Rows of both tables: (row, g, t, side, v), the left ones without v, the right ones without row."""
    a = left.select(F.struct("*").alias("row"), key_struct(key).alias("g"), F.col(ts).alias("t"))
    b = right.select(key_struct(key).alias("g"), F.col(ts).alias("t"), F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("v"))
    b = b.groupBy("g", "t").agg(F.max("v").alias("v"))
    return a.withColumn("v", F.lit(None).cast(b.schema["v"].dataType)).withColumn("side", F.lit(1)).unionByName(b.withColumn("row", F.lit(None).cast(a.schema["row"].dataType)).withColumn("side", F.lit(0)))


def _taken(merged: DataFrame, late: bool, name: str, block: int) -> DataFrame:
    """``merged`` with the last (or, if ``late``, the next) right row's (t, v)."""
    # Of rows at one time the right one is first, whichever way they are numbered.
    numbers = number_rows(merged, ["t", -F.col("side") if late else F.col("side")], "g", f"{name}_number", late)
    return carry_last(numbers, f"{name}_number", F.when(F.col("side") == 0, F.struct("t", "v")), "g", name, block).drop(f"{name}_number")


def align_last(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``left`` with last_<value>: the values of the last row of ``right`` at or before its time.

    Both are merged and numbered in order of time; blocks of rows hand the last
    values on to later blocks.
    """
    done = _taken(_merged(left, right, key, ts, values), False, "last", block).where("side = 1")
    return done.select("row.*", *[F.col(f"last.v.v{i}").alias(f"last_{v}") for i, v in enumerate(values)])


def around(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(row, t, last, next): left rows with (t, v) of the right rows at or before and at or after their time."""
    merged = Scratch(left.sparkSession, "around").save(_merged(left, right, key, ts, values), "merged")
    return _taken(_taken(merged, False, "last", block), True, "next", block).where("side = 1").select("row", "t", "last", "next")


def align_nearest(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], most: float | None = None, block: int = BLOCK) -> DataFrame:
    """``left`` with nearest_<value>: the values of the row of ``right`` that is nearest in time, the earlier of two as near.

    Beyond ``most``, if it is given, they are null.
    """
    both = around(left, right, key, ts, values, block)
    before, after = F.col("t") - F.col("last.t"), F.col("next.t") - F.col("t")
    one = F.when(F.col("last").isNull() | (after < before), F.col("next")).otherwise(F.col("last"))
    if most is not None:
        one = F.when(F.coalesce(F.least(before, after) <= most, F.lit(False)), one)
    return both.withColumn("one", one).select("row.*", *[F.col(f"one.v.v{i}").alias(f"nearest_{v}") for i, v in enumerate(values)])


def interpolate(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, block: int = BLOCK) -> DataFrame:
    """``left`` with ``interpolated``: ``value`` of ``right`` at its time, on the line between the rows before and after.

    Times are numbers.  Outside the times of ``right``, or without a row of the
    key, it is null; null values of ``right`` are passed over.
    """
    known = right.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    both = around(left, known, key, ts, [value], block)
    low, high = F.col("last.v.v0"), F.col("next.v.v0")
    gap = F.col("next.t") - F.col("last.t")
    line = low + F.when(gap == 0, 0.0).otherwise((high - low) * (F.col("t") - F.col("last.t")) / gap)
    return both.select("row.*", line.alias("interpolated"))


def static_rows(rows: DataFrame, accel: Sequence[str], gyro: Sequence[str], width: int, spread: float, rate: float, key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), block: int = BLOCK) -> DataFrame:
    """``rows`` with ``number`` in their key and ``static``.

    A row is static if, over it and the ``width - 1`` rows before, the standard
    deviation of the length of ``accel`` is at most ``spread`` and the mean length
    of ``gyro`` at most ``rate``.  With fewer rows, or a null reading, it is not.
    """
    from pyspark.sql import Window as W

    size = lambda names: F.sqrt(sum((F.col(c).cast("double") * F.col(c) for c in names), F.lit(0.0)))
    own = rows.select(F.struct("*").alias("row"), key_struct(key).alias("g"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), size(accel).alias("a"), size(gyro).alias("w"))
    numbers = number_rows(own, [f"o.o{i}" for i in range(len(order))], "g", "number")
    near = blocks_with_halo(numbers, "number", before=width - 1, block=max(block, width)).select("row.*", "block", "own")
    w = W.partitionBy("g", "block").orderBy("number").rowsBetween(1 - width, 0)
    both = F.col("a").isNotNull() & F.col("w").isNotNull()
    calm = (F.count(F.when(both, 1)).over(w) == width) & (F.stddev_pop("a").over(w) <= spread) & (F.avg("w").over(w) <= rate)
    return near.withColumn("static", F.coalesce(calm, F.lit(False))).where("own").select("row.*", "number", "static")


def zero_velocity_segments(rows: DataFrame, accel: Sequence[str], gyro: Sequence[str], width: int, spread: float, rate: float, least: int = 1, key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), block: int = BLOCK) -> DataFrame:
    """(key, first, last, n): runs of ``least`` or more static rows, by numbers of rows; velocity is zero there.

    A run begins where the row before is not static; its number is handed on to
    the rows that follow.
    """
    work = Scratch(rows.sparkSession, "segments")
    marked = work.save(static_rows(rows, accel, gyro, width, spread, rate, key, order, block).select(F.col(key).alias("k"), "number", "static"), "static")
    lagged = with_lag(marked, "number", ["static"], "k", block)
    opens = F.when(F.col("static") & ~F.coalesce("before_static", F.lit(False)), F.col("number"))
    runs = carry_last(lagged, "number", opens, "k", "first", block).where("static")
    ends = runs.groupBy("k", "first").agg(F.max("number").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return ends.select(F.col("k").alias(key), "first", "last", "n")
