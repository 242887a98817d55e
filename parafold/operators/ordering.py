"""Row numbers, neighbours and carried values of ordered rows, without a window over a whole key.

A key may hold any share of the rows.  Rows are range-partitioned on key and
order and written once; numbers are places within a partition plus what earlier
partitions hold, and neighbours and carried values are windows over blocks of
numbered rows.  The driver gets a few values of each partition, never of a key.

Defined results.  A null key is a key of its own, nulls of an order come first,
and rows that tie are numbered in an order that is fixed once it is written.  An
empty table gives an empty result.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Numbered rows of one block.
BLOCK = 4096
_NTH = (1 << 33) - 1


def _new(rows: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {name} already")


def key_struct(key: str | Sequence[str] | None) -> Column:
    """The key as one struct, whose null fields are equal; without a key, one value for all rows."""
    names = [key] if isinstance(key, str) else list(key or ())
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)]) if names else F.struct(F.lit(0).alias("k0"))


def number_rows(rows: DataFrame, order: Sequence[str | Column], key: str | Sequence[str] | None = None, name: str = "number", descending: bool = False) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in ``order`` within each key, or within the whole table; ``descending`` turns the order round."""
    _new(rows, name)
    spark, work = rows.sparkSession, Scratch(rows.sparkSession, "numbers")
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.select(F.struct("*").alias("row"), key_struct(key).alias("key"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(sort)]).alias("place"))
    places = [F.col(f"place.o{i}") for i in range(len(sort))]
    by = [F.col(f"key.k{i}") for i in range(len(ranged.schema["key"].dataType))] + [p.desc() if descending else p for p in places]
    ranged = ranged.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_NTH))
    # Partitions and places are read from this one table, so that they belong together.
    ranged = work.save(ranged.select("row", "key", F.spark_partition_id().alias("part"), at.alias("nth")), "ranged")
    runs = ranged.groupBy("part", "key").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("shown", F.to_json(F.struct("key")))
    edge = F.struct("shown", "n")
    parts = runs.groupBy("part").agg(F.min_by(edge, "first").alias("head"), F.max_by(edge, "first").alias("tail"), F.count(F.lit(1)).alias("runs")).collect()
    before, offsets, last = 0, [], None
    for p in sorted(parts, key=lambda p: p["part"]):
        offset = before if p["head"]["shown"] == last else 0
        offsets.append((p["part"], offset))
        last, before = p["tail"]["shown"], p["tail"]["n"] + (offset if p["runs"] == 1 else 0)
    table = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))  # a row for each partition
    if not key:
        return ranged.join(table, "part").select("row.*", (F.col("nth") + F.col("offset")).alias(name))
    own = ranged.withColumn("local", F.row_number().over(W.partitionBy("part", "key").orderBy("nth")) - 1)
    # Only the first run of a partition can go on from the one before.
    number = F.col("local") + F.when(F.col("nth") == F.col("local"), F.col("offset")).otherwise(0)
    return own.join(table, "part").select("row.*", number.cast("long").alias(name))


def blocks_with_halo(rows: DataFrame, number: str, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """(row, block, own): every numbered row in its block, and copies in the blocks whose rows look so far back or ahead.

    A window over a block finds the ``before`` rows before and the ``after`` rows
    after each of its own rows there.
    """
    if max(before, after) < 0 or block < 1:
        raise ValueError("a halo has no negative side, a block at least one row")
    i = F.col(number)
    first = F.greatest(F.lit(0), F.floor((i - after) / block)).cast("long")
    spread = F.explode(F.sequence(first, F.floor((i + before) / block).cast("long")))
    return rows.select(F.struct("*").alias("row"), spread.alias("block")).withColumn("own", F.floor(F.col(f"row.{number}") / block) == F.col("block"))


def with_lag(rows: DataFrame, number: str, columns: Sequence[str], key: str | Sequence[str] | None = None, block: int = BLOCK, prefix: str = "before_") -> DataFrame:
    """``rows`` with ``before_<column>``: the values of the row numbered one less in the key; null at the first."""
    for c in columns:
        _new(rows, prefix + c)
    near = blocks_with_halo(rows, number, before=1, block=block)
    names = [key] if isinstance(key, str) else list(key or ())
    w = W.partitionBy(*[F.col(f"row.{c}") for c in names], "block").orderBy(f"row.{number}")
    lagged = [F.lag(F.col(f"row.{c}")).over(w).alias(prefix + c) for c in columns]
    return near.select("row", "own", *lagged).where("own").select("row.*", *[prefix + c for c in columns])


def carry_last(rows: DataFrame, number: str, value: Column, key: str | Sequence[str] | None = None, name: str = "carried", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null at or before each row of its key.

    Blocks take over the last value before them, which is carried over blocks of
    blocks the same way, so that no task has more than ``block`` rows of a key at
    once.
    """
    _new(rows, name)
    if block < 2:
        raise ValueError("a block has at least two rows")
    work = Scratch(rows.sparkSession, "carried")
    own = work.save(rows.select(F.struct("*").alias("row"), key_struct(key).alias("g"), F.col(number).cast("long").alias("i"), value.alias("v")), "rows")
    top = own.agg(F.max("i")).first()[0]
    return _carry(own, top or 0, block, work, 0).select("row.*", F.col("last").alias(name))


def _carry(own: DataFrame, top: int, block: int, work: Scratch, level: int) -> DataFrame:
    """``own`` (g, i, v, ...) with ``last``."""
    own = own.withColumn("b", F.floor(F.col("i") / block))
    w = W.partitionBy("g", "b").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    inner = own.withColumn("last", F.last("v", ignorenulls=True).over(w))
    if top < block:
        return inner.drop("b")
    ends = own.where(F.col("v").isNotNull()).groupBy("g", "b").agg(F.max_by("v", "i").alias("v"))
    # Every block has a row here, so that a block without a value hands on the one before.
    all_ends = own.select("g", "b").distinct().join(ends, ["g", "b"], "left").select("g", F.col("b").alias("i"), "v")
    all_ends = work.save(all_ends, f"ends_{level}")
    carried = _carry(all_ends, top // block, block, work, level + 1).select("g", (F.col("i") + 1).alias("b"), F.col("last").alias("earlier"))
    return inner.join(carried, ["g", "b"], "left").withColumn("last", F.coalesce("last", "earlier")).drop("b", "earlier")
