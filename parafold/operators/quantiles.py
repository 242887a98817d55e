"""Exact quantiles of any number of keys, by passes that narrow a range of values.

Each pass counts the values of a range in ``BUCKETS`` parts, which are summed
before they are shuffled, and goes on with the part that the wanted rank is in,
between the least and the greatest value there.  A range of one value, or of a
few rows, ends it.  No buffer holds the values of a key, and what is shuffled
for a key are counts.

Defined results.  Values that are null, NaN or infinite take no part; a key
without others has null quantiles.  A null key is a key of its own.  Quantiles
between two ranks lie on the line between them, as in ``percentile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordering import key_struct

#: Parts of a range in one pass, rows that are sorted at last, and ranks that are broadcast at most.
BUCKETS, FEW, SMALL_TABLE = 1024, 4096, 100_000


def ranked_values(values: DataFrame, wanted: DataFrame, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(g, rank, value): the value of each rank (from 0) of ``wanted`` (g, rank, n, low, high) among ``values`` (g, v)."""
    spark, work = values.sparkSession, Scratch(values.sparkSession, "quantiles")
    state = work.save(wanted.select("g", "rank", F.col("rank").alias("left"), "n", "low", "high"), "wanted")
    done, step = [], 0

    def beside(part: DataFrame, n: int) -> DataFrame:
        """Values within the range of each rank; the ranks are broadcast if they are few."""
        ranges = F.broadcast(part) if n <= SMALL_TABLE else part
        return values.join(ranges, "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    while True:
        done.append(state.where("low = high").select("g", "rank", F.col("low").alias("value")))
        last = state.where((F.col("low") < F.col("high")) & (F.col("n") <= few))
        open_ = state.where((F.col("low") < F.col("high")) & (F.col("n") > few))
        counts = state.agg(F.count_if((F.col("low") < F.col("high")) & (F.col("n") <= few)).alias("last"), F.count_if((F.col("low") < F.col("high")) & (F.col("n") > few)).alias("open")).first()
        if counts["last"]:
            # At most ``few`` values of a rank.
            sorted_ = beside(last, counts["last"]).groupBy("g", "rank").agg(F.max("left").alias("left"), F.sort_array(F.collect_list("v")).alias("all"))
            done.append(work.save(sorted_.select("g", "rank", F.get("all", F.col("left").cast("int")).alias("value")), f"last_{step}"))
        if not counts["open"]:
            break
        # Halves, so that a range as wide as all doubles does not overflow.
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counted = beside(open_, counts["open"]).groupBy("g", "rank", bucket.alias("bucket")).agg(F.max("left").alias("left"), F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        below = F.coalesce(F.sum("m").over(W.partitionBy("g", "rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("below", below).where((F.col("below") <= F.col("left")) & (F.col("left") < F.col("below") + F.col("m")))
        step += 1
        state = work.save(found.select("g", "rank", (F.col("left") - F.col("below")).alias("left"), F.col("m").alias("n"), "low", "high"), f"pass_{step}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_quantiles(rows: DataFrame, key: str | Sequence[str] | None, value: str, shares: Sequence[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(key columns, n, q0, q1, ...): the quantile of each share of ``shares`` for each key."""
    if any(not 0 <= p <= 1 for p in shares):
        raise ValueError("a share of a quantile is from 0 to 1")
    names = [key] if isinstance(key, str) else list(key or ())
    v = F.col(value).cast("double")
    finite = F.abs(v) < F.lit(float("inf"))
    values = rows.select(key_struct(key).alias("g"), F.when(finite, v).alias("v"))
    seen = Scratch(rows.sparkSession, "quantiles").save(values.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "keys")
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(shares)])).alias("p")
    asked = seen.where("n > 0").select("g", "n", "low", "high", place).select("g", "n", "low", "high", "p.i", "p.at", F.floor("p.at").alias("under"), F.ceil("p.at").alias("over"))
    wanted = asked.select("g", "n", "low", "high", F.explode(F.array("under", "over")).alias("rank")).distinct()
    found = ranked_values(values.where("v IS NOT NULL"), wanted, few, buckets)
    low, high = (found.select("g", F.col("rank").alias(c), F.col("value").alias(f"{c}_value")) for c in ("under", "over"))
    both = asked.join(low, ["g", "under"]).join(high, ["g", "over"])
    line = F.col("under_value") + (F.col("over_value") - F.col("under_value")) * (F.col("at") - F.col("under"))
    quantiles = both.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, line)).alias(f"q{i}") for i in range(len(shares))])
    return seen.join(quantiles, "g", "left").select(*[F.col(f"g.k{i}").alias(c) for i, c in enumerate(names)], "n", *[f"q{i}" for i in range(len(shares))])
