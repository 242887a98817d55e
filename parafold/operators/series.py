"""Series computations: rows of a key in an order, as windows over blocks and aggregates.

Defined results.  A null key is a key of its own where rows are numbered, and has
a row of its own in aggregates.  Null readings take no part in means and counts;
rows that tie in order are numbered in an order fixed once it is written.  Empty
tables give empty results, or one row of nulls where the result is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordering import key_struct, number_rows, with_lag
from .quantiles import exact_quantiles
from .segments import align_last, interpolate  # noqa: F401  (part of this module's interface)


def _numbered(rows: DataFrame, key: str, order: Sequence[str], **more: Column) -> DataFrame:
    """(row, g, i, ...): the row as a struct, its key, its place in the key, and more columns of it."""
    own = rows.select(F.struct("*").alias("row"), key_struct(key).alias("g"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], *[v.alias(c) for c, v in more.items()])
    names = [f"o{n}" for n in range(len(order))]
    return number_rows(own, names, "g", "i").drop(*names)


def allan_deviation(rows: DataFrame, sizes: Sequence[int], rate: float = 1.0, key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), value: str = "value") -> DataFrame:
    """(key, m, tau, adev) from means of full blocks of m rows; null below two blocks.

    A block with a null reading is not full, and neither it nor the block after it
    has a difference.
    """
    blocks = _numbered(rows, key, order, v=F.col(value)).select("g", "i", "v", F.explode(F.array(*[F.lit(m) for m in sizes])).alias("m"))
    means = blocks.groupBy("g", "m", F.expr("i div m").alias("b")).agg(F.avg("v").alias("mean"), F.count("v").alias("n")).where("n = m")
    d = F.when(F.col("before_b") == F.col("b") - 1, F.col("mean") - F.col("before_mean"))
    lagged = with_lag(means, "b", ["b", "mean"], ["g", "m"]).withColumn("d", d)
    return lagged.groupBy("g", "m").agg(F.sqrt(F.avg(F.col("d") * F.col("d")) * 0.5).alias("adev")).select(F.col("g.k0").alias(key), "m", (F.col("m") / rate).alias("tau"), "adev")


def allan_minimum(curve: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, tau, adev) where the curve is lowest."""
    known = curve.where("adev IS NOT NULL")
    return known.groupBy(key).agg(F.min(F.struct("adev", "tau")).alias("x")).select(key, "x.tau", "x.adev")


def mad_gate(rows: DataFrame, key: str, value: str, factor: float = 3.5, share: float = 0.08) -> DataFrame:
    """Rows with ``inlier``: within max(factor * MAD, share * median) of the median of their key.

    Medians are exact, by passes of counts.  Rows of a null key, or with a value
    that is null or not finite, have a null inlier.
    """
    own = rows.select(F.struct("*").alias("row"), F.col(key).alias("g"), F.col(value).cast("double").alias("v"))
    known = own.where(F.col("g").isNotNull())
    middle = exact_quantiles(known, "g", "v", [0.5]).select("g", F.col("q0").alias("median"))
    middle = Scratch(rows.sparkSession, "medians").save(middle, "middle")
    spread = exact_quantiles(known.join(middle, "g").select("g", F.abs(F.col("v") - F.col("median")).alias("d")), "g", "d", [0.5]).select("g", F.col("q0").alias("mad"))
    gate = F.greatest(F.lit(factor) * F.col("mad"), F.lit(share) * F.col("median"))
    finite = F.when(F.abs("v") < F.lit(float("inf")), F.col("v"))
    return own.join(middle.join(spread, "g"), "g", "left").select("row.*", (F.abs(finite - F.col("median")) <= gate).alias("inlier"))


def gated_mean(rows: DataFrame, key: str, value: str, factor: float = 3.5, share: float = 0.08) -> DataFrame:
    """(key, n, mean): the mean fitted again to the inliers of ``mad_gate``."""
    return mad_gate(rows, key, value, factor, share).where("inlier").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def six_pose_fit(means: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """One row m_<axis>_<pose axis> and b_<axis> from mean vectors of the poses +x -x +y -y +z -z."""
    def of(axis: str, pose: str) -> Column:
        return F.max(F.when(F.col("pose") == pose, F.col(axis)))

    gains = [((of(a, f"+{p}") - of(a, f"-{p}")) / 2).alias(f"m_{a}_{p}") for a in axes for p in axes]
    return means.agg(*gains, *[F.avg(a).alias(f"b_{a}") for a in axes])


def barometric_altitude(pressure: Column, base: Column) -> Column:
    return 44330.0 * (1 - F.pow(pressure / base, F.lit(0.190294957)))


def scaled(raw: Column, per_unit: float, bias: Column | float = 0.0) -> Column:
    """Raw counts in units, without the bias."""
    return raw / per_unit - bias


def complementary_filter(rows: DataFrame, alpha: float = 0.98, block: int = 256, key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), rate: str = "rate", measured: str = "measured", step: str = "dt") -> DataFrame:
    """``rows`` with ``angle``: alpha * (angle before + rate * dt) + (1 - alpha) * measured; it begins as measured.

    ``alpha`` is from 0 to 1.  The recurrence is linear, so the angle is a
    weighted sum of what the rows add.  It is summed within blocks of rows, which
    are so short that no weight leaves the range of a double; a block takes over
    the end of the one before, which is carried the same way over blocks of
    blocks, until one block is left or a weight is below 1e-100.  A null reading
    makes all later angles null.
    """
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha {alpha} is not between 0 and 1")
    n = _numbered(rows, key, order).select(F.col("row").alias("_row"), F.col("g").alias("_g"), F.col("i").alias("_i"))
    get = lambda c: F.col("_row").getField(c)
    add = F.when(F.col("_i") == 0, get(measured)).otherwise(alpha * get(rate) * get(step) + (1 - alpha) * get(measured))
    if alpha == 0:
        return n.select("_row.*", add.alias("angle"))
    done = _discounted_sums(Scratch(rows.sparkSession, "complementary").save(n.withColumn("_x", add), "added"), alpha, block)
    return done.select("_row.*", F.col("_sum").alias("angle"))


def _discounted_sums(n: DataFrame, alpha: float, block: int) -> DataFrame:
    """``n`` with ``_sum``: of ``_x`` up to row ``_i`` of its group ``_g``, each times alpha for each row that follows."""
    if alpha < 1:  # weights within a block are above 1e-100
        block = max(2, min(block, int(-230 / math.log(alpha))))
    n = n.withColumn("_b", F.expr(f"_i div {block}")).withColumn("_k", F.col("_i") % block)
    inner = W.partitionBy("_g", "_b").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    weight = lambda k: F.pow(F.lit(alpha), k)
    # One null makes the sums that follow null.
    clean = F.count(F.when(F.col("_x").isNull(), 1)).over(inner) == 0
    n = n.withColumn("_own", F.when(clean, F.sum(F.col("_x") * weight(-F.col("_k"))).over(inner) * weight(F.col("_k"))))
    ends = n.groupBy("_g", "_b").agg(F.max_by("_own", "_k").alias("_x"), F.max("_k").alias("_last"))
    if ends.select(F.max("_b")).first()[0] in (None, 0):
        return n.withColumnRenamed("_own", "_sum").drop("_b", "_k", "_x")
    # Blocks but for the last of a group are full, so that ends are ``block`` rows apart.
    whole = alpha**block
    ends = ends.where(F.col("_last") == block - 1).select("_g", F.col("_b").alias("_i"), "_x")
    carried = (_discounted_sums(ends, whole, block) if whole >= 1e-100 else ends.withColumn("_sum", F.col("_x"))).select(F.col("_g").alias("_to"), (F.col("_i") + 1).alias("_at"), F.col("_sum").alias("_c"))
    joined = n.join(carried, F.col("_g").eqNullSafe(F.col("_to")) & (F.col("_b") == F.col("_at")), "left")
    total = F.when(F.col("_b") == 0, F.col("_own")).otherwise(F.col("_own") + weight(F.col("_k") + 1) * F.col("_c"))
    return joined.withColumn("_sum", total).drop("_to", "_at", "_c", "_own", "_b", "_k", "_x")


def segment_ratio(rows: DataFrame, segment: str, over: str, under: str, value: str = "value") -> DataFrame:
    """Standard deviation of one segment divided by that of another; null without rows of either, or if the other does not vary."""
    return rows.agg((F.stddev_pop(F.when(F.col(segment) == over, F.col(value))) / F.nullif(F.stddev_pop(F.when(F.col(segment) == under, F.col(value))), F.lit(0.0))).alias("ratio"))


def mean_vector_shift(rows: DataFrame, switch: str, axes: Sequence[str]) -> DataFrame:
    """d<axis>, their norm and its share of the field without the switch, in percent; rows with a null switch take no part."""
    off = {a: F.avg(F.when(~F.col(switch), F.col(a))) for a in axes}
    shift = {a: F.avg(F.when(F.col(switch), F.col(a))) - off[a] for a in axes}
    norm = F.sqrt(sum((shift[a] * shift[a] for a in axes), F.lit(0.0)))
    field = F.sqrt(sum((off[a] * off[a] for a in axes), F.lit(0.0)))
    return rows.agg(*[shift[a].alias(f"d{a}") for a in axes], norm.alias("vector_shift"), (100 * norm / F.nullif(field, F.lit(0.0))).alias("percent_of_field"))


def capture_summary(rows: DataFrame, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Rows, seconds, rows a second, mean and standard deviation of each key; no rate where all rows are at one time."""
    seconds = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), seconds.alias("seconds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumn("hz", F.when(F.col("seconds") > 0, (F.col("n_rows") - 1) / F.col("seconds")))


def without_mean(rows: DataFrame, key: str, value: str, name: str = "unbiased") -> DataFrame:
    """``rows`` with ``unbiased``: the value less the mean of its key, by a join with the means; null keys have a mean too."""
    own = rows.select(F.struct("*").alias("row"), key_struct(key).alias("g"), F.col(value).cast("double").alias("v"))
    return own.join(own.groupBy("g").agg(F.avg("v").alias("mean")), "g").select("row.*", (F.col("v") - F.col("mean")).alias(name))


def track_length(rows: DataFrame, key: str, order: Sequence[str], x: str, y: str) -> DataFrame:
    """(key, length): sum of the distances between rows that follow each other; one with a null place adds nothing."""
    placed = _numbered(rows, key, order, x=F.col(x), y=F.col(y)).select("g", "i", "x", "y")
    lagged = with_lag(placed, "i", ["x", "y"], "g")
    d = F.sqrt(F.pow(F.col("x") - F.col("before_x"), 2) + F.pow(F.col("y") - F.col("before_y"), 2))
    return lagged.groupBy("g").agg(F.coalesce(F.sum(d), F.lit(0.0)).alias("length")).select(F.col("g.k0").alias(key), "length")


def sliding_windows(rows: DataFrame, size: int = 64, stride: int = 4, key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), value: str = "value") -> DataFrame:
    """(key, window, begins, values): full windows of ``size`` rows, every ``stride`` rows; nulls stay in their places.

    Each row is dealt to the windows it is in, so that lists are made for these
    alone and no task needs a whole key.
    """
    placed = _numbered(rows, key, order, v=F.col(value)).select("g", "i", "v")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (size - 1)) / stride)).cast("long")
    last = F.floor(F.col("i") / stride).cast("long")
    dealt = placed.where(first <= last).select("g", "i", "v", F.explode(F.sequence(first, last)).alias("window"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    windows = dealt.groupBy("g", "window").agg(lists.alias("values")).where(F.size("values") == size)
    return windows.select(F.col("g.k0").alias(key), "window", (F.col("window") * stride).alias("begins"), "values")
