"""Calibration, navigation and quality of sensor series, as projections and aggregates.

Null readings take no part in aggregates and give null results in projections.
Empty inputs give no rows, or one row of nulls where the result is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordering import key_struct
from .quantiles import exact_quantiles

#: Equatorial radius in metres and squared eccentricity of WGS 84.
RADIUS, ECCENTRICITY2 = 6378137.0, 6.69437999014e-3


def det3(m: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: Sequence[Sequence[Column]], right: Sequence[Column]) -> list[Column]:
    """Cramer's rule for three unknowns; null where the matrix is singular."""
    whole = det3(m)
    swapped = [[[right[r] if c == k else m[r][c] for c in range(3)] for r in range(3)] for k in range(3)]
    return [F.when(whole != 0, det3(s) / whole) for s in swapped]


def apply_inverse_fit(rows: DataFrame, fit: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """``rows`` with true_<axis> = inverse(M) (raw - b), from the one-row ``fit`` m_<axis>_<axis>, b_<axis>."""
    names = [*(f"m_{a}_{p}" for a in axes for p in axes), *(f"b_{a}" for a in axes)]
    one = fit.select(F.struct(*names).alias("fit__"))
    both = rows.select(F.struct("*").alias("row__")).crossJoin(F.broadcast(one))  # one row: the fit
    m = [[F.col(f"fit__.m_{a}_{p}") for p in axes] for a in axes]
    right = [F.col(f"row__.{a}") - F.col(f"fit__.b_{a}") for a in axes]
    return both.select("row__.*", *[x.alias(f"true_{a}") for a, x in zip(axes, solve3(m, right), strict=True)])


def iron_corrected(field: Sequence[Column], centre: Sequence[float], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """Readings less the centre (hard iron), times the matrix (soft iron)."""
    free = [f - c for f, c in zip(field, centre, strict=True)]
    return [sum((m * f for m, f in zip(row, free, strict=True)), F.lit(0.0)) for row in matrix]


def tilt_heading(accel: Sequence[Column], field: Sequence[Column]) -> Column:
    """Heading in degrees, 0 to 360: the field turned into the horizontal plane by roll and pitch."""
    ax, ay, az = accel
    mx, my, mz = field
    roll = F.atan2(ay, az)
    pitch = F.atan2(-ax, ay * F.sin(roll) + az * F.cos(roll))
    east = mz * F.sin(roll) - my * F.cos(roll)
    north = mx * F.cos(pitch) + my * F.sin(pitch) * F.sin(roll) + mz * F.sin(pitch) * F.cos(roll)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def _sentence(sentence: Column, kind: str) -> tuple[Column, Column]:
    """The comma-separated fields of a sentence, and whether it is of the kind with a right checksum."""
    body = F.regexp_extract(sentence, rf"^\$(..{kind},[^*]*)\*[0-9A-Fa-f]{{2}}\s*$", 1)
    given = F.conv(F.regexp_extract(sentence, r"\*([0-9A-Fa-f]{2})\s*$", 1), 16, 10).try_cast("int")
    codes = F.transform(F.split(body, ""), lambda c: F.ascii(c))
    return F.split(body, ","), (body != "") & (F.aggregate(codes, F.lit(0), lambda a, b: a.bitwiseXOR(b)) == given)


def _degrees(value: Column, side: Column, negative: str) -> Column:
    raw = value.try_cast("double")
    whole = F.floor(raw / 100)
    return (whole + (raw - whole * 100) / 60) * F.when(side == negative, -1.0).otherwise(1.0)


def parse_gga(sentence: Column) -> Column:
    """Struct of a GGA sentence: lat, lon (decimal degrees), quality, satellites, hdop, altitude.

    Another sentence, a wrong checksum or too few fields give null; an empty
    field is null.
    """
    f, good = _sentence(sentence, "GGA")
    parsed = F.struct(
        _degrees(F.get(f, F.lit(2)), F.get(f, F.lit(3)), "S").alias("lat"),
        _degrees(F.get(f, F.lit(4)), F.get(f, F.lit(5)), "W").alias("lon"),
        F.get(f, F.lit(6)).try_cast("int").alias("quality"),
        F.get(f, F.lit(7)).try_cast("int").alias("satellites"),
        F.get(f, F.lit(8)).try_cast("double").alias("hdop"),
        F.get(f, F.lit(9)).try_cast("double").alias("altitude"),
    )
    return F.when(good & (F.size(f) >= 10), parsed)


def parse_rmc(sentence: Column) -> Column:
    """Struct of an RMC sentence: valid, lat, lon (decimal degrees), speed (metres a second), course (degrees); else as ``parse_gga``."""
    f, good = _sentence(sentence, "RMC")
    parsed = F.struct(
        (F.get(f, F.lit(2)) == "A").alias("valid"),
        _degrees(F.get(f, F.lit(3)), F.get(f, F.lit(4)), "S").alias("lat"),
        _degrees(F.get(f, F.lit(5)), F.get(f, F.lit(6)), "W").alias("lon"),
        (F.get(f, F.lit(7)).try_cast("double") * (1852 / 3600)).alias("speed"),
        F.get(f, F.lit(8)).try_cast("double").alias("course"),
    )
    return F.when(good & (F.size(f) >= 9), parsed)


def usable_fix(quality: Column, satellites: Column, hdop: Column, least: int = 4, worst: float = 5.0) -> Column:
    """Whether a fix may be used: it has a quality, enough satellites and a small dilution; nulls may not."""
    return F.coalesce((quality > 0) & (satellites >= least) & (hdop <= worst), F.lit(False))


def gated_sigma(innovation: Column, hdop: Column, base: float, soft: float = 3.0, hard: float = 10.0) -> Column:
    """Standard deviation to use for a reading: ``base`` times its dilution, widened beyond the soft gate; null beyond the hard one.

    Gates are multiples of that deviation.  From the soft gate on the deviation is
    what puts the innovation on it.  A null, or a dilution that is not positive,
    gives null.
    """
    sigma = F.when(hdop > 0, hdop * base)
    size = F.abs(innovation)
    return F.when(size <= soft * sigma, sigma).when(size <= hard * sigma, size / soft)


def local_enu(rows: DataFrame, key: str, order: str, lat: str = "lat", lon: str = "lon", alt: str = "alt") -> DataFrame:
    """``rows`` with east, north, up in metres from the first valid fix of each key, on the local radii of the ellipsoid."""
    own = rows.select(F.struct("*").alias("row"), key_struct(key).alias("g"), F.struct(F.col(order).alias("o"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(alt).alias("alt")).alias("fix"))
    known = F.col("fix.lat").isNotNull() & F.col("fix.lon").isNotNull() & F.col("fix.alt").isNotNull()
    joined = own.join(own.where(known).groupBy("g").agg(F.min("fix").alias("origin")), "g", "left")
    at = F.radians(F.col("origin.lat"))
    w = 1 - ECCENTRICITY2 * F.pow(F.sin(at), 2)
    east = F.radians(F.col("fix.lon") - F.col("origin.lon")) * (RADIUS / F.sqrt(w) + F.col("origin.alt")) * F.cos(at)
    north = F.radians(F.col("fix.lat") - F.col("origin.lat")) * (RADIUS * (1 - ECCENTRICITY2) / F.pow(w, 1.5) + F.col("origin.alt"))
    return joined.select("row.*", east.alias("east"), north.alias("north"), (F.col("fix.alt") - F.col("origin.alt")).alias("up"))


def pressure_baseline(rows: DataFrame, key: str, order: str, value: str, first: int, how: str = "median") -> DataFrame:
    """(key, base): median or mean of the first ``first`` readings of each key, gathered with that bound."""
    if how not in ("median", "mean"):
        raise ValueError(f"{how} is neither median nor mean")
    from pyspark.sql import Window as W

    # A limit by row number is a partial top-k in Spark, so that no task sorts a whole key.
    ranked = rows.where(F.col(value).isNotNull()).withColumn("place__", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("place__") <= first)
    return ranked.groupBy(key).agg((F.median(value) if how == "median" else F.avg(value)).alias("base"))


def linear_fit(rows: DataFrame, x: str, y: str, key: str | None = None) -> DataFrame:
    """(key, slope, intercept) of y over x by least squares; null for fewer than two values of x."""
    return rows.groupBy(*([key] if key else [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def quadratic_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(c0, c1, c2) of y = c0 + c1 x + c2 x^2, by the normal equations of aggregated powers."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    powers = rows.where(known).agg(*[F.sum(F.pow(F.col(x), k)).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow(F.col(x), k) * F.col(y)).alias(f"t{k}") for k in range(3)])
    m = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    return powers.select(*[c.alias(f"c{k}") for k, c in enumerate(solve3(m, [F.col(f"t{k}") for k in range(3)]))])


def noise_metrics(rows: DataFrame, key: str, signal: str, truth: str) -> DataFrame:
    """(key, std, rmse, snr_db) of a signal against its truth; no ratio where there is no error or no truth."""
    error = F.col(signal) - F.col(truth)
    power = F.avg(F.col(truth) * F.col(truth)) / F.nullif(F.avg(error * error), F.lit(0.0))
    return rows.groupBy(key).agg(F.stddev_samp(signal).alias("std"), F.sqrt(F.avg(error * error)).alias("rmse"), (10 * F.log10(power)).alias("snr_db"))


def jitter(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, jitter): root mean square of the steps between rows that follow each other; null without two readings in a row."""
    from .ordering import number_rows, with_lag

    own = rows.select(key_struct(key).alias("g"), F.col(value).cast("double").alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    lagged = with_lag(number_rows(own, [f"o{i}" for i in range(len(order))], "g", "i").select("g", "i", "v"), "i", ["v"], "g")
    step = F.col("v") - F.col("before_v")
    return lagged.groupBy("g").agg(F.sqrt(F.avg(step * step)).alias("jitter")).select(F.col("g.k0").alias(key), "jitter")


def distance_law(near: Column | float, far: Column | float, power: int = 3) -> Column:
    """How much weaker a dipole is at ``far`` than at ``near``; null where ``near`` is zero."""
    one = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.pow(one(far) / F.nullif(one(near), F.lit(0.0)), F.lit(power))


def coverage(rows: DataFrame, axes: Sequence[str] = ("x", "y", "z"), around: int = 12, bands: int = 6) -> DataFrame:
    """One row: cells, occupied, score, least and most: how evenly directions cover the sphere.

    The sphere is cut into ``bands`` of equal height, and so of equal area, and
    each into ``around`` sectors of longitude.  The score is the share of cells
    that have a direction; least and most are of rows in any cell, empty ones too.
    Vectors of no length, or with a null, have no direction.
    """
    x, y, z = (F.col(a).cast("double") for a in axes)
    size = F.sqrt(x * x + y * y + z * z)
    band = F.least(F.floor((z / size + 1) / 2 * bands), F.lit(bands - 1))
    sector = F.least(F.floor(F.pmod(F.atan2(y, x) / (2 * math.pi), F.lit(1.0)) * around), F.lit(around - 1))
    cells = rows.where(size > 0).groupBy((band * around + sector).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    total, seen = around * bands, F.count(F.lit(1))
    return cells.agg(F.lit(total).cast("long").alias("cells"), seen.alias("occupied"), (seen / total).alias("score"), F.when(seen == total, F.min("n")).otherwise(0).cast("long").alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def nearest_error(points: DataFrame, track: DataFrame, reach: float, x: str = "x", y: str = "y", key: str = "id") -> DataFrame:
    """(key, distance): how far each point is from the nearest point of a track.

    The plane is cut into squares of side ``reach``; a point looks into its own
    and the eight around it.  What finds nothing within ``reach`` looks again with
    twice as much, up to the extent of both.  A point with a null coordinate, or
    an empty track, gives null; of rows of one key the nearest counts.
    """
    if reach <= 0:
        raise ValueError("reach is not positive")
    work = Scratch(points.sparkSession, "nearest")
    there = work.save(track.select(F.col(x).cast("double").alias("tx"), F.col(y).cast("double").alias("ty")).where("tx IS NOT NULL AND ty IS NOT NULL").distinct(), "track")
    asked = work.save(points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")), "points")
    left = asked.where("px IS NOT NULL AND py IS NOT NULL").distinct()
    edge = lambda d, a, b: d.agg(F.min(a).alias("x0"), F.max(a).alias("x1"), F.min(b).alias("y0"), F.max(b).alias("y1")).first()
    ends = [edge(there, "tx", "ty"), edge(left, "px", "py")]
    found, step = None, 0
    if None not in [e["x0"] for e in ends]:
        extent = math.hypot(max(e["x1"] for e in ends) - min(e["x0"] for e in ends), max(e["y1"] for e in ends) - min(e["y0"] for e in ends))
        while True:
            near = work.save(_within(left, there, reach), f"near_{step}")
            found = near if found is None else found.unionByName(near)
            left = work.save(left.join(near.select("px", "py"), ["px", "py"], "left_anti"), f"left_{step}")
            if reach >= extent or left.isEmpty():
                break
            reach, step = 2 * reach, step + 1
    if found is None:
        return asked.select(F.col("id").alias(key), F.lit(None).cast("double").alias("distance")).distinct()
    own = asked.join(found, ["px", "py"], "left").groupBy("id").agg(F.min("distance").alias("distance"))
    return own.select(F.col("id").alias(key), "distance")


def _within(points: DataFrame, track: DataFrame, reach: float) -> DataFrame:
    """(px, py, distance) of the points that have a track point within ``reach``."""
    cells = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    square = lambda c: F.floor(F.col(c) / reach)
    own = points.select("px", "py").distinct().select("px", "py", square("px").alias("cx"), square("py").alias("cy"), cells.alias("d"))
    own = own.select("px", "py", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    there = track.select("tx", "ty", square("tx").alias("cx"), square("ty").alias("cy"))
    far = F.sqrt(F.pow(F.col("px") - F.col("tx"), 2) + F.pow(F.col("py") - F.col("ty"), 2))
    return own.join(there, ["cx", "cy"]).where(far <= reach).groupBy("px", "py").agg(F.min(far).alias("distance"))


def nearest_error_summary(errors: DataFrame, distance: str = "distance") -> DataFrame:
    """One row: n, median and p95 of known distances, exact."""
    return exact_quantiles(errors, None, distance, [0.5, 0.95]).select("n", F.col("q0").alias("median"), F.col("q1").alias("p95"))


def _design_products(rows: DataFrame, x: str, y: str, z: str, weight: Column | float = 1.0):
    """The weighted sums of products of the ten monomials of a point, a small matrix."""
    import numpy as np

    a, b, c = F.col(x).cast("double"), F.col(y).cast("double"), F.col(z).cast("double")
    terms = [a * a, b * b, c * c, 2 * a * b, 2 * a * c, 2 * b * c, 2 * a, 2 * b, 2 * c, F.lit(1.0)]
    pairs = [(i, j) for i in range(10) for j in range(i, 10)]
    known = rows.where(a.isNotNull() & b.isNotNull() & c.isNotNull())
    sums = known.agg(F.count(F.lit(1)).alias("n"), *[F.sum(weight * terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    if sums["n"] < 9:
        raise ValueError("an ellipsoid needs nine points")
    m = np.zeros((10, 10))
    for i, j in pairs:
        m[i, j] = m[j, i] = sums[f"s{i}_{j}"]
    return m


def fit_condition(rows: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> float:
    """How well points determine an ellipsoid: largest over second smallest singular value of the design matrix of columns of length one.

    The smallest one is that of the fit itself, near zero for good points.
    Fewer than nine points are an error; points in a plane give a huge number.
    """
    import numpy as np

    m = _design_products(rows, x, y, z)
    scale = 1 / np.sqrt(np.maximum(np.diag(m), np.finfo(float).tiny))
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(m * scale[:, None] * scale[None, :]), 0))
    return float(values[-1] / values[1]) if values[1] > 0 else math.inf


def ellipsoid_fit(rows: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> tuple[list[float], list[float]]:
    """(centre, radii, largest first) of the ellipsoid through the points, by least squares.

    The ten monomials of a point are a row of the design matrix; its 55 products
    are summed in Spark, and the driver solves for the least eigenvector of that
    small matrix.  Fewer than nine points, or points on no ellipsoid, are an error.
    """
    import numpy as np

    centre, form = ellipsoid_form(rows, x, y, z)
    return centre.tolist(), sorted((1 / np.sqrt(np.linalg.eigvalsh(form))).tolist(), reverse=True)


def ellipsoid_form(rows: DataFrame, x: str, y: str, z: str, weight: Column | float = 1.0):
    """(c, A) with (p - c)' A (p - c) = 1 on the ellipsoid of least squares of weighted points."""
    import numpy as np

    m = _design_products(rows, x, y, z, weight)
    scale = 1 / np.sqrt(np.diag(m))
    v = np.linalg.eigh(m * scale[:, None] * scale[None, :])[1][:, 0] * scale
    return centred_form(v)


def centred_form(v):
    """(c, A) of the surface with ten coefficients ``v`` of the monomials; an error if it is no ellipsoid."""
    import numpy as np

    form = np.array([[v[0], v[3], v[4]], [v[3], v[1], v[5]], [v[4], v[5], v[2]]])
    centre = -np.linalg.solve(form, v[6:9])
    form = form / (centre @ form @ centre - v[9])
    if not (np.linalg.eigvalsh(form) > 0).all():
        raise ValueError("the points are on no ellipsoid")
    return centre, form
