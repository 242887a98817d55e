"""Fits that outliers do not spoil: the most consented hypothesis, and Huber weights.

**Hypotheses** are drawn by hash: the rows of the least hashes of ``seed:id`` are
cut, in that order, into the smallest samples that determine a model.  All models
are scored by one aggregate over all rows, and the one with the most rows within
``bound`` (of equal ones the first drawn) is fitted again to those rows.  What
reaches the driver are the drawn rows, whose number is a parameter, and one count
for each model.

**Huber weights**: rounds of weighted normal equations.  A residual within ``k``
times the spread weighs one, a larger one as much less as it is larger.  The spread
is 1.4826 times the exact median of absolute residuals of the first model and
holds for all rounds, so that they descend to one minimum; each is one aggregate.
Rounds end when the model moves by no more than ``tolerance``, or after ``most``
of them; results say whether they have converged.

Defined results.  Rows with a null, NaN or infinite coordinate take no part.
Rows of a null id are not drawn, but are scored.  Rows that repeat id and
coordinates are drawn once and weigh as often as they are there.  Too few rows, or rows that
determine no model, give a null line, and an error for an ellipsoid.  A null key
is a key of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordering import key_struct
from .quantiles import exact_quantiles
from .sensing import centred_form, ellipsoid_form

#: Median absolute deviations to a standard deviation of normal errors, and where Huber weights begin to fall.
NORMAL, HUBER = 1.4826, 1.345
#: Residuals of rounding have full weight, where more than half of the points fit exactly; normal matrices lose half of the digits.
ROUNDING = 1e-9


def _finite(column: str) -> Column:
    return F.abs(F.col(column).cast("double")) < F.lit(float("inf"))


def _known(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        rows = rows.where(_finite(c))
    return rows


def draw_rows(rows: DataFrame, n: int, columns: Sequence[str], id: str = "id", seed: int = 0) -> list[Row]:
    """The ``n`` distinct rows (h, columns) of the least hashes ``h``, in order of hash.

    Only hashes below a share that holds about twice as many are told apart and
    sorted; where copies make that too few, the share grows.  So the rows are the
    same for any share.
    """
    own = _known(rows, columns).select(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))).alias("h"), *[F.col(c).cast("double").alias(c) for c in columns]).where("h IS NOT NULL")
    total = own.count()
    share = (2 * n + 64) / max(total, 1)
    while True:
        part = own if share >= 1 else own.where(F.col("h") < F.lit(f"{int(share * 16**8):08x}"))
        drawn = part.distinct().orderBy("h", *columns).limit(n).collect()
        if len(drawn) == n or share >= 1:
            return drawn
        share *= 4


def most_inliers(rows: DataFrame, residuals: Sequence[Column], bound: float) -> tuple[int, int]:
    """(which, inliers) of the residual that is within ``bound`` in most rows, the first of equals; one pass for all."""
    counts = rows.agg(*[F.count_if(F.abs(r) <= bound).alias(f"h{t}") for t, r in enumerate(residuals)]).first()
    best = max(range(len(residuals)), key=lambda t: (counts[t], -t))
    return best, counts[best]


def consensus_line(rows: DataFrame, x: str, y: str, bound: float, trials: int = 64, id: str = "id", seed: int = 0) -> DataFrame:
    """One row n, inliers, slope, intercept: the line y = intercept + slope x with most rows within ``bound``, fitted again to them."""
    known = _known(rows, [x, y]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    drawn = draw_rows(rows, 2 * trials, [x, y], id, seed)
    lines = []
    for a, b in zip(drawn[::2], drawn[1::2], strict=False):
        if a[1] != b[1]:
            slope = (b[2] - a[2]) / (b[1] - a[1])
            lines.append((slope, a[2] - slope * a[1]))
    if not lines:
        none = F.lit(None).cast("double")
        return known.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("inliers"), none.alias("slope"), none.alias("intercept"))
    residuals = [F.col("y") - (F.lit(c) + F.lit(m) * F.col("x")) for m, c in lines]
    inside = F.abs(residuals[most_inliers(known, residuals, bound)[0]]) <= bound
    kept = [F.when(inside, F.col(c)) for c in "yx"]
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inliers"), F.regr_slope(*kept).alias("slope"), F.regr_intercept(*kept).alias("intercept"))


def huber_line(rows: DataFrame, key: str, x: str, y: str, k: float = HUBER, tolerance: float = 1e-9, most: int = 50) -> DataFrame:
    """(key, n, slope, intercept, spread, converged) of each key's line with Huber weights, from that of least squares on.

    The rows are centred by their means first, for the sake of the sums.  All
    keys go on until each has settled; a spread of zero leaves the line as it is.
    """
    work = Scratch(rows.sparkSession, "huber")
    own = _known(rows, [x, y]).select(key_struct(key).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    means = work.save(own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")), "means")
    points = work.save(own.join(means, "g").select("g", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y")), "points")
    first = work.save(_weighted_lines(points, F.lit(1.0)), "first")
    r = F.abs(F.col("y") - F.col("offset") - F.col("slope") * F.col("x"))
    spread = exact_quantiles(points.join(first, "g").select("g", r.alias("r")), "g", "r", [0.5]).select("g", (F.col("q0") * NORMAL).alias("spread"))
    fit = work.save(first.join(spread, "g").withColumn("moved", F.lit(None).cast("double")), "fit_0")
    over = F.lit(k) * F.col("spread")
    weight = F.when((r <= over) | (F.col("spread") == 0), 1.0).otherwise(over / r)
    for turn in range(1, most + 1):
        new = _weighted_lines(points.join(fit, "g"), weight).join(fit.select("g", "spread", F.col("slope").alias("s0"), F.col("offset").alias("o0")), "g")
        moved = F.greatest(F.abs(F.col("slope") - F.col("s0")), F.abs(F.col("offset") - F.col("o0")))
        fit = work.save(new.select("g", "slope", "offset", "spread", moved.alias("moved")), f"fit_{turn}")
        work.drop(f"fit_{turn - 1}")
        if fit.where(F.col("moved") > tolerance).isEmpty():
            break
    out = means.join(fit, "g", "left")
    intercept = F.col("my") + F.col("offset") - F.col("slope") * F.col("mx")
    return out.select(F.col("g.k0").alias(key), "n", "slope", intercept.alias("intercept"), "spread", (F.col("moved") <= tolerance).alias("converged"))


def _weighted_lines(points: DataFrame, weight: Column) -> DataFrame:
    """(g, slope, offset) of least squares of points (g, x, y); null for points above one another."""
    w = points.withColumn("w", weight)
    sums = w.groupBy("g").agg(F.sum("w").alias("w"), *[F.sum(F.expr(f"w * {t}")).alias(n) for n, t in (("sx", "x"), ("sy", "y"), ("xx", "x * x"), ("xy", "x * y"))])
    below = F.expr("nullif(w * xx - sx * sx, 0D)")
    slope = F.expr("w * xy - sx * sy") / below
    return sums.select("g", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("w")).alias("offset"))


@dataclass(frozen=True)
class Ellipsoid:
    """(p - centre)' form (p - centre) = 1, with what its fit was like."""

    centre: tuple[float, ...]
    form: tuple[tuple[float, ...], ...]
    radii: tuple[float, ...]
    n: int
    inliers: int
    rounds: int
    converged: bool

    def residual(self, x: str = "x", y: str = "y", z: str = "z") -> Column:
        """How far a point lies beyond the surface, as a share of the distance of the surface from the centre."""
        return _radial(self.centre, self.form, (x, y, z))


def _radial(centre, form, axes: Sequence[str]) -> Column:
    d = [F.col(a).cast("double") - float(c) for a, c in zip(axes, centre, strict=True)]
    square = sum((d[i] * d[j] * float(form[i][j]) for i in range(3) for j in range(3)), F.lit(0.0))
    return F.sqrt(square) - 1


def _ellipsoid(centre, form, n: int, inliers: int, rounds: int, converged: bool) -> Ellipsoid:
    import numpy as np

    radii = sorted((1 / np.sqrt(np.linalg.eigvalsh(form))).tolist(), reverse=True)
    return Ellipsoid(tuple(map(float, centre)), tuple(tuple(map(float, r)) for r in form), tuple(radii), n, inliers, rounds, converged)


def consensus_ellipsoid(rows: DataFrame, bound: float, trials: int = 64, axes: Sequence[str] = ("x", "y", "z"), id: str = "id", seed: int = 0) -> Ellipsoid:
    """The ellipsoid through nine drawn points with most points within ``bound``, fitted again to those.

    Samples that are on no ellipsoid are no hypotheses; none at all is an error.
    With a share w of good points, ``trials`` samples miss with (1 - w^9)^trials.
    """
    import numpy as np

    known, found = _known(rows, axes), []
    drawn = np.array([r[1:] for r in draw_rows(rows, 9 * trials, axes, id, seed)], float).reshape(-1, 3)
    for t in range(len(drawn) // 9):
        a, b, c = drawn[9 * t : 9 * t + 9].T
        try:
            v = np.linalg.solve(np.stack([a * a, b * b, c * c, 2 * a * b, 2 * a * c, 2 * b * c, 2 * a, 2 * b, 2 * c], 1), np.ones(9))
            found.append(centred_form(np.append(v, -1.0)))
        except (np.linalg.LinAlgError, ValueError):  # nine points on another surface
            continue
    if not found:
        raise ValueError("no drawn points are on an ellipsoid")
    residuals = [_radial(*f, axes) for f in found]
    best, inliers = most_inliers(known, residuals, bound)
    centre, form = ellipsoid_form(known.where(F.abs(residuals[best]) <= bound), *axes)
    return _ellipsoid(centre, form, known.count(), inliers, 1, True)


def huber_ellipsoid(rows: DataFrame, start: Ellipsoid | None = None, axes: Sequence[str] = ("x", "y", "z"), k: float = HUBER, tolerance: float = 1e-8, most: int = 50) -> Ellipsoid:
    """The ellipsoid of least squares with Huber weights of radial residuals; ``inliers`` are points of full weight.

    It begins at ``start``, such as that of ``consensus_ellipsoid``, or at the
    plain fit, which far outliers can spoil so much that it is none, an error.
    Weights are also divided by what an algebraic residual is to a radial one.  It
    has converged when a round moves the surface, seen as a unit sphere, by no more
    than ``tolerance``.
    """
    import numpy as np

    known = _known(rows, axes)
    centre, form = (np.array(start.centre), np.array(start.form)) if start else ellipsoid_form(known, *axes)
    seen = exact_quantiles(known.select(F.abs(_radial(centre, form, axes)).alias("r")), None, "r", [0.5]).first()
    if not seen or not seen["n"]:
        raise ValueError("no points")
    over = ROUNDING + k * NORMAL * seen["q0"]
    for turn in range(1, most + 1):
        # The last fit becomes the unit sphere at the origin, where sums of products keep their digits.
        half = np.linalg.cholesky(form)
        d = [F.col(a).cast("double") - float(c) for a, c in zip(axes, centre, strict=True)]
        u = known.select(*[sum((d[i] * float(half[i, j]) for i in range(3)), F.lit(0.0)).alias(f"u{j}") for j in range(3)])
        r = F.sqrt(sum((F.col(f"u{j}") * F.col(f"u{j}") for j in range(3)), F.lit(0.0))) - 1
        step, shape = ellipsoid_form(u, "u0", "u1", "u2", F.when(F.abs(r) <= over, 1.0).otherwise(over / F.abs(r)) / ((r + 2) * (r + 2)))
        centre, form = centre + np.linalg.solve(half.T, step), half @ shape @ half.T
        moved = max(np.abs(step).max(), np.abs(shape - np.eye(3)).max())
        if moved <= tolerance:
            break
    inliers = known.where(F.abs(_radial(centre, form, axes)) <= over).count()
    return _ellipsoid(centre, form, seen["n"], inliers, turn, bool(moved <= tolerance))
