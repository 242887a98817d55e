"""Queries of fits that outliers do not spoil, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import robust
from .queries import _events, query

# What the queries are given.
BOUND, TRIALS, TOLERANCE, ROUNDS = 12.0, 24, 1e-7, 24

_HUBER = ["WITH e AS (SELECT event_type, event_id / 1000 AS x, value AS y FROM events)", "f0 AS MATERIALIZED (SELECT event_type, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM e GROUP BY 1)",
          f"s AS MATERIALIZED (SELECT event_type, {robust.NORMAL} * median(abs(y - a - b * x)) AS s FROM e JOIN f0 USING (event_type) GROUP BY 1)"]
for _n in range(1, ROUNDS + 1):
    _HUBER.append(f"w{_n} AS (SELECT event_type, x - 5 AS x, y, CASE WHEN abs(y - a - b * x) <= {robust.HUBER} * s THEN 1 ELSE {robust.HUBER} * s / abs(y - a - b * x) END AS w FROM e JOIN f{_n - 1} USING (event_type) JOIN s USING (event_type))")
    _HUBER.append(f"""f{_n} AS MATERIALIZED (SELECT event_type, b, (sy - b * sx) / w - 5 * b AS a FROM (SELECT event_type, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy,
        (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS b FROM w{_n} GROUP BY 1))""")


@query(", ".join(_HUBER) + f" SELECT event_type, n, round(b, 4) AS slope, round(a, 4) AS intercept, round(s, 4) AS spread, true AS converged FROM f{ROUNDS} JOIN s USING (event_type) JOIN (SELECT event_type, count(*) AS n FROM e GROUP BY 1) USING (event_type)")
def huber_lines(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("x", F.col("event_id") / 1000)
    fit = robust.huber_line(rows, "event_type", "x", "value", tolerance=TOLERANCE)
    return fit.select("event_type", "n", "converged", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "spread")])


@query(f"""WITH e AS (SELECT md5('0:' || event_id) AS h, event_id / 1000 AS x, value AS y FROM events),
d AS (SELECT *, row_number() OVER (ORDER BY h, x, y) - 1 AS i FROM (SELECT DISTINCT * FROM e)),
l AS (SELECT p.i // 2 AS t, (q.y - p.y) / (q.x - p.x) AS m, p.y - (q.y - p.y) / (q.x - p.x) * p.x AS c FROM d p JOIN d q ON p.i % 2 = 0 AND q.i = p.i + 1 AND p.x <> q.x WHERE p.i < {2 * TRIALS}),
best AS (SELECT t, m, c, count(*) AS k FROM l, e WHERE abs(y - (c + m * x)) <= {BOUND} GROUP BY ALL ORDER BY k DESC, t LIMIT 1)
SELECT (SELECT count(*) FROM e) AS n, count(*) AS inliers, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM e, best WHERE abs(y - (c + m * x)) <= {BOUND}""")
def consensus_line(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("x", F.col("event_id") / 1000)
    fit = robust.consensus_line(rows, "x", "value", BOUND, TRIALS, "event_id")
    return fit.select("n", "inliers", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT count(*) AS n, count(*) FILTER (vec_id % 5 > 0) AS inliers, true AS consensus_right, true AS huber_right FROM v WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND x * x + y * y + z * z > 0""")
def robust_ellipsoids(spark, sf_dir):
    """The first three components put on an ellipsoid, a fifth of them off it; both fits find it."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    off = F.when(F.col("vec_id") % 5 == 0, 1.3 + F.col("vec_id") % 7 / 10).otherwise(1.0)
    points = v.where(size > 0).select("vec_id", (3 * off * F.col("x") / size + 10).alias("x"), (2 * off * F.col("y") / size - 4).alias("y"), (off * F.col("z") / size + 0.5).alias("z"))
    consensus = robust.consensus_ellipsoid(points, 1e-6, id="vec_id")
    huber = robust.huber_ellipsoid(points, consensus)
    wanted = [10, -4, 0.5, 3, 2, 1]
    right = lambda e, near: all(abs(a - b) < near for a, b in zip([*e.centre, *e.radii], wanted, strict=True))
    return spark.range(1).select(F.lit(consensus.n).cast("long").alias("n"), F.lit(consensus.inliers).cast("long").alias("inliers"), F.lit(right(consensus, 1e-6)).alias("consensus_right"), F.lit(right(huber, 1e-6)).alias("huber_right"))
