"""Queries of filters, alignment and segments over the driver's tables, and their DuckDB SQL.

The SQL of a filter is its plain recursion, row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, ordering, segments, sensing
from .queries import N, _events, query

# What the queries are given.
SHARE, CUTOFF, RATE = 0.3, 2.0, 50.0
ACCELERATION, NOISE, FACTORS, BOUND = 0.5, 4.0, [0.1, 1.0, 10.0], 33.0
KP, KI, DT = 1.0, 0.1, 0.02
ORDER = ("ts", "event_id")

R = N.replace("WITH n", "WITH RECURSIVE n")
B0, B1, B2, A1, A2 = filters.butterworth(CUTOFF, RATE)


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS own FROM events")
def row_numbers(spark, sf_dir):
    rows = ordering.number_rows(_events(spark, sf_dir).select("event_id", "event_type", "value"), ["value", "event_id"], None, "place")
    return ordering.number_rows(rows, ["value", "event_id"], "event_type", "own").select("event_id", "place", "own")


@query(R + f""", f AS (SELECT user_id, event_id, i, value AS y FROM n WHERE i = 0 UNION ALL SELECT n.user_id, n.event_id, n.i, (1 - {SHARE}) * f.y + {SHARE} * n.value FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT event_id, round(y, 6) AS smoothed FROM f""")
def first_order_filter(spark, sf_dir):
    return filters.first_order_filter(_events(spark, sf_dir), SHARE, block=16).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(R + f""", f AS (SELECT user_id, event_id, i, value AS x1, value AS x2, value AS y, value AS y1 FROM n WHERE i = 0
UNION ALL SELECT n.user_id, n.event_id, n.i, n.value, f.x1, {B0!r} * n.value + {B1!r} * f.x1 + {B2!r} * f.x2 - {A1!r} * f.y - {A2!r} * f.y1, f.y FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT event_id, round(y, 6) AS smoothed FROM f""")
def low_pass(spark, sf_dir):
    return filters.low_pass(_events(spark, sf_dir), CUTOFF, RATE, block=16).select("event_id", F.round("smoothed", 6).alias("smoothed"))


def _kalman(keys: str, n: str) -> str:
    """The recursion over rows ``n`` (keys, event_id, i, z, dt, q)."""
    same = " AND ".join(f"n.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    return f"""{n}, f AS (SELECT {keys}, event_id, i, z AS h, CAST(0 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS e FROM n WHERE i = 0
UNION ALL SELECT {keys}, event_id, i, h + a / (a + {NOISE}) * (z - h), v + b / (a + {NOISE}) * (z - h), a - a * a / (a + {NOISE}), b - a * b / (a + {NOISE}), d - b * b / (a + {NOISE}), z - h
FROM (SELECT {', '.join(f'n.{k.strip()}' for k in keys.split(','))}, n.event_id, n.i, n.z, f.h + n.dt * f.v AS h, f.v, f.p + 2 * n.dt * f.c + n.dt * n.dt * f.w + n.q * pow(n.dt, 4) / 4 AS a, f.c + n.dt * f.w + n.q * pow(n.dt, 3) / 2 AS b, f.w + n.q * n.dt * n.dt AS d FROM f JOIN n ON {same} AND n.i = f.i + 1))"""


def _dt():
    return F.lit(0.1) + (F.col("event_id") % 3) * 0.01


_Z = N.replace("WITH n AS", "WITH RECURSIVE m AS")


@query(_kalman("user_id", _Z + f", n AS (SELECT user_id, event_id, i, value AS z, 0.1::DOUBLE + event_id % 3 * 0.01::DOUBLE AS dt, {ACCELERATION**2}::DOUBLE AS q FROM m)") + " SELECT event_id, round(h, 6) AS height, round(v, 6) AS velocity, round(p, 6) AS height_var, round(e, 6) AS innovation FROM f")
def height_kalman(spark, sf_dir):
    out = filters.height_kalman(_events(spark, sf_dir), ACCELERATION, NOISE, _dt(), block=16)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("height", "velocity", "height_var", "innovation")])


@query(_kalman("user_id, factor", _Z + f", n AS (SELECT user_id, factor, event_id, i, value AS z, 0.1::DOUBLE + event_id % 3 * 0.01::DOUBLE AS dt, factor * {ACCELERATION**2}::DOUBLE AS q FROM m, (VALUES " + ", ".join(f"({f}::DOUBLE)" for f in FACTORS) + ") t(factor))") + f" SELECT user_id, factor, count(e) AS n, round(sqrt(avg(e * e)), 6) AS rms_innovation, count(e) > 0 AND sqrt(avg(e * e)) > {BOUND} AS diverged FROM f GROUP BY user_id, factor")
def noise_sweep(spark, sf_dir):
    out = filters.noise_sweep(_events(spark, sf_dir), FACTORS, ACCELERATION, NOISE, _dt(), BOUND, block=32)
    return out.withColumn("rms_innovation", F.round("rms_innovation", 6)).withColumn("diverged", F.coalesce("diverged", F.lit(False)))


def _mahony_sql() -> str:
    turn = "2 * (x * z - w * y)", "2 * (y * z + w * x)", "1 - 2 * (x * x + y * y)"
    steps = [
        f"p AS (SELECT n.user_id, n.event_id, n.i, w, x, y, z, u1, u2, u3, gx, gy, gz, ax / s AS ax, ay / s AS ay, az / s AS az, {turn[0]} AS vx, {turn[1]} AS vy, {turn[2]} AS vz FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)",
        "e AS (SELECT *, ay * vz - az * vy AS ex, az * vx - ax * vz AS ey, ax * vy - ay * vx AS ez FROM p)",
        f"b AS (SELECT * REPLACE (u1 - {KI} * ex * {DT} AS u1, u2 - {KI} * ey * {DT} AS u2, u3 - {KI} * ez * {DT} AS u3) FROM e)",
        f"h AS (SELECT *, (gx - u1 + {KP} * ex) * {DT} / 2 AS hx, (gy - u2 + {KP} * ey) * {DT} / 2 AS hy, (gz - u3 + {KP} * ez) * {DT} / 2 AS hz FROM b)",
        "r AS (SELECT *, w - x * hx - y * hy - z * hz AS nw, x + w * hx + y * hz - z * hy AS nx, y + w * hy - x * hz + z * hx AS ny, z + w * hz + x * hy - y * hx AS nz FROM h)",
    ]
    rows = "n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS s FROM (SELECT user_id, event_id, i, value / 1000 AS gx, (event_id % 7 - 3) / 50 AS gy, 0.01::DOUBLE AS gz, (event_id % 5 - 2) / 10 AS ax, (event_id % 3 - 1) / 10 AS ay, 1.0::DOUBLE AS az FROM m))"
    zero = ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, v in zip(["w", "x", "y", "z", "u1", "u2", "u3"], [1, 0, 0, 0, 0, 0, 0], strict=True))
    start = f"SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(-1 AS BIGINT) AS i, {zero} FROM n WHERE i = 0"
    norm = "sqrt(nw * nw + nx * nx + ny * ny + nz * nz)"
    fold = f"f AS ({start} UNION ALL (WITH {', '.join(steps)} SELECT user_id, event_id, i, nw / {norm}, nx / {norm}, ny / {norm}, nz / {norm}, u1, u2, u3 FROM r))"
    names = {"w": "qw", "x": "qx", "y": "qy", "z": "qz", "u1": "bx", "u2": "by", "u3": "bz"}
    return f"{_Z}, {rows}, {fold} SELECT event_id, {', '.join(f'round({c}, 6) + 0.0 AS "{a}"' for c, a in names.items())} FROM f WHERE i >= 0"


@query(_mahony_sql())
def mahony_attitude(spark, sf_dir):
    n = F.col("event_id")
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("value") / 1000).alias("gx"), ((n % 7 - 3) / 50).alias("gy"), F.lit(0.01).alias("gz"), ((n % 5 - 2) / 10).alias("ax"), ((n % 3 - 1) / 10).alias("ay"), F.lit(1.0).alias("az"), F.lit(DT).alias("dt"))
    out = filters.mahony(rows, ["gx", "gy", "gz"], ["ax", "ay", "az"], "dt", kp=KP, ki=KI)
    return out.select("event_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("qw", "qx", "qy", "qz", "bx", "by", "bz")])


@query(N + """, a AS (SELECT user_id, i, sqrt(value * value + 1) AS a, abs(event_id % 10) / 10 AS w FROM n),
s AS (SELECT user_id, i, count(*) OVER v = 4 AND stddev_pop(a) OVER v <= 20 AND avg(w) OVER v <= 0.55 AS s FROM a WINDOW v AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM s)
SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n FROM o WHERE s GROUP BY user_id, run HAVING count(*) >= 2""")
def zero_velocity(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn("turn", (F.col("event_id") % 10) / 10)
    return segments.zero_velocity_segments(rows, ["value", "one"], ["turn"], 4, 20.0, 0.55, 2, block=16)


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), v AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT a.*, v.t AS t0, v.value AS v0 FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.t >= v.t), b AS (SELECT p.*, v.t AS t1, v.value AS v1 FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t <= v.t)
SELECT event_id, CASE WHEN t0 IS NULL OR t1 - t < t - t0 THEN v1 ELSE v0 END AS nearest_value FROM b""")
def align_nearest(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    out = segments.align_nearest(rows.where("event_type = 'click'").select("event_id", "user_id", "t"), rows.where("event_type = 'view'"), "user_id", "t", ["value"], block=64)
    return out.select("event_id", "nearest_value")


@query("SELECT count(*) AS n, 3 AS n_radii, true AS inside FROM embeddings")
def ellipsoid(spark, sf_dir):
    """Points of the sphere of each vector's first three components, moved and stretched: the fit finds centre and radii."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(*[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    points = v.select((3 * F.col("x") / size + 10).alias("x"), (2 * F.col("y") / size - 4).alias("y"), (F.col("z") / size + 0.5).alias("z"))
    centre, radii = sensing.ellipsoid_fit(points)
    right = all(abs(a - b) < 1e-6 for a, b in zip([*centre, *radii], [10, -4, 0.5, 3, 2, 1], strict=True))
    return points.agg(F.count(F.lit(1)).alias("n"), F.lit(len(radii)).alias("n_radii"), F.lit(right).alias("inside"))
