"""Robust fits against plain versions, and what they make of odd rows."""

import hashlib

import numpy as np
import pytest

from parafold.operators import robust


def line_points(n, seed, outliers=0.3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 100, n)
    y = 2.5 * x - 7 + rng.normal(0, 1, n)
    far = rng.random(n) < outliers
    y[far] += rng.uniform(50, 300, far.sum())
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]


def plain_draw(points, n, seed):
    hashed = sorted({(hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), *p) for i, *p in points})
    return hashed[:n]


def plain_huber(x, y, rounds=200):
    slope, offset = np.polyfit(x, y, 1)
    s = robust.NORMAL * np.median(np.abs(y - offset - slope * x))
    for _ in range(rounds):
        r = np.abs(y - offset - slope * x)
        w = np.where(r <= robust.HUBER * s, 1, robust.HUBER * s / np.maximum(r, 1e-300))
        slope, offset = np.polyfit(x, y, 1, w=np.sqrt(w))
    return slope, offset


@pytest.mark.parametrize("n, copies", [(5, 1), (400, 1), (50, 40)])
def test_drawn_rows(spark, n, copies):
    points = line_points(n, 1)
    rows = spark.createDataFrame(points * copies + [points[0]] * 500, "id long, x double, y double").repartition(7)
    assert [tuple(r) for r in robust.draw_rows(rows, 20, ["x", "y"], seed=3)] == plain_draw(points, 20, 3)


def test_consensus_line(spark):
    points = line_points(600, 2)
    odd = [(None, 1.0, -4.5), (9001, None, 1.0), (9002, 3.0, float("nan")), (9003, float("inf"), 1.0)]
    rows = spark.createDataFrame([(*p, 1, 2) for p in points + odd], "id long, x double, y double, h int, g int")
    got = robust.consensus_line(rows, "x", "y", 3.0, 20, seed=5).first()
    x, y = np.array([p[1:] for p in points + odd[:1]]).T
    drawn, best = plain_draw(points, 40, 5), None
    for a, b in zip(drawn[::2], drawn[1::2], strict=True):
        m = (b[2] - a[2]) / (b[1] - a[1])
        inside = np.abs(y - (a[2] - m * a[1] + m * x)) <= 3.0
        if best is None or inside.sum() > best.sum():
            best = inside
    slope, offset = np.polyfit(x[best], y[best], 1)
    assert (got["n"], got["inliers"]) == (601, best.sum())
    assert got["slope"] == pytest.approx(slope, abs=1e-9) and got["intercept"] == pytest.approx(offset, abs=1e-7)
    assert abs(slope - 2.5) < 0.05 and abs(offset + 7) < 2


@pytest.mark.parametrize("points, n", [([], 0), ([(1, 1.0, 2.0)], 1), ([(1, 1.0, 2.0), (2, 1.0, 3.0)], 2)])
def test_line_of_too_little(spark, points, n):
    rows = spark.createDataFrame(points, "id long, x double, y double")
    assert tuple(robust.consensus_line(rows, "x", "y", 1.0).first()) == (n, 0, None, None)
    got = robust.huber_line(rows, "id", "x", "y").collect()
    assert len(got) == n and all(r["slope"] is None and r["intercept"] is None for r in got)


def test_huber_line(spark):
    sets = {"a": line_points(300, 3), "b": line_points(40, 4, 0.1), None: line_points(120, 5, 0.0)}
    exact = [(i, float(i), 3.0 * i + 1) for i in range(9)] + [(9, 4.0, 80.0)]
    rows = [(k, *p[1:]) for k, ps in [*sets.items(), ("exact", exact)] for p in ps] + [("a", None, 1.0)]
    got = {r["k"]: r for r in robust.huber_line(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y", tolerance=1e-8).collect()}
    for k, ps in sets.items():
        x, y = np.array([p[1:] for p in ps]).T
        slope, offset = plain_huber(x, y)
        assert got[k]["n"] == len(ps)
        assert got[k]["slope"] == pytest.approx(slope, abs=1e-6) and got[k]["intercept"] == pytest.approx(offset, abs=1e-4) and got[k]["converged"]
    least = np.polyfit([p[1] for p in exact], [p[2] for p in exact], 1)
    assert abs(got["exact"]["intercept"] - 1) < abs(least[1] - 1)


def ellipsoid_points(n, seed, outliers):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[: int(outliers * n)] *= rng.uniform(1.5, 4, (int(outliers * n), 1))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    return [(i, *map(float, p)) for i, p in enumerate(u * [5, 3, 2] @ turn + [1, -2, 30])]


def test_ellipsoids(spark):
    """Outliers that leave the plain fit without an ellipsoid, or far off."""
    wanted = [1, -2, 30, 5, 3, 2]
    points = ellipsoid_points(800, 6, 0.15) + [(None, None, 1.0, 1.0), (-1, float("nan"), 0.0, 0.0)]
    rows = spark.createDataFrame(points, "id long, x double, y double, z double")
    first = robust.consensus_ellipsoid(rows, 1e-6)
    assert (first.n, first.inliers) == (800, 680) and np.allclose([*first.centre, *first.radii], wanted, atol=1e-6)
    assert first.inliers == rows.where(robust.F.abs(first.residual()) <= 1e-6).count()
    with pytest.raises(ValueError):
        robust.huber_ellipsoid(rows)
    last = robust.huber_ellipsoid(rows, first)
    assert last.converged and last.inliers == 680 and np.allclose([*last.centre, *last.radii], wanted, atol=1e-6)


def test_huber_ellipsoid_of_noise(spark):
    rng = np.random.default_rng(8)
    noisy = [(i, *map(float, np.array(p) + rng.normal(0, 0.02, 3))) for i, *p in ellipsoid_points(600, 9, 0.05)]
    rows = spark.createDataFrame(noisy, "id long, x double, y double, z double")
    got = robust.huber_ellipsoid(rows, robust.consensus_ellipsoid(rows, 0.05, 24), tolerance=1e-5)
    assert got.converged and got.n == 600 and np.allclose([*got.centre, *got.radii], [1, -2, 30, 5, 3, 2], atol=0.05)


def test_no_ellipsoid(spark):
    rows = spark.createDataFrame([(i, float(i), float(i), 0.0) for i in range(30)], "id long, x double, y double, z double")
    with pytest.raises(ValueError):
        robust.consensus_ellipsoid(rows, 0.1)
    with pytest.raises(ValueError):
        robust.huber_ellipsoid(rows.limit(5))
