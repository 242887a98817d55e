"""Filters over series: linear ones as scans of blocks, the Mahony filter as an ordered fold.

A linear filter is a composition of small maps, one for each row, and
composition is associative.  Rows are numbered, blocks of them are folded to one
map each, blocks of blocks likewise, and every block then starts from what all
earlier ones compose to.  So a key of any length is spread over all tasks, and a
task never holds more than a block and a batch.  Within a batch the maps of all
blocks are composed together, in as many vector steps as a block has binary
digits.

The Mahony filter is not linear, so that no such composition exists: the rows of
a key stream in order through one task, which carries the attitude and the bias
from batch to batch.

Defined results.  A null key is a key of its own.  A row whose reading is null
is left out of a filter and gets null results, but for ``height_kalman``, which
predicts there.  Rows that tie in order are taken in an order fixed once they
are numbered.  Empty tables give empty results; other columns are kept, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .ordering import key_struct, number_rows

#: Rows of one block of a scan.
BLOCK = 256


class Recurrence(NamedTuple):
    """Maps of rows as arrays of ``width`` numbers, one row each, and how two of them compose."""

    width: int
    #: Maps from the readings, given by name; ``first`` is true at the first row of a key.
    element: Callable[[Mapping[str, np.ndarray]], np.ndarray]
    #: The earlier map and then the later one.
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: Result columns from the composition up to the row before, up to the row, and the readings.
    result: Callable[[np.ndarray, np.ndarray, Mapping[str, np.ndarray]], Mapping[str, np.ndarray]]


def composed(maps: np.ndarray, place: np.ndarray, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Composition of each map with all before it in its run; ``place`` is 0, 1, ... within a run."""
    out, step = maps.copy(), 1
    while step <= (int(place.max()) if len(place) else 0):
        later = np.flatnonzero(place >= step)
        out[later] = combine(out[later - step], out[later])
        step *= 2
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches cut between blocks, with the place of each row in its block; a block begins where ``opens`` is true."""
    kept: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        starts = np.flatnonzero(table.column("opens").to_numpy(zero_copy_only=False))
        return table, np.arange(len(table)) - np.repeat(starts, np.diff(np.append(starts, len(table))))

    for batch in batches:
        starts = np.flatnonzero(batch.column("opens").to_numpy(zero_copy_only=False))
        if not len(starts):
            kept.append(batch)
            continue
        cut = int(starts[-1])
        if cut or kept:
            yield whole([*kept, batch.slice(0, cut)])
        kept = [batch.slice(cut)]
    if any(len(b) for b in kept):
        yield whole(kept)


def _maps(table: pa.Table, inputs: Sequence[str] | None, recurrence: Recurrence) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The map of each row: the carried one if it has one, else that of its readings."""
    given = table.column("given").combine_chunks()
    given = given.chunk(0) if isinstance(given, pa.ChunkedArray) and given.num_chunks else given
    has = np.asarray(given.is_valid().to_numpy(zero_copy_only=False), bool)
    values = {}
    out = np.zeros((len(table), recurrence.width))
    if inputs is not None:
        values = {c: table.column(c).to_numpy().astype(float) for c in inputs}
        values["first"] = table.column("i").to_numpy() == 0
        out[~has] = recurrence.element({c: v[~has] for c, v in values.items()})
    if has.any():
        out[has] = given.flatten().to_numpy(zero_copy_only=False).reshape(-1, recurrence.width)
    return out, values


def _folder(inputs: Sequence[str] | None, recurrence: Recurrence):
    """One map for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, place in _runs(batches):
            total = composed(_maps(table, inputs, recurrence)[0], place, recurrence.combine)
            last = np.append(np.flatnonzero(place == 0)[1:] - 1, len(table) - 1)
            ends = table.take(pa.array(last))
            given = pa.FixedSizeListArray.from_arrays(pa.array(total[last].reshape(-1)), recurrence.width).cast(pa.list_(pa.float64()))
            yield from pa.table({"g": ends.column("g"), "i": ends.column("b"), "given": given}).to_batches()

    return run


def _applier(inputs: Sequence[str] | None, recurrence: Recurrence, outputs: Sequence[str]):
    """Compositions or result columns of all rows but the carried ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, place in _runs(batches):
            maps, values = _maps(table, inputs, recurrence)
            total = composed(maps, place, recurrence.combine)
            own = np.flatnonzero(~table.column("carried").to_numpy(zero_copy_only=False))
            if not len(own):
                continue
            rows = table.take(pa.array(own))
            if inputs is None:
                given = pa.FixedSizeListArray.from_arrays(pa.array(total[own].reshape(-1)), recurrence.width).cast(pa.list_(pa.float64()))
                yield from pa.table({"g": rows.column("g"), "i": rows.column("i"), "given": given}).to_batches()
                continue
            before = np.where(place[own, None] > 0, total[np.maximum(own - 1, 0)], np.nan)
            made = recurrence.result(before, total[own], {c: v[own] for c, v in values.items()})
            columns = {c: pa.array(np.asarray(made[c], float), from_pandas=True) for c in outputs}
            yield from pa.table({"row": rows.column("row"), **columns}).to_batches()

    return run


def _blocked(rows: DataFrame, block: int, carries: DataFrame | None) -> DataFrame:
    """Rows of each block together and in order, behind the map that the block takes over."""
    own = rows.withColumn("b", F.floor(F.col("i") / block)).withColumn("carried", F.lit(False)).withColumn("opens", F.col("i") % block == 0)
    if carries is not None:
        own = own.withColumn("opens", F.col("i") == 0)
        taken = carries.select("g", (F.col("i") + 1).alias("b"), "given").withColumn("i", F.col("b") * block - 1).withColumn("carried", F.lit(True)).withColumn("opens", F.lit(True))
        own = own.unionByName(taken, allowMissingColumns=True)
    return own.repartition("g", "b").sortWithinPartitions("g", "b", "i")


def _carried(rows: DataFrame, inputs: Sequence[str] | None, recurrence: Recurrence, top: int, block: int, work: Scratch, level: int) -> DataFrame | None:
    """(g, i, given): what all rows up to the end of block i compose to; none if there is one block."""
    if top < block:
        return None
    columns = ["g", "i", "given", *(inputs or [])]
    key = rows.schema["g"]
    schema = T.StructType([key, T.StructField("i", T.LongType()), T.StructField("given", T.ArrayType(T.DoubleType()))])
    folded = work.save(_blocked(rows.select(columns), block, None).select(*columns, "b", "carried", "opens").mapInArrow(_folder(inputs, recurrence), schema), f"folded_{level}")
    deeper = _carried(folded, None, recurrence, top // block, block, work, level + 1)
    return work.save(_blocked(folded, block, deeper).select("g", "i", "given", "carried", "opens").mapInArrow(_applier(None, recurrence, ()), schema), f"carried_{level}")


def scan(rows: DataFrame, recurrence: Recurrence, inputs: Mapping[str, Column], outputs: Sequence[str], order: Sequence[str], key: str | Sequence[str] | None = None, block: int = BLOCK, keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` (of its columns ``keep``, all if none) with double columns ``outputs`` of a recurrence over the numbers ``inputs``, within each key in ``order``."""
    keep = rows.columns if keep is None else keep
    clash = {c.lower() for c in outputs} & {c.lower() for c in keep}
    if clash or block < 2:
        raise ValueError(f"there are columns {sorted(clash)} already" if clash else "a block has at least two rows")
    work = Scratch(rows.sparkSession, "scan")
    numbers = number_rows(rows.select((F.struct("*") if keep == rows.columns else F.struct(*keep)).alias("row"), key_struct(key).alias("g"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], *[v.cast("double").alias(c) for c, v in inputs.items()]), [f"o{n}" for n in range(len(order))], "g", "i")
    own = work.save(numbers.select("row", "g", "i", F.lit(None).cast("array<double>").alias("given"), *inputs), "rows")
    top = own.agg(F.max("i")).first()[0] or 0
    carries = _carried(own, list(inputs), recurrence, top, block, work, 0)
    schema = T.StructType([own.schema["row"], *[T.StructField(c, T.DoubleType()) for c in outputs]])
    ready = _blocked(own, block, carries).select("row", "g", "i", "given", *inputs, "carried", "opens")
    return ready.mapInArrow(_applier(list(inputs), recurrence, outputs), schema).select("row.*", *outputs)


# ---------------------------------------------------------------- linear filters


def affine(size: int, matrices: Callable[[Mapping[str, np.ndarray]], tuple[np.ndarray, np.ndarray]], result) -> Recurrence:
    """State after a row = A times the state before + b; the first row's A is zero."""

    def element(values: Mapping[str, np.ndarray]) -> np.ndarray:
        a, b = matrices(values)
        return np.concatenate([a.reshape(-1, size * size), b.reshape(-1, size)], axis=1)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : size * size].reshape(-1, size, size), x[:, size * size :]

    def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = split(x), split(y)
        return np.concatenate([(c @ a).reshape(-1, size * size), np.einsum("nij,nj->ni", c, b) + d], axis=1)

    return Recurrence(size * size + size, element, combine, lambda before, now, values: result(split(before)[1], split(now)[1], values))


def _known(rows: DataFrame, value: str, f: Callable[[DataFrame], DataFrame], outputs: Sequence[str]) -> DataFrame:
    done = f(rows.where(F.col(value).isNotNull()))
    return done.unionByName(rows.where(F.col(value).isNull()).select("*", *[F.lit(None).cast("double").alias(c) for c in outputs]))


def first_order_filter(rows: DataFrame, share: float, value: str = "value", key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), name: str = "smoothed", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``smoothed``: ``share`` of the reading and the rest of the result before; it begins as the first reading."""
    if not 0 < share <= 1:
        raise ValueError(f"share {share} is not above 0 and at most 1")

    def matrices(v):
        a = np.where(v["first"], 0.0, 1 - share)
        return a[:, None, None], np.where(v["first"], v["x"], share * v["x"])[:, None]

    recurrence = affine(1, matrices, lambda before, now, v: {name: now[:, 0]})
    return _known(rows, value, lambda own: scan(own, recurrence, {"x": F.col(value)}, [name], order, key, block), [name])


def butterworth(cutoff: float, rate: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a second-order Butterworth low-pass."""
    if not 0 < cutoff < rate / 2:
        raise ValueError(f"cutoff {cutoff} is not between 0 and half of {rate}")
    w = math.tan(math.pi * cutoff / rate)
    n = 1 / (1 + math.sqrt(2) * w + w * w)
    return w * w * n, 2 * w * w * n, w * w * n, 2 * (w * w - 1) * n, (1 - math.sqrt(2) * w + w * w) * n


def low_pass(rows: DataFrame, cutoff: float, rate: float, value: str = "value", key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), name: str = "smoothed", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``smoothed``: a second-order Butterworth low-pass, which begins settled at the first reading.

    The state is the result and two sums that later rows take up, so that no row
    needs its neighbours.
    """
    b0, b1, b2, a1, a2 = butterworth(cutoff, rate)
    step, gain, settled = np.array([[0, 1, 0], [0, -a1, 1], [0, -a2, 0]]), np.array([b0, b1 - a1 * b0, b2 - a2 * b0]), np.array([1, 1 - b0, b2 - a2])

    def matrices(v):
        first = v["first"]
        return np.where(first[:, None, None], 0.0, step), np.where(first[:, None], settled, gain) * v["x"][:, None]

    recurrence = affine(3, matrices, lambda before, now, v: {name: now[:, 0]})
    return _known(rows, value, lambda own: scan(own, recurrence, {"x": F.col(value)}, [name], order, key, block), [name])


# ----------------------------------------------------------------------- Kalman


def kalman_recurrence(noise: float, start: tuple[float, float]) -> Recurrence:
    """Height and velocity with covariance.

    A row's map has, beside the state and covariance that follow from any state
    before, what the row's reading says of that state (vector and matrix of
    information), so that two maps compose exactly.  Readings: z, dt and q, the
    spectral density of the acceleration.
    """

    def element(v):
        z, dt, q, first = v["z"], v["dt"], v["q"], v["first"]
        n, seen = len(z), ~np.isnan(z)
        f = np.zeros((n, 2, 2))
        f[:, 0, 0] = f[:, 1, 1] = 1
        f[:, 0, 1] = dt
        p = np.empty((n, 2, 2))
        p[:, 0, 0], p[:, 1, 1] = q * dt**4 / 4, q * dt**2
        p[:, 0, 1] = p[:, 1, 0] = q * dt**3 / 2
        s = p[:, 0, 0] + noise
        gain = np.where(seen[:, None], p[:, :, 0] / s[:, None], 0.0)
        keep = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        keep[:, :, 0] -= gain
        h = f[:, 0, :]  # what the reading sees of the state before
        reading = np.where(seen, z, 0.0)
        a, b, c = keep @ f, gain * reading[:, None], keep @ p
        eta = np.where(seen[:, None], h * (reading / s)[:, None], 0.0)
        j = np.where(seen[:, None, None], h[:, :, None] * h[:, None, :] / s[:, None, None], 0.0)
        a[first], eta[first], j[first] = 0, 0, 0
        b[first] = np.stack([z, np.zeros(n)], axis=1)[first]
        c[first] = np.diag(start)
        return _joined(a, b, c, eta, j)

    def combine(x, y):
        (a, b, c, e, j), (a2, b2, c2, e2, j2) = _parts(x), _parts(y)
        one = np.eye(2)
        left = a2 @ np.linalg.inv(one + c @ j2)
        right = np.swapaxes(a, 1, 2) @ np.linalg.inv(one + j2 @ c)
        times = lambda m, v: np.einsum("nij,nj->ni", m, v)
        return _joined(left @ a, times(left, b + times(c, e2)) + b2, left @ c @ np.swapaxes(a2, 1, 2) + c2, times(right, e2 - times(j2, b)) + e, right @ j2 @ a + j)

    def result(before, now, v):
        (_, old, _, _, _), (_, state, spread, _, _) = _parts(before), _parts(now)
        ahead = np.where(v["first"], np.nan, v["z"] - (old[:, 0] + v["dt"] * old[:, 1]))
        return {"height": state[:, 0], "velocity": state[:, 1], "height_var": spread[:, 0, 0], "innovation": ahead}

    return Recurrence(16, element, combine, result)


def _joined(a, b, c, e, j) -> np.ndarray:
    return np.concatenate([a.reshape(-1, 4), b, c.reshape(-1, 4), e, j.reshape(-1, 4)], axis=1)


def _parts(x: np.ndarray) -> tuple[np.ndarray, ...]:
    return x[:, :4].reshape(-1, 2, 2), x[:, 4:6], x[:, 6:10].reshape(-1, 2, 2), x[:, 10:12], x[:, 12:].reshape(-1, 2, 2)


def height_kalman(rows: DataFrame, acceleration: float, noise: float, dt: Column, value: str = "value", key: str | Sequence[str] = "user_id", order: Sequence[str] = ("ts", "event_id"), start: tuple[float, float] = (1.0, 1.0), factor: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``rows`` with height, velocity, height_var and innovation of a constant-velocity Kalman filter.

    ``acceleration`` is the standard deviation of what disturbs the velocity,
    ``noise`` the variance of a reading, ``dt`` the seconds since the row before,
    ``start`` the variances of the first state, which is the first reading at
    rest.  The covariance after a reading is (I - KH) P (I - KH)' + K R K', which
    for this gain is (I - KH) P.  A null reading is predicted over and has no
    innovation; if the first is null, all results are null.
    """
    factor = F.lit(1.0) if factor is None else factor
    inputs = {"z": F.col(value), "dt": dt, "q": factor * acceleration**2}
    return scan(rows, kalman_recurrence(noise, start), inputs, ["height", "velocity", "height_var", "innovation"], order, key, block)


def swept(recurrence: Recurrence, name: str, values: Sequence[float], output: str) -> Recurrence:
    """The recurrence once for each value of its input ``name``, side by side; results are ``output_0``, ``output_1``, ..."""
    k, width = len(values), recurrence.width

    def given(v: Mapping[str, np.ndarray], value: float) -> dict[str, np.ndarray]:
        return {**v, name: np.full(len(v["first"]), value)}

    def result(before, now, v):
        parts = [slice(n * width, (n + 1) * width) for n in range(k)]
        return {f"{output}_{n}": recurrence.result(before[:, p], now[:, p], given(v, values[n]))[output] for n, p in enumerate(parts)}

    return Recurrence(
        k * width,
        lambda v: np.concatenate([recurrence.element(given(v, x)) for x in values], axis=1),
        lambda x, y: recurrence.combine(x.reshape(-1, width), y.reshape(-1, width)).reshape(-1, k * width),
        result,
    )


def noise_sweep(rows: DataFrame, factors: Sequence[float], acceleration: float, noise: float, dt: Column, bound: float, value: str = "value", key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), block: int = BLOCK) -> DataFrame:
    """(key, factor, n, rms_innovation, diverged): the Kalman filter of each key with each multiple of its process noise.

    A run has diverged if the root mean square of its innovations is above
    ``bound`` or no number.
    """
    own = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("z"), dt.cast("double").alias("dt"))
    # A row is numbered and dealt once; the filters of all factors run over it together.
    filters = swept(kalman_recurrence(noise, (1.0, 1.0)), "q", [float(f) * acceleration**2 for f in factors], "innovation")
    names = [f"innovation_{n}" for n in range(len(factors))]
    run = scan(own, filters, {"z": F.col("z"), "dt": F.col("dt")}, names, [f"o{i}" for i in range(len(order))], "key", block, ["key"])
    runs = [F.struct(F.lit(float(f)).alias("factor"), F.count(c).alias("n"), F.sqrt(F.avg(F.col(c) * F.col(c))).alias("rms_innovation")) for f, c in zip(factors, names, strict=True)]
    out = run.groupBy("key").agg(F.array(*runs).alias("runs")).select(F.col("key").alias(key), F.explode("runs").alias("run")).select(key, "run.*")
    return out.withColumn("diverged", (F.col("n") > 0) & ~F.coalesce(F.col("rms_innovation") <= bound, F.lit(False)))


# ----------------------------------------------------------------------- Mahony


def _turn(q: tuple[float, ...], v: tuple[float, float, float]) -> tuple[float, float, float]:
    """A vector of the world as the body sees it."""
    w, x, y, z = q
    a, b, c = v
    return (
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y + w * z) * b + 2 * (x * z - w * y) * c,
        2 * (x * y - w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z + w * x) * c,
        2 * (x * z + w * y) * a + 2 * (y * z - w * x) * b + (1 - 2 * (x * x + y * y)) * c,
    )


def _cross(a: tuple, b: tuple) -> tuple[float, float, float]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def mahony_step(q: tuple, bias: tuple, gyro: tuple, accel: tuple, field: tuple | None, dt: float, kp: float, ki: float) -> tuple[tuple, tuple]:
    """Attitude and bias after one reading; rates are radians a second."""
    error = (0.0, 0.0, 0.0)
    size = math.sqrt(sum(a * a for a in accel))
    if size > 0:
        error = _cross(tuple(a / size for a in accel), _turn(q, (0.0, 0.0, 1.0)))
    if field is not None and (strength := math.sqrt(sum(m * m for m in field))) > 0:
        seen = tuple(m / strength for m in field)
        east, north, up = _turn((q[0], -q[1], -q[2], -q[3]), seen)
        error = tuple(e + c for e, c in zip(error, _cross(seen, _turn(q, (math.hypot(east, north), 0.0, up))), strict=True))
    bias = tuple(b - ki * e * dt for b, e in zip(bias, error, strict=True))
    x, y, z = ((g - b + kp * e) * dt / 2 for g, b, e in zip(gyro, bias, error, strict=True))
    a, b, c, d = q
    new = (a - b * x - c * y - d * z, b + a * x + c * z - d * y, c + a * y - b * z + d * x, d + a * z + b * y - c * x)
    norm = math.sqrt(sum(v * v for v in new))
    return tuple(v / norm for v in new), bias


def _mahony(kp: float, ki: float, names: Sequence[str], outputs: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, bias = object(), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
        for batch in batches:
            keys, columns, out = batch.column("shown").to_pylist(), [batch.column(c).to_pylist() for c in names], []
            for at, values in zip(keys, zip(*columns, strict=True), strict=True):
                if at != own:
                    own, q, bias = at, (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
                if None in values[:7]:
                    out.append((None,) * 7)
                    continue
                field = values[7:] if len(values) == 10 and None not in values[7:] else None
                q, bias = mahony_step(q, bias, values[:3], values[3:6], field, values[6], kp, ki)
                out.append((*q, *bias))
            made = {c: pa.array(v, pa.float64()) for c, v in zip(outputs, zip(*out, strict=True), strict=True)} if out else {c: pa.array([], pa.float64()) for c in outputs}
            yield from pa.table({"row": batch.column("row"), **made}).to_batches()

    return run


def mahony(rows: DataFrame, gyro: Sequence[str], accel: Sequence[str], dt: str, field: Sequence[str] = (), kp: float = 1.0, ki: float = 0.1, key: str = "user_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """``rows`` with the attitude qw, qx, qy, qz and the bias bx, by, bz of a Mahony filter.

    It starts level without bias.  The error is the cross product of the measured
    and the predicted direction of gravity, and of the field if it is given,
    which turns the prediction to the measurement; the bias falls by ``ki`` error
    dt, the rate is gyro - bias + ``kp`` error, and the quaternion, turned by half
    rate dt to first order, has norm one again.  A direction of length zero, or a
    null field, gives no error; a row with any other null is passed over.
    """
    outputs, names = ["qw", "qx", "qy", "qz", "bx", "by", "bz"], [f"v{i}" for i in range(7 + len(field))]
    clash = {c.lower() for c in rows.columns} & set(outputs)
    if clash or len(field) not in (0, 3):
        raise ValueError(f"there are columns {sorted(clash)} already" if clash else "a field has three components")
    own = rows.select(F.struct("*").alias("row"), key_struct(key).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(n) for c, n in zip([*gyro, *accel, dt, *field], names, strict=True)])
    placed = own.repartition("g").sortWithinPartitions("g", *[f"o{i}" for i in range(len(order))]).select("row", F.to_json(F.struct("g")).alias("shown"), *names)
    schema = T.StructType([own.schema["row"], *[T.StructField(c, T.DoubleType()) for c in outputs]])
    return placed.mapInArrow(_mahony(kp, ki, names, outputs), schema).select("row.*", *outputs)
