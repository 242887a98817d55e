"""Exact k-means on integer vectors by exponion search.

Vectors become integers once and are held in blocks: ids, components, cluster,
and the two bounds of each vector, an upper one on its distance to its centroid
and a lower one on that to any other.  A round is a pass of tasks over blocks.
A vector whose upper bound is below the lower one, or below half the way to the
nearest other centroid, keeps its cluster unseen.  Any other gets its exact
distance, and, if that does not settle it, looks only at centroids in a ball
around its own of radius twice that distance plus the way to the nearest other
centroid.  Such a ball is a start of the list of centroids sorted by their
distance from this one, read in steps of doubled size; its radius is inclusive,
so that ties within are seen and the smaller number wins.

Blocks are never shuffled: tasks add up sums of their vectors by cluster, Spark
adds the sums of tasks by cluster and component, and the driver gets ``k`` times
the number of components, whatever the input.  Each round is a written table,
from which the next one starts again if executors are lost.

Distances are exact integers.  Bounds are doubles; where they are compared, a
relative ``SLACK`` far above their rounding decides for looking.

Defined results.  Vectors with another number of components, a null, or a
component that is not finite are left out, null vectors too.  Rows that repeat
are vectors of their own.  A null vec_id is kept, its decimal is empty.  Of equal
hashes that of the smaller vector is first.  With fewer vectors than ``k`` there
are as many centroids as vectors, and an empty table gives an empty result.  A
component beyond 2**20 is an error, as squared distances would not be exact.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors of one block.
BLOCK = 4096
#: Largest component, so that sums of squares of differences are exact in a double.
LARGEST = 1 << 20
#: Share of a bound that rounding never reaches.
SLACK = 1e-9

_BLOCKS = "n int, vec_id binary, known binary, vectors binary, cluster binary, upper binary, lower binary, sums binary, looked long"


def _block(ids: np.ndarray, known: np.ndarray, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, sums: np.ndarray, looked: int) -> pa.RecordBatch:
    values = [len(ids), ids.tobytes(), known.tobytes(), x.astype(np.int32).tobytes(), a.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), sums.tobytes(), looked]
    types = [pa.int32(), *[pa.binary()] * 7, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["n", "vec_id", "known", "vectors", "cluster", "upper", "lower", "sums", "looked"])


def _packer(size: int, scale: int):
    """Blocks of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            fit = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False)
            ids, lists = batch.column("vec_id").filter(fit), lists.filter(fit)
            flat = lists.flatten()
            x = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
            good = np.isfinite(x).all(axis=1)
            whole = np.floor(scale * x[good])
            if (np.abs(whole) > LARGEST).any():
                raise ValueError(f"a component is beyond {LARGEST} / {scale}")
            ids = ids.filter(pa.array(good))
            known = np.asarray(pc.is_valid(ids).to_numpy(zero_copy_only=False), bool)
            numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(numbers), BLOCK):
                part = slice(at, at + BLOCK)
                n = len(numbers[part])
                yield _block(numbers[part], known[part], whole[part], np.full(n, -1), np.full(n, np.inf), np.zeros(n), np.zeros(0), 0)

    return run


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` from those of ``c``; every sum is an integer below 2**53."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


class Centroids:
    """Centroids, the lists of those around each, and how far each went in the last round."""

    def __init__(self, at: np.ndarray, moved: np.ndarray):
        self.at, self.moved = at, moved
        self.most_moved = float(moved.max()) if len(moved) else 0.0
        between = np.sqrt(_squares(at, at)) if len(at) else np.zeros((0, 0))
        #: Numbers of all centroids by their distance from each; each list begins with the centroid itself.
        self.order = np.array([np.lexsort((np.arange(len(at)), row, np.arange(len(at)) != i)) for i, row in enumerate(between)], int).reshape(between.shape)
        self.distances = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.distances[:, 1] if len(at) > 1 else np.full(len(at), np.inf)


def _all(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and bounds by all distances, for vectors that have none yet."""
    far = _squares(x, c.at)
    a = far.argmin(axis=1)  # of equal ones the first
    best = far[np.arange(len(x)), a]
    far[np.arange(len(x)), a] = np.inf
    return a, np.sqrt(best), np.sqrt(far.min(axis=1)) if len(c.at) > 1 else np.full(len(x), np.inf)


def search(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds of vectors, and how many distances to other centroids were taken."""
    if len(a) and a[0] < 0:
        return *_all(x, c), len(x) * len(c.at)
    a, k = a.copy(), len(c.at)
    upper, lower = upper + c.moved[a], np.maximum(lower - c.most_moved, 0)
    settled = lambda: upper * (1 + SLACK) < np.maximum(lower, c.nearest[a] / 2) * (1 - SLACK)
    open_ = np.flatnonzero(~settled())
    d = x[open_] - c.at[a[open_]]
    upper[open_] = np.sqrt((d * d).sum(axis=1))
    open_ = open_[~settled()[open_]]
    if not len(open_) or k < 2:
        return a, upper, lower, 0
    radius = (2 * upper[open_] + c.nearest[a[open_]]) * (1 + SLACK)
    inside = np.array([np.searchsorted(c.distances[i], r, "right") for i, r in zip(a[open_], radius, strict=True)])
    steps = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(int), k)
    looked = 0
    own, group = a[open_], a[open_] * (k + 1) + steps
    for g in np.unique(group):
        which = np.flatnonzero(group == g)
        at, near = open_[which], np.sort(c.order[own[which[0]], : steps[which[0]]])
        far = _squares(x[at], c.at[near])
        looked += far.size
        first = far.argmin(axis=1)  # numbers ascend, so that of equal ones the smallest is first
        line = np.arange(len(at))
        a[at], upper[at] = near[first], np.sqrt(far[line, first])
        far[line, first] = np.inf
        # Beyond the ball no centroid is nearer than the second within it.
        lower[at] = np.sqrt(far.min(axis=1))
    return a, upper, lower, looked


def _unpack(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    kinds = {"vec_id": np.int64, "known": bool, "vectors": np.int32, "cluster": np.int32, "upper": float, "lower": float}
    for row in zip(*(batch.column(c).to_pylist() for c in kinds), strict=True):
        ids, known, x, a, upper, lower = (np.frombuffer(v, t) for v, t in zip(row, kinds.values(), strict=True))
        yield ids, known, x.reshape(-1, size).astype(float), a, upper, lower


def _assigner(centroids: Broadcast, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            for ids, known, x, a, upper, lower in _unpack(batch, size):
                a, upper, lower, looked = search(x, a, upper, lower, c)
                member = (a[:, None] == np.arange(len(c.at))[None, :]).astype(float)
                d = x - c.at[a]
                # Counts, sums of components and sums of squared distances of each cluster.
                inertia = member.T.astype(np.int64) @ (d * d).sum(axis=1).astype(np.int64)
                sums = np.concatenate([member.sum(axis=0)[:, None], member.T @ x], axis=1).astype(np.int64)
                yield _block(ids, known, x, a, upper, lower, np.concatenate([sums, inertia[:, None]], axis=1), looked)

    return run


def _adder(k: int, width: int):
    """The sums of all blocks of a task, a row for each cluster and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * width, np.int64)
        seen = False
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                total += np.frombuffer(raw, np.int64)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * width), pa.int32()), pa.array(total)], names=["cell", "total"])

    return run


def _sums(blocks: DataFrame, k: int, width: int) -> list[list[int]]:
    rows = blocks.select("sums").mapInArrow(_adder(k, width), "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    out = [[0] * width for _ in range(k)]
    for r in rows:
        out[r["cell"] // width][r["cell"] % width] = r["total"]
    return out


def seeds(vectors: DataFrame, k: int, seed: int, size: int, scale: int) -> np.ndarray:
    """The ``k`` kept vectors with the least hashes of seed and id, in that order."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.coalesce((F.size("embedding") == size) & finite, F.lit(False)))
    whole = F.transform("embedding", lambda v: F.floor(scale * v.cast("double")))
    named = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("hash"), whole.alias("vector"))
    first = named.orderBy("hash", "vector").limit(k).collect()  # a top-k of each task
    return np.array([r["vector"] for r in first], float).reshape(-1, size)


def _rows(stats: Broadcast, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, spread, total, marks = stats.value
        for batch in batches:
            for ids, known, x, a, _, _ in _unpack(batch, size):
                d = x - c.at[a]
                columns = [
                    pa.array(ids, pa.int64(), mask=~known),
                    pa.array(a, pa.int32()),
                    pa.array((d * d).sum(axis=1).astype(np.int64)),
                    pa.array([spread[i] for i in a.tolist()], pa.int64()),
                    pa.array([total] * len(a), pa.int64()),
                    pa.array([marks[i] for i in a.tolist()], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of (vec_id, embedding)."""
    spark = vectors.sparkSession
    work = Scratch(spark, "centroids")
    at = seeds(vectors, k, seed, size, scale)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    blocks = work.save(own.mapInArrow(_packer(size, scale), _BLOCKS), "blocks", arrow_rows=str(BLOCK))
    k, moved, before = len(at), np.zeros(len(at)), "blocks"
    for step in range(rounds + 1):
        c = Centroids(at, moved)
        # A block is a row of about a megabyte.
        blocks = work.save(blocks.mapInArrow(_assigner(spark.sparkContext.broadcast(c), size), _BLOCKS), f"round_{step}", arrow_rows="4")
        work.drop(before)
        before = f"round_{step}"
        sums = _sums(blocks, k, size + 2)
        if step < rounds:
            new = np.array([[s // row[0] for s in row[1:-1]] if row[0] else old.tolist() for row, old in zip(sums, at, strict=True)], float).reshape(-1, size)
            moved, at = np.sqrt(((new - at) ** 2).sum(axis=1)), new
    spread = [row[-1] for row in sums] if k else []
    marks = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in at]
    stats = spark.sparkContext.broadcast((c, spread, sum(spread), marks))
    return blocks.mapInArrow(_rows(stats, size), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    parts = [
        f"e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {SIZE})",
        f"x AS MATERIALIZED (SELECT r, vec_id, list_transform(v, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM e WHERE len(list_filter(v, lambda x: isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT x.r, c.c, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{i} c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"u{i} AS (SELECT a.c, generate_subscripts(x.v, 1) AS i, unnest(x.v) AS s FROM a{i} a JOIN x USING (r))")
            parts.append(f"m{i} AS (SELECT c, i, CAST(floor(sum(s) / count(*)) AS BIGINT) AS s FROM u{i} GROUP BY c, i)")
            parts.append(f"n{i} AS (SELECT c, list(s ORDER BY i) AS v FROM m{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN n{i} n USING (c))")
    return f"""WITH {', '.join(parts)}
SELECT x.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN x USING (r) JOIN c{rounds} c ON c.c = a.c"""


OP13_SQL = _sql()


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
