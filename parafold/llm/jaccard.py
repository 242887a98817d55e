"""N-gram Jaccard join: MinHash banding, then the full n-gram sets.

Documents with equal n-gram sets are one class, and classes are joined through
their representatives.  ``choose_bands`` picks bands and rows for the recall
wanted at the threshold.  Classes are shuffled on band hashes; a bucket that
holds the same classes as another is dropped, and one with many classes is
dealt over tiles, pairs of its parts, so that no task holds it whole.  A tile
verifies its pairs on the full sets by products of 0/1 matrices.  It returns a
count of links and one edge to a root for each class, never the pairs; a pair
counts only in the least of the buckets that both classes share.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Defined results.  A text of fewer
words than an n-gram has one gram of all its words, so only its copies match
it.  A text without words, or null, matches nothing but is kept.  A null id has
no class.  Repeated rows are copies.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .components import components
from .textsql import row_key
from .words import byte_buffers, split_words, text_slices

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Classes of one part of a bucket; a tile holds two parts.
PART = 256
#: Distinct grams of one matrix product.
BLOCK = 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CLASSES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_SETS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("grams", T.BinaryType())])
_FOUND = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows of them: the most rows that give ``recall`` at ``threshold``.

    A recall that ``most`` hashes cannot give is an error.
    """
    for rows in range(most, 0, -1):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands:
            return bands, rows
    raise ValueError(f"{most} hashes do not give recall {recall} at {threshold}")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit keys of the n-grams of each text."""
    tokens, at = split_words(*byte_buffers(texts))
    coded = tokens.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    keys = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            size = min(words, b - a)
            if not size:
                out.append(np.zeros(0, np.uint64))
                continue
            gram = np.full(b - a - size + 1, np.uint64(size))
            for k in range(size):
                gram = _mix(gram * _MULTIPLIER + keys[a + k : b - size + k + 1])
            out.append(np.unique(gram))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes of each set, none of which is empty: the least folded gram by seed, mixed by band."""
    if not sets:
        return np.zeros((0, bands), np.int64)
    grams = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MULTIPLIER).reshape(bands, rows)
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sets), 0)
    x, y = np.empty_like(grams), np.empty_like(grams)
    with np.errstate(over="ignore"):
        for r in range(rows):
            for b in range(bands):
                np.bitwise_xor(grams, seeds[b, r], out=x)
                np.multiply(x, np.uint64(0xFF51AFD7ED558CCD), out=x)
                np.right_shift(x, np.uint64(32), out=y)
                np.bitwise_xor(x, y, out=x)
                out[:, b] = _mix(out[:, b] * _MULTIPLIER + np.minimum.reduceat(x, starts))
    return out.view(np.int64)


def _classes(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = gram_sets(batch.column("text"), words)
            digests = [xxhash.xxh3_128_hexdigest(g.tobytes()) if len(g) else None for g in sets]
            found = iter(band_hashes([g for g in sets if len(g)], bands, rows))
            hashes = [next(found) if len(g) else [] for g in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=_CLASSES.names)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = [(rep, g.tobytes()) for rep, digest, g in zip(batch.column("rep").to_pylist(), batch.column("digest").to_pylist(), gram_sets(batch.column("text"), words), strict=True) if xxhash.xxh3_128_hexdigest(g.tobytes()) == digest]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=_SETS.names)

    return run


def shared_grams(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two of ``sets`` share: sums of 0/1 matrix products."""
    m = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    sizes = np.diff(np.append(starts, len(every)))
    column = np.repeat(np.cumsum(sizes > 1) - 1, sizes)
    kept = np.repeat(sizes > 1, sizes)
    owner, column = owner[kept], column[kept]
    out = np.zeros((m, m), np.float64)
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + BLOCK, BLOCK))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            block = np.zeros((m, BLOCK), np.float32)
            block[owner[a:b], column[a:b] - i * BLOCK] = 1
            out += block @ block.T
    return out


def verify(bucket: int, part: np.ndarray, split: bool, reps: np.ndarray, buckets: list[np.ndarray], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int, int]]:
    """Links and a root of each class of one tile of a bucket."""
    m = len(reps)
    sizes = np.array([len(s) for s in sets], float)
    common = shared_grams(sets)
    near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    if split:  # a tile of two parts compares one with the other
        near &= part[:, None] != part[None, :]
    if not near.any():
        return []
    earlier = [b[b < bucket] for b in buckets]
    seen = shared_grams(earlier) > 0 if any(len(b) for b in earlier) else np.zeros((m, m), bool)
    links = (near & ~seen).sum(1)
    root = reps.copy()
    while True:
        low = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            break
        root = low
    return [(int(r), int(n), int(t)) for r, n, t, k in zip(reps, links, root, near.any(1), strict=True) if k]


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            found = []
            if len(rows) > 1:
                h, p, q = now
                found = verify(h, np.array([r[0] for r in rows]), p != q, np.array([r[1] for r in rows], np.int64), [np.array(r[2], np.int64) for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows], threshold)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=_FOUND.names)

        for batch in batches:
            for h, p, q, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "p", "q", "part", "rep", "buckets", "grams")), strict=True):
                if (h, p, q) != now:
                    if rows:
                        yield done()
                    now, rows = (h, p, q), []
                rows.append(row)
        if rows:
            yield done()

    return run


def near_copies(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_copies, n_links.

    ``copy_of`` is the least id among documents with equal n-gram sets, their
    number is ``n_copies``; ``n_links`` is the number of other such classes at
    the threshold or above, and ``class_id`` the least id of all that links
    connect.
    """
    work = Scratch(docs.sparkSession, "jaccard")
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = work.save(texts.mapInArrow(_classes(words, bands, rows), _CLASSES), "classes")
    known = classes.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = work.save(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")), "reps")
    # Buckets of two classes or more, one of those that hold the same classes.
    exploded = reps.select("rep", F.explode("bands").alias("h"))
    counted = exploded.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sign"), F.min("rep").alias("low")).where("m > 1")
    buckets = work.save(counted.groupBy("m", "sign", "low").agg(F.min("h").alias("h")).select("h", "m"), "buckets")
    members = work.save(exploded.join(buckets, "h"), "members")
    own = members.groupBy("rep").agg(F.array_sort(F.collect_set("h")).alias("buckets"))
    wanted = reps.select("rep", "digest").join(own.select("rep"), "rep", "left_semi")
    sets = texts.join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "digest", "text").mapInArrow(_sets(words), _SETS)
    sets = work.save(sets.dropDuplicates(["rep"]).join(own, "rep"), "sets")
    parts = F.ceil(F.col("m") / PART).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("rep", "h"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("h", "rep", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    tiles = dealt.join(sets, "rep").repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")
    found = work.save(tiles.mapInArrow(_tiles(threshold), _FOUND), "found")
    work.drop("sets", "members", "buckets")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), work).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    joined = reps.select("digest", "rep", "n_copies").join(links, "rep", "left").join(roots, "rep", "left")
    joined = work.save(joined.select("digest", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("copy_of"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "joined")
    ids = classes.select("doc_id", "digest")
    out = ids.join(joined, "digest", "left")
    alone = F.col("copy_of").isNull()
    return out.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")).alias("copy_of"),
        F.when(alone, 1).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of the least id of each class of near copies.

    Rows that repeat id and text are one document, of which one row stays.  Rows
    of one id with different texts are documents of their own; they, and rows
    without an id, come after all others and are ordered by a hash of the row.
    Null and blank texts match nothing and stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), "text", row_key().alias("key"))
    ids = rows.select("id", "key").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    shared = ids.where("n > 1 AND id IS NOT NULL").select(F.col("id").alias("shared"))
    own = F.when(F.col("shared").isNull(), F.col("id"))
    last = F.lit((1 << 63) - 1) - F.shiftrightunsigned(F.xxhash64("key"), 2)
    rows = rows.join(shared, F.col("id") == F.col("shared"), "left").select("row", "text", F.coalesce(own, last).alias("doc_id"))
    kept = near_copies(rows).where("doc_id = class_id").select("class_id").distinct()
    left = rows.join(kept, F.col("doc_id") == F.col("class_id"), "left_semi").dropDuplicates(["doc_id"])
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
