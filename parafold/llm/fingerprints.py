"""Document fingerprints: SimHash of whole texts, and permuted block tables that find near ones.

Terms are single words and pairs of words `[^\\x20\\x09-\\x0D]+`, unchanged.  A
term that occurs n times weighs 1 + floor(log2 n), 15 at most, and votes with
that weight on each of 256 signed bits by its hash; a bit is set where the votes
for it are more than half.  Likeness of two fingerprints is the share of bits
that agree: about 1 - angle / pi of the weighted term vectors, so that unlike
texts have about 0.5.

``neighbours`` cuts fingerprints into blocks, two more than the radius.  Two that
differ in no more bits than the radius agree in two whole blocks at least, so
that a table for each pair of blocks, keyed by both, has all of them in one key.
Equal fingerprints are one class there; a pair is verified on all bits and
counts in the first table that has it.

``fingerprint_edits`` deals documents by ranges of doc_id, so that neighbours in
that order meet in one task as they stream by.  Only the first and last text of
each range is kept for the neighbours across ranges.

Defined results.  Null texts are empty; a text without words has no set bit.
Rows without an id come last; of equal ids the order is by a hash of the text,
and rows that repeat are documents of their own.  A single row is its own next
document.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .words import array_slices, byte_buffers, split_words, text_slices

BITS, LONGEST_RUN, HEAVIEST = 256, 2, 15
#: Bits by which fingerprints that ``neighbours`` links may differ.
RADIUS = 6
#: Terms of heaviest weight whose votes fit a counter of eight bits.
TOGETHER = 255 // HEAVIEST
#: Terms whose votes are spread out at a time.
CHUNK = 1 << 14
#: Documents whose terms are sorted together.
DOCS = 1 << 15
#: Documents that are searched for: each whose id this divides.
QUERIES = 50

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Eight counters of eight bits for each byte: the bits of the byte, first bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, key and weight of each distinct term of each text, in order of documents.

    A key has 48 bits, so that it fits beside the document in one number to be
    sorted by.
    """
    words, at = split_words(*byte_buffers(texts))
    coded = words.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    keys = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), np.diff(at))
    run, found = np.zeros(len(keys), np.uint64), []
    for size in range(min(LONGEST_RUN, len(keys))):
        end = len(keys) - size
        run = _mix(run[:end] * _STEP + keys[size:] + np.uint64(size + 1))
        term = doc[:end] | (run >> np.uint64(16))
        found.append(term[doc[:end] == doc[size:]] if size else term)
    both = np.sort(np.concatenate(found)) if found else run
    fresh = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
    weight = np.minimum(1 + np.log2(np.diff(np.append(fresh, len(both)))).astype(np.uint64), HEAVIEST)
    both = both[fresh]
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1), weight


def simhash(texts: pa.Array) -> np.ndarray:
    """Fingerprints of texts, 32 bytes each."""
    out, done = np.zeros((len(texts), BITS // 8), np.uint8), 0
    for part in array_slices(texts):
        for at in range(0, len(part), DOCS):
            own = part.slice(at, DOCS)
            with np.errstate(over="ignore"):
                out[done : done + len(own)] = _simhash(own)
            done += len(own)
    return out


def _simhash(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    doc, term, weight = _terms(texts)
    votes = np.zeros((n, BITS), np.int64)
    for at in range(0, len(doc), CHUNK):
        own, w = doc[at : at + CHUNK], weight[at : at + CHUNK]
        hashes = np.stack([_mix(term[at : at + CHUNK] + np.uint64(i + 1) * _STEP) for i in range(BITS // 64)], axis=1)
        spread = _SPREAD[hashes.view(np.uint8)]
        heavy = np.flatnonzero(w > 1)
        spread[heavy] *= w[heavy, None]
        # Sums of a few terms of one document fit eight bits; those of a document do not.
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        nth = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        cut = np.flatnonzero(nth % TOGETHER == 0)
        small = np.add.reduceat(spread, cut, axis=0).view(np.uint8)
        whose = own[cut]
        edge = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        votes[whose[edge]] += np.add.reduceat(small, edge, axis=0, dtype=np.int32)
    total = np.bincount(doc, weight.astype(float), n).astype(np.int64)
    return np.packbits(2 * votes > total[:, None], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bits in which fingerprints agree."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


_ROWS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, first boolean, last boolean, text string"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _edits(texts: list[str], marks: np.ndarray, others: list[str], other_marks: np.ndarray) -> tuple[list, list, list, list]:
    """Digests and fingerprints of the edited texts, and both likenesses."""
    made = [edited(a, b) for a, b in zip(texts, others, strict=True)]
    new = simhash(pa.array(made, pa.large_string()))
    return [hashlib.sha256(x.encode()).digest() for x in made], [x.tobytes() for x in new], likeness(marks, new).tolist(), likeness(marks, other_marks).tolist()


def _neighbours_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, pending = TaskContext.get().partitionId(), None
    for batch in text_slices(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        marks = simhash(pa.array(texts, pa.large_string()))
        opens = pending is None
        if pending:
            ids, texts, marks = [pending[0], *ids], [pending[1], *texts], np.concatenate([pending[2], marks])
        n = len(ids) - 1
        if n or opens:
            first = [(opens or pending[3]) and i == 0 for i in range(n)]
            columns = [ids[:n], [len(t) for t in texts[:n]], *_edits(texts[:n], marks[:n], texts[1:], marks[1:])]
            sha, new, near, near_next = columns[2:]
            yield _batch([*columns[:2], sha, [m.tobytes() for m in marks[:n]], new, near, near_next, [part] * n, first, [False] * n, [t if f else None for t, f in zip(texts, first, strict=False)]])
        pending = (ids[n], texts[n], marks[n:], n == 0 and (opens or pending[3]))
    if pending:
        yield _batch([[pending[0]], [len(pending[1])], [None], [pending[2][0].tobytes()], [None], [None], [None], [part], [pending[3]], [True], [pending[1]]])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of ranges, each beside the first of the next range."""
    for batch in text_slices(batches):
        texts, others = batch.column("text").to_pylist(), batch.column("other").to_pylist()
        marks, other_marks = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("fingerprint", "other_fingerprint"))
        sha, new, near, near_next = _edits(texts, marks, others, other_marks)
        n = len(texts)
        yield _batch([batch.column("doc_id").to_pylist(), [len(t) for t in texts], sha, [m.tobytes() for m in marks], new, near, near_next, [None] * n, [None] * n, [None] * n, [None] * n])


def fingerprint_edits(docs: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row; digests and fingerprints are binary.

    Documents stand in descending order of doc_id; after the last comes the first.
    """
    spark = docs.sparkSession
    work = work or Scratch(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    # Rows of one id and text are alike: their place beside each other may spread them over ranges.
    ranged = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    done = work.save(ranged.mapInArrow(_neighbours_in_task, _ROWS), "ranges")
    edge = done.where("first OR last")
    parts = sorted(r["part"] for r in done.where("last").select("part").collect())  # one of each range
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    firsts = edge.where("first").select(F.col("part").alias("next"), F.col("text").alias("other"), F.col("fingerprint").alias("other_fingerprint"))
    ends = edge.where("last").select("doc_id", "text", "fingerprint", "part").join(F.broadcast(pairs), "part").join(firsts, "next")
    across = ends.select("doc_id", "text", "fingerprint", "other", "other_fingerprint").mapInArrow(_across, _ROWS)
    return done.where("NOT last").unionByName(across).drop("part", "first", "last", "text")


# -------------------------------------------------------- permuted block tables


def _blocks(mark: Column, radius: int) -> list[Column]:
    """The bytes of a fingerprint in ``radius + 2`` blocks, whose sizes differ by one at most."""
    n, size = radius + 2, BITS // 8
    bounds = [i * size // n for i in range(n + 1)]
    return [F.substring(mark, a + 1, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def block_keys(mark: Column, radius: int) -> Column:
    """A 64-bit key for each pair of blocks: the table and the bytes of both."""
    blocks = _blocks(mark, radius)
    return F.array(*[F.xxhash64(F.lit(t), a, b) for t, (a, b) in enumerate(combinations(blocks, 2))])


def _words64(mark: str) -> list[Column]:
    return [F.conv(F.hex(F.substring(F.col(mark), 8 * i + 1, 8)), 16, -10).cast("long") for i in range(BITS // 64)]


def neighbours(marks: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, found, distance): every distinct ``fingerprint`` of ``marks`` within ``radius`` bits of one of ``queries``.

    Both are tables of binary fingerprints; nulls match nothing.  Copies are one
    row, so that the result has pairs of different fingerprints and each query
    itself, if ``marks`` has it.
    """
    if not 0 <= radius <= BITS // 8 - 2:
        raise ValueError(f"radius {radius} leaves no whole bytes for blocks")

    def table(rows: DataFrame, name: str) -> DataFrame:
        own = rows.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct()
        return own.select(name, F.explode(block_keys(F.col(name), radius)).alias("key"))

    # Rows that are shuffled have a key and a fingerprint; what they share is found where they meet.
    # Queries are a share of the rows: sent whole to each executor, they would grow with the input.
    joined = table(queries, "query").join(table(marks, "found").hint("merge"), "key")
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_words64("query"), _words64("found"), strict=True)), F.lit(0))
    near = joined.select("key", "query", "found", distance.alias("distance")).where(F.col("distance") <= radius)
    # Keys of a table are in its place of the array: the first place where both agree is the one that counts.
    both = F.zip_with(block_keys(F.col("query"), radius), block_keys(F.col("found"), radius), lambda a, b: F.when(a == b, a))
    return near.where(F.get(F.filter(both, lambda x: x.isNotNull()), F.lit(0)) == F.col("key")).select("query", "found", "distance")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits; ``n_near`` of each document whose id 50 divides: rows within ``RADIUS`` bits, itself too."""
    work = Scratch(spark, "op11")
    own = work.save(fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), work), "documents")
    work.drop("ranges")
    found = neighbours(own, own.where(F.col("doc_id") % QUERIES == 0))
    copies = own.groupBy(F.col("fingerprint").alias("found")).agg(F.count(F.lit(1)).alias("n"))
    near = found.join(copies, "found").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("n_near"))
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    asked = F.coalesce(F.col("doc_id") % QUERIES == 0, F.lit(False))
    out = own.where(asked).join(near, "fingerprint", "left").unionByName(own.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return out.select("doc_id", "n_chars", shown("edited_sha256"), shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next", "n_near")
