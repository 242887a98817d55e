"""Chunks: the words of some megabytes of documents, as one row of a table.

A chunk asks other tasks about its distinct keys, once each, and they answer
with one bit for each key in the order of the question.  So the rows that are
shuffled are few, and a key that most documents have is asked once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .words import byte_buffers, split_words, text_slices

#: Words of all chunks that one partition of the keys stands for.
PARTITION_WORDS = 2 << 20

CHUNKS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("has_id", T.BinaryType()),
        T.StructField("flags", T.BinaryType()),
        T.StructField("at", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
)
BLOBS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType())])

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of the same length, or of lengths that the reader knows, as bytes."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, all first bytes, all second ones and so on: those that are mostly zero cost little."""
    return squeeze(*(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T for a in arrays))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(expand(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    has_id: np.ndarray
    flags: np.ndarray  # one for each document, as the writer's ``flag`` column
    at: np.ndarray  # where each document's words begin
    codes: np.ndarray  # numbers of all words in a row
    words: list[bytes]

    @staticmethod
    def load(batch: pa.RecordBatch, row: int) -> Chunk:
        def array(name: str, kind) -> np.ndarray:
            return unpack(batch.column(name)[row].as_py(), kind)[0]

        text = expand(batch.column("words")[row].as_py())
        words = text.split(b"\n") if text else []
        return Chunk(batch.column("chunk")[row].as_py(), array("ids", np.int64), array("has_id", bool), array("flags", np.uint8), array("at", np.int64), array("codes", np.int32), words)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.at))

    def hashes(self) -> np.ndarray:
        """A 64-bit key of each distinct word."""
        return np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in text_slices(batches):
        words, at = split_words(*byte_buffers(batch.column("text")))
        coded = words.dictionary_encode()
        ids = batch.column("doc_id")
        distinct = coded.dictionary
        text = b"\n".join(distinct.cast(pa.large_binary()).to_pylist())
        row = [
            task << 32 | n,
            int(at[-1]),
            pack(ids.fill_null(0).to_numpy().astype(np.int64)),
            pack(np.array(ids.is_valid(), bool)),
            pack(batch.column("flag").to_numpy(zero_copy_only=False).astype(np.uint8)),
            pack(at.astype(np.int64)),
            pack(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)),
            zstandard.ZstdCompressor(level=1).compress(text),
        ]
        n += 1
        types = [pa.int64()] * 2 + [pa.binary()] * 6
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=CHUNKS.names)


def write_chunks(docs: DataFrame, work: Scratch, flag=None) -> tuple[DataFrame, int]:
    """The chunk table of (doc_id, text), and a number of partitions for its keys.

    ``flag`` is a column of small numbers kept for each document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.lit(0) if flag is None else flag).cast("int").alias("flag"))
    chunks = work.save(rows.mapInArrow(_write, CHUNKS), "chunks")
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    return chunks, max(8, -(-words // PARTITION_WORDS))


def window_keys(x: np.ndarray, size: int, base: int) -> np.ndarray:
    """Keys of all windows of ``size`` words, by differences of prefix sums."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(x), np.uint64(base)))
        down = np.cumprod(np.full(n, np.uint64(pow(base, -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up)])
        return mix((sums[size:] - sums[:-size]) * down)


def deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``keys`` by partition, and where each partition begins."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=BLOBS.names)


def by_part(asked: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Answers to all blobs of each partition of the keys."""
    return asked.groupBy("part").applyInArrow(answer, BLOBS)


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each chunk beside the answers to it, as arrays of (part, blob)."""
    for i, a in enumerate(answers):
        own = a.groupBy("chunk").agg(F.collect_list(F.struct("part", "blob")).alias(f"answer{i}"))
        chunks = chunks.join(own.hint("shuffle_hash"), "chunk", "left")
    return chunks


def each_chunk(function: Callable[[Chunk, list[dict[int, bytes]]], pa.RecordBatch]):
    """A function of a chunk and the answers to it, for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [c for c in batch.schema.names if c.startswith("answer")]
            for row in range(batch.num_rows):
                got = [{x["part"]: x["blob"] for x in batch.column(c)[row].as_py() or []} for c in answers]
                yield function(Chunk.load(batch, row), got)

    return run


def save_chunkwise(work: Scratch, df: DataFrame, name: str) -> DataFrame:
    """Save what is computed from chunk rows, a few of which are a batch."""
    return work.save(df, name, arrow_rows="4")
