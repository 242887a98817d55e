"""Substring dedup by difference-cover anchors.

A window is a run of ``size`` words of one document; a word goes if a window
over it also starts in a document with a smaller id.  Windows are judged on the
input.  Short anchors are hashed only at the positions that are in a difference
cover modulo its period: wherever two equal windows stand, there is a shift
below the period that takes both to cover positions, and the anchor there lies
in both.  So the windows around anchors that two documents have are all that
need extending: their full 128-bit keys are grouped and the least document of
each found.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Defined results.  A null or empty
text has no words.  A document with a null id keeps all its words and takes
none from others; rows that repeat an id do not take words from each other.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .chunks import BLOBS, Chunk, blob_batch, by_part, deal, each_chunk, expand, mix, save_chunkwise, squeeze, window_keys, with_answers, write_chunks

#: Words of a window.
SIZE = 50
#: A perfect difference cover: the differences of its members are all residues.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Part number of the row that carries a chunk's candidate positions.
CANDIDATES = -1

_KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _inside(chunk: Chunk, size: int) -> np.ndarray:
    """Positions where a window of one document with an id begins."""
    n = max(0, len(chunk.codes) - size + 1)
    doc = chunk.docs()
    return (doc[:n] == doc[size - 1 :]) & chunk.has_id[doc[:n]] if n else np.zeros(0, bool)


def _anchors(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the anchors at cover positions."""
    length = size - PERIOD + 1
    keys = window_keys(chunk.hashes()[chunk.codes], length, _BASES[0])
    place = np.arange(len(keys)) - chunk.at[chunk.docs()[: len(keys)]]
    at = np.flatnonzero(_inside(chunk, length) & np.isin(place % PERIOD, COVER))
    return at, keys[at]


def _distinct(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order they are asked in; inverse; counts; bounds."""
    distinct, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    order, bounds = deal(distinct, parts)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return distinct[order], back[inverse], counts[order], bounds


def _ask_anchors(size: int, parts: int):
    def ask(chunk: Chunk, _) -> pa.RecordBatch:
        at, keys = _anchors(chunk, size)
        distinct, inverse, _, bounds = _distinct(keys, parts)
        doc = chunk.ids[chunk.docs()[at]]
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        several = low < high
        return blob_batch([(chunk.number, p, squeeze(distinct[a:b], several[a:b])) for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if a < b])

    return each_chunk(ask)


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Which anchors are in several documents."""
    chunks, part = table.column("chunk").to_pylist(), table.column("part")[0].as_py()
    raw = [expand(b) for b in table.column("blob").to_pylist()]
    keys = [np.frombuffer(r, np.uint64, len(r) // 9) for r in raw]
    several = np.concatenate([np.frombuffer(r, bool, len(r) // 9, len(r) // 9 * 8) for r in raw])
    distinct, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[several]] = True
    flags = np.split(shared[inverse], np.cumsum([len(k) for k in keys])[:-1])
    return pa.Table.from_batches([blob_batch([(c, part, squeeze(np.packbits(f))) for c, f in zip(chunks, flags, strict=True) if f.any()])])


def _bits(answers: dict[int, bytes], bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(int(bounds[-1]), bool)
    for part, blob in answers.items():
        a, b = int(bounds[part]), int(bounds[part + 1])
        out[a:b] = np.unpackbits(np.frombuffer(expand(blob), np.uint8), count=b - a)
    return out


def _window_pairs(chunk: Chunk, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = chunk.hashes()
    return window_keys(x[chunk.codes], size, _BASES[0])[at], window_keys(mix(x ^ np.uint64(_BASES[1]))[chunk.codes], size, _BASES[1])[at]


def _least(chunk: Chunk, at: np.ndarray, size: int, parts: int):
    """Distinct windows at ``at``: both keys, the least document, inverse, bounds."""
    first, second = _window_pairs(chunk, at, size)
    distinct, inverse, _, bounds = _distinct(first ^ mix(second), parts)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(low, inverse, chunk.ids[chunk.docs()[at]])
    other = np.zeros(len(distinct), np.uint64)
    other[inverse] = second
    return distinct, other, low, inverse, bounds


def _ask_windows(size: int, parts: int):
    def ask(chunk: Chunk, answers: list[dict[int, bytes]]) -> pa.RecordBatch:
        at, keys = _anchors(chunk, size)
        _, inverse, _, bounds = _distinct(keys, parts)
        at = at[_bits(answers[0], bounds)[inverse]]
        # Windows that hold a shared anchor begin up to a period before it.
        edges = np.zeros(len(chunk.codes) + 1, np.int64)
        np.add.at(edges, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(edges, at + 1, -1)
        inside = _inside(chunk, size)
        wanted = np.flatnonzero((np.cumsum(edges)[: len(inside)] > 0) & inside)
        distinct, other, low, _, bounds = _least(chunk, wanted, size, parts)
        mask = np.zeros(len(chunk.codes), bool)
        mask[wanted] = True
        rows = [(chunk.number, p, squeeze(distinct[a:b], other[a:b], low[a:b])) for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if a < b]
        if len(wanted):
            rows.append((chunk.number, CANDIDATES, squeeze(np.packbits(mask))))
        return blob_batch(rows)

    return each_chunk(ask)


def _answer_windows(table: pa.Table) -> pa.Table:
    """Which windows start in a document before the chunk's least one."""
    chunks, part = table.column("chunk").to_pylist(), table.column("part")[0].as_py()
    raw = [expand(b) for b in table.column("blob").to_pylist()]
    sizes = [len(r) // 24 for r in raw]
    first = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(raw, sizes, strict=True)])
    second = np.concatenate([np.frombuffer(r, np.uint64, n, 8 * n) for r, n in zip(raw, sizes, strict=True)])
    low = np.concatenate([np.frombuffer(r, np.int64, n, 16 * n) for r, n in zip(raw, sizes, strict=True)])
    order = np.lexsort((low, second, first))
    new = np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]))
    least = np.empty(len(low), np.int64)
    least[order] = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    flags = np.split(least < low, np.cumsum(sizes)[:-1])
    return pa.Table.from_batches([blob_batch([(c, part, squeeze(np.packbits(f))) for c, f in zip(chunks, flags, strict=True) if f.any()])])


def _remove(size: int, parts: int):
    def remove(chunk: Chunk, answers: list[dict[int, bytes]]) -> pa.RecordBatch:
        n = len(chunk.codes)
        gone = np.zeros(n, bool)
        if CANDIDATES in answers[1]:
            wanted = np.flatnonzero(np.unpackbits(np.frombuffer(expand(answers[1][CANDIDATES]), np.uint8), count=n))
            _, _, low, inverse, bounds = _least(chunk, wanted, size, parts)
            hit = _bits(answers[0], bounds)[inverse] | (low[inverse] < chunk.ids[chunk.docs()[wanted]])
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, wanted[hit], 1)
            np.add.at(edges, wanted[hit] + size, -1)
            gone = np.cumsum(edges[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        words = np.array([w.decode("utf-8", "surrogatepass") for w in chunk.words], object)
        kept = [" ".join(words[chunk.codes[a:b][~gone[a:b]]]) for a, b in zip(chunk.at[:-1].tolist(), chunk.at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids, pa.int64(), mask=~chunk.has_id), pa.array(np.diff(chunk.at)), pa.array(total[chunk.at[1:]] - total[chunk.at[:-1]]), pa.array(kept, pa.string())],
            names=_KEPT.names,
        )

    return each_chunk(remove)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the words kept, as a text."""
    if size < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    work = Scratch(docs.sparkSession, "substrings")
    chunks, parts = write_chunks(docs, work)
    asked = save_chunkwise(work, chunks.mapInArrow(_ask_anchors(size, parts), BLOBS), "anchors")
    shared = work.save(by_part(asked, _answer_anchors), "shared")
    work.drop("anchors")
    asked = save_chunkwise(work, with_answers(chunks, shared).mapInArrow(_ask_windows(size, parts), BLOBS), "windows")
    before = work.save(by_part(asked.where(F.col("part") >= 0), _answer_windows), "before")
    marks = work.save(asked.where(F.col("part") < 0), "marks")
    work.drop("windows", "shared")
    return save_chunkwise(work, with_answers(chunks, before, marks).mapInArrow(_remove(size, parts), _KEPT), "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50
), k AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM p
), hit AS (
  SELECT k.doc_id, k.i FROM k JOIN (SELECT h, min(doc_id) AS low FROM k GROUP BY h HAVING count(*) > 1) m USING (h) WHERE m.low < k.doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM hit
), g AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
