"""Words of whole texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in slices of about ``most`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def byte_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and ends."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, width)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) - int(offsets[0])

SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def array_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``texts`` in slices of about ``most`` bytes."""
    for batch in text_slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), most=most):
        yield batch.column(0)


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in a row, and where each text's words begin.

    The separators are ASCII, so bytes can be told apart without decoding.
    """
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < off[1:]]
    start[edge] = inside[edge]
    pos = np.flatnonzero(start)
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[pos], kept[-1])
    words = pa.LargeStringArray.from_buffers(len(pos), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return words, np.searchsorted(pos, off)
