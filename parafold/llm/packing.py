"""Best-fit packing of tokenized documents by bin completion.

Documents become token ids and one closing id 0; those longer than a sequence
are cut into full pieces after a first piece that may be shorter.  Pieces are
packed by their lengths alone: the driver gets the histogram of lengths, at
most ``capacity`` counters at any size of the corpus, and answers with a plan
of fillings and how many sequences use each.  Every piece has a rank among the
pieces of its length, and the plan turns the rank into sequence and offset.

``plan_fillings`` is a branch and bound on bin completion.  The largest length
left is completed by undominated fillings, in turn as the search comes back; a
branch ends when its waste exceeds what would still improve the incumbent,
which best-fit decreasing gives at first.  The search stops at the volume
bound or after ``step_limit`` looks, with the best plan so far.

Defined results.  A null or empty text is one piece of the closing id.  Rows
that repeat, null ids included, are packed one by one.  An empty table gives an
empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .words import byte_buffers, text_slices

#: Tokens of one sequence.
CAPACITY = 2048
#: Units whose ids a Python worker remembers before it begins anew, and their bytes.
CACHE_WORDS, CACHE_BYTES = 400_000, 32 << 20
#: Fillings that a node sorts by their waste before it tries them; all are tried.
TOGETHER = 32
#: Members that the search looks at before the best plan so far is taken.
STEP_LIMIT = 300_000

_SPECIAL = "<|endoftext|>"
_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("task", T.LongType()),
        T.StructField("nth", T.LongType()),
    ]
)

_OPENS = np.zeros(256, bool)
_OPENS[[0x0A, 0x20]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[0x2C, 0x2E]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True


class WordEncoder:
    """Token ids of whole texts, by units that the tokenizer never joins.

    A unit begins with the text, at a space or line feed, or at a full stop or
    comma after an ASCII letter.  When no white space is beside another, byte
    level pre-tokenization always starts a new word at these places, so that
    the ids of a text are those of its units.  Other texts, and texts with the
    special token, are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = self.tokenizer.token_to_id(_SPECIAL)
        self.reset()

    def reset(self) -> None:
        self.store = np.zeros(1 << 16, np.uint32)
        self.begins = np.zeros(1 << 12, np.int64)
        self.counts = np.zeros(1 << 12, np.int64)
        self.filled = self.slots = self.held = 0
        self.known: dict[bytes, int] = {}

    def _remember(self, keys: list[bytes]) -> None:
        units = [k.decode() for k in keys]
        ids = np.array(self.tokenizer.encode_batch_fast([_SPECIAL.join(units) + _SPECIAL], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.special)
        ids = ids[ids != self.special]
        counts = np.diff(np.append(-1, ends)) - 1
        while self.filled + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while self.slots + len(keys) > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        here = slice(self.slots, self.slots + len(keys))
        self.store[self.filled : self.filled + len(ids)] = ids
        self.counts[here] = counts
        self.begins[here] = self.filled + np.cumsum(counts) - counts
        self.known.update(zip(keys, range(self.slots, self.slots + len(keys)), strict=True))
        self.filled += len(ids)
        self.slots += len(keys)
        self.held += sum(map(len, keys))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        if self.slots > CACHE_WORDS or self.held > CACHE_BYTES:
            self.reset()
        n = len(texts)
        whole = np.array(pc.match_substring(texts, _SPECIAL), bool)
        data, off = byte_buffers(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        if not len(data):
            return self._mend(texts, np.zeros(0, np.uint32), np.zeros(n + 1, np.int64), whole)
        opens = _OPENS[data]
        starts = opens.copy()
        starts[1:] |= _STOPS[data[1:]] & _LETTERS[data[:-1]]
        first = off[:-1][off[:-1] < off[1:]]
        starts[first] = True
        pos = np.flatnonzero(starts)
        size = np.diff(np.append(pos, len(data)))
        # Units are told apart by their bytes.
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pos), [None, pa.py_buffer(np.append(pos, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        codes, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        found = list(map(self.known.get, keys))
        missing = [i for i, slot in enumerate(found) if slot is None]
        where = np.zeros(len(keys), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]  # the first unit of each key
        if missing:
            self._remember([keys[i] for i in missing])
            for i in missing:
                found[i] = self.known[keys[i]]
        slots = np.array(found, np.int64)[codes]
        counts = self.counts[slots]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.store[np.repeat(self.begins[slots] - total[:-1], counts) + np.arange(total[-1])]
        doc = np.searchsorted(off, pos, "right") - 1
        whole[doc[self._blank(data, pos, size, codes, where)]] = True
        return self._mend(texts, ids, total[np.searchsorted(pos, off)], whole)

    def _mend(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of the texts that are encoded whole in their places."""
        if not whole.any():
            return ids, bounds
        redo = np.flatnonzero(whole)
        again = self.tokenizer.encode_batch_fast([texts[i].as_py() for i in redo.tolist()], add_special_tokens=False)
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i, e in zip(redo.tolist(), again, strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _blank(self, data: np.ndarray, pos: np.ndarray, size: np.ndarray, codes: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Units that begin or end with white space beside their own sign."""
        a, b = pos[where], pos[where] + size[where]
        head = data[np.minimum(a + 1, len(data) - 1)]
        tail = data[b - 1]
        opened = _OPENS[data[a]]
        sure = (np.where(opened, head, data[a]) < 0x80) & (tail < 0x80)
        odd = (opened & (size[where] == 1)) | (opened & ((head < 0x21) & (size[where] > 1))) | (tail < 0x21) | (~opened & (data[a] < 0x21))
        view = memoryview(data)
        for i in np.flatnonzero(~sure).tolist():
            unit = str(view[int(a[i]) : int(b[i])], "utf-8")
            body = unit[1:] if opened[i] else unit
            odd[i] |= body != body.strip()
        return odd[codes]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _tokenizer(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, coder, ranks = TaskContext.get().partitionId(), encoder(path), Counter()
        for batch in text_slices(batches):
            ids, bounds = coder.encode(batch.column("text"))
            rows: list[tuple] = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                size = len(own)
                place, step = 0, (size - 1) % capacity + 1
                for piece in range(math.ceil(size / capacity)):
                    raw = own[place : place + step].tobytes()
                    rows.append((doc_id, piece, place, step, zlib.crc32(raw), raw if with_ids else None, task, ranks[step]))
                    ranks[step] += 1
                    place, step = place + step, capacity
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=_PIECES.names)

    return run


# ---------------------------------------------------------------- the plan

Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: equal sequences move together."""
    room: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []  # sorted keys of room

    def put(r: int, filling: Filling, n: int) -> None:
        if r not in room:
            bisect.insort(rooms, r)
        room.setdefault(r, []).append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                filling, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
                k = min(left, n)
                if n > k:
                    put(r, filling, n - k)
                put(r - length, (*filling, length), k)
                left -= k
            else:  # new sequences, as full of this length as they get
                per = capacity // length
                k, m = (left // per, per) if left >= per else (1, left)
                put(capacity - m * length, (length,) * m, k)
                left -= k * m
    return [(filling, n) for groups in room.values() for filling, n in groups]


def fillings(counts: dict[int, int], first: int, capacity: int, most_waste: int, steps: Counter, limit: int) -> Iterator[tuple[int, Filling]]:
    """Undominated completions (waste, members) of ``first``, those with the largest members first.

    A filling is dominated when a length that is left fits beside it, or can
    take the place of one or two of its members within the waste.  What is
    looked at is counted in ``steps``; beyond ``limit`` the search ends.
    """
    counts = dict(counts)
    counts[first] -= 1
    sizes = sorted(s for s, n in counts.items() if n)

    def dominated(filling: Filling, slack: int) -> bool:
        used = Counter(filling)
        members = [0, *used, *{a + b for i, a in enumerate(filling) for b in filling[:i]}]
        for x in members:
            # A length in (x, x + slack], or equal to a pair, that is not used up.
            low = bisect.bisect_right(sizes, x) if x in used or not x else bisect.bisect_left(sizes, x)
            for s in sizes[low : bisect.bisect_right(sizes, x + slack)]:
                if counts[s] > used[s]:
                    return True
        return False

    def grow(top: int, slack: int, filling: Filling) -> Iterator[tuple[int, Filling]]:
        for i in range(min(top, bisect.bisect_right(sizes, slack)) - 1, -1, -1):
            for n in range(min(counts[sizes[i]], slack // sizes[i]), 0, -1):
                steps["looks"] += 1
                if steps["looks"] > limit:
                    return
                yield from grow(i, slack - n * sizes[i], (*filling, *[sizes[i]] * n))
        if slack <= most_waste and not dominated(filling, slack):
            yield slack, filling

    return grow(len(sizes), capacity - first, ())


def plan_fillings(counts: dict[int, int], capacity: int, step_limit: int = STEP_LIMIT, steps: Counter | None = None) -> Plan:
    """Fillings of at most ``capacity`` that hold all lengths, few in number.

    A node completes the largest length left by each undominated filling in
    turn, with as many sequences alike as there can be and then with one.
    ``steps`` gets the ``nodes`` and the ``looks`` of the search; more looks
    than ``step_limit`` mean that it was ended there.
    """
    counts = {s: n for s, n in counts.items() if n}
    steps = Counter() if steps is None else steps
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    large = sum(n for s, n in counts.items() if 2 * s > capacity)
    bound = max(math.ceil(total / capacity), large)

    def node(left: dict[int, int], waste: int) -> Iterator[tuple[int, Filling, int]]:
        first, spare = max(left), (best_n - 1) * capacity - total - waste
        found = fillings(left, first, capacity, spare, steps, step_limit)
        for slack, filling in chain.from_iterable(map(sorted, iter(lambda: list(islice(found, TOGETHER)), []))):
            need = Counter((first, *filling))
            most = min([left[s] // n for s, n in need.items()] + ([spare // slack] if slack else []))
            for k in dict.fromkeys((max(1, most), 1)):
                yield slack, (first, *filling), k

    stack = [(counts, [], 0, 0, node(counts, 0))]
    while stack and best_n > bound and steps["looks"] <= step_limit:
        left, plan, used, waste, branches = stack[-1]
        branch = next(branches, None)
        if branch is None:
            stack.pop()
            continue
        slack, whole, k = branch
        need = Counter(whole)
        left = {s: m for s, n in left.items() if (m := n - k * need[s])}
        plan, used, waste = [*plan, (whole, k)], used + k, waste + k * slack
        steps["nodes"] += 1
        rest = sum(s * n for s, n in left.items())
        if used + math.ceil(rest / capacity) >= best_n:
            continue
        if steps["nodes"] % 50 == 1 or not rest:  # what best fit makes of the rest may be the new incumbent
            tail = best_fit(left, capacity)
            if used + sum(n for _, n in tail) < best_n:
                best, best_n = plan + tail, used + sum(n for _, n in tail)
        if rest:
            stack.append((left, plan, used, waste, node(left, waste)))
    return best


# ------------------------------------------------------------- the operator


def tokenize(docs: DataFrame, tokenizer: str, work: Scratch, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, as a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return work.save(rows.mapInArrow(_tokenizer(tokenizer, capacity, with_ids), _PIECES), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, step_limit: int = STEP_LIMIT) -> DataFrame:
    """Pieces of ``docs`` with the sequence and the offset of each.

    Every row is packed, repeated ones and those without an id too; a null or
    empty text is the closing id alone.  Ranks come from counts by task and length, so that pieces of one length,
    however many, never meet in one task.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "packing")
    pieces = tokenize(docs, tokenizer, work, capacity, with_ids)
    by_task = work.save(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "by_task")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    plan = plan_fillings(histogram, capacity, step_limit) + ([((capacity,), full)] if full else [])
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for filling, copies in plan:
        offset = 0
        for length in filling:
            slots.setdefault(length, []).append((ranks[length], sequence, offset))
            ranks[length] += copies
            offset += length
        sequence += copies
    tables = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})
    before = by_task.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)))
    # The counts grow with the tasks times the lengths: never broadcast.
    ranked = pieces.join(before.select("length", "task", "before").hint("merge"), ["length", "task"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            table = tables.value[int(lengths[own[0]])]
            at = np.searchsorted(table[:, 0], ranks[own], "right") - 1
            sequence_id[own] = table[at, 1] + ranks[own] - table[at, 0]
            offset[own] = table[at, 2]
        return pd.DataFrame({"sequence_id": sequence_id, "offset": offset})

    placed = ranked.withColumn("place", place("length", "rank"))
    ids = ["ids"] if with_ids else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "place.sequence_id", "place.offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
