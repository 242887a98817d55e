"""Katz backoff language model with Good-Turing discounts.

Counts of grams of one token up to ``order`` are kept in tables partitioned by
the key of what is counted.  A chunk of documents asks each partition for its
distinct keys once; the partition adds up the training counts of all chunks,
stores them, and answers with the sums.  The first chunk that asked for a gram
then adds the gram's count and its lower-order probability to its context, in a
table partitioned by context, so that every backoff weight is exactly what its
seen continuations leave over.  A blob of keys never outnumbers them, so that
what is exchanged grows with the distinct grams of the chunks.

``P(w | context)`` is recursive: the discounted share of a seen gram; else the
weight of the context times the probability of ``w`` after the context without
its first token; in the end the discounted share of a seen token, else what is
left over, which stands for all unknown tokens as one.  A context that was never
seen has the weight 1.

Tokens are lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` and one end for each
text, with beginnings before the first.  Defined results.  A null or empty text
is the end alone.  A row with a null id is trained on.  Repeated rows count as
often as they come.  An empty training set gives the unknown token all
probability; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .chunks import BLOBS, Chunk, blob_batch, by_part, each_chunk, expand, mix, pack, save_chunkwise, squeeze, unpack, with_answers, write_chunks

#: Counts above this are not discounted.
LARGEST = 5
#: Tokens of the longest grams, and the most that there can be.
ORDER, MOST_ORDER = 2, 5
#: Bits of a key within its partition; single tokens, whose counts are exact, keep all.
KEY_BITS, TOKEN_BITS = 48, 64
#: Chunk numbers of the rows that hold a partition's table and its sums.
TABLE, SUMS = -1, -2

_END = np.uint64(xxhash.xxh3_64_intdigest(b"\nend"))
_BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\nbegin"))
_SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class Tokens:
    """The tokens of a chunk, with ends, and which of them are trained on."""

    def __init__(self, chunk: Chunk):
        words = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in chunk.words], np.uint64)
        self.keys = np.insert(words[chunk.codes] if len(words) else np.zeros(0, np.uint64), chunk.at[1:], _END)
        self.at = chunk.at + np.arange(len(chunk.at))
        self.trained = np.repeat(chunk.flags == 0, np.diff(self.at))
        place = np.arange(len(self.keys)) - np.repeat(self.at[:-1], np.diff(self.at))
        self.before = []  # the token k + 1 places before each, or a beginning
        for k in range(1, MOST_ORDER):
            before = np.full(len(self.keys), _BEGIN)
            before[k:] = self.keys[:-k]
            before[place < k] = _BEGIN
            self.before.append(before)

    def context(self, order: int) -> np.ndarray:
        """Keys of the ``order - 1`` tokens before each token."""
        return self._mixed(self.before[order - 2 :: -1] if order > 1 else [])

    def grams(self, order: int) -> np.ndarray:
        return self._mixed([*(self.before[order - 2 :: -1] if order > 1 else []), self.keys])

    @staticmethod
    def _mixed(tokens: list[np.ndarray]) -> np.ndarray:
        key = tokens[0]
        with np.errstate(over="ignore"):
            for t in tokens[1:]:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mix(t))
        return key


class Asked:
    """Distinct keys in the order they are asked in: by partition, then by their first ``bits``."""

    def __init__(self, keys: np.ndarray, parts: int, bits: int = KEY_BITS):
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        part, small = (distinct % np.uint64(parts)).astype(np.int64), mix(distinct) >> np.uint64(64 - bits)
        order = np.lexsort((small, part))
        self.keys, self.first = small[order], first[order]
        self.bounds = np.searchsorted(part[order], np.arange(parts + 1))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.inverse = back[inverse]

    def rows(self, number: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
        out = []
        for p, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            if a < b:
                out.append((number, p, pack(np.diff(self.keys[a:b], prepend=np.uint64(0)), *(x[a:b] for x in arrays))))
        return out

    def read(self, answers: dict[int, bytes], *kinds) -> list[np.ndarray]:
        out = [np.zeros(len(self.keys), k) for k in kinds]
        for p, blob in answers.items():
            for x, got in zip(out, unpack(blob, *kinds), strict=True):
                x[int(self.bounds[p]) : int(self.bounds[p + 1])] = got
        return out


def _columns(table: pa.Table, *kinds) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Chunks, how many keys each asked for, the keys, and the columns of all blobs."""
    blobs = [unpack(b, np.uint64, *kinds) for b in table.column("blob").to_pylist()]
    keys = np.concatenate([np.cumsum(b[0]) for b in blobs])
    return table.column("chunk").to_pylist(), [len(b[0]) for b in blobs], [keys, *(np.concatenate([b[i] for b in blobs]) for i in range(1, len(kinds) + 1))]


def _ask_counts(parts: int, order: int):
    def ask(chunk: Chunk, _) -> pa.RecordBatch:
        tokens = Tokens(chunk)
        asked = Asked(tokens.grams(order), parts, KEY_BITS if order > 1 else TOKEN_BITS)
        counts = np.bincount(asked.inverse, tokens.trained, len(asked.keys)).astype(np.int64)
        return blob_batch(asked.rows(chunk.number, counts))

    return each_chunk(ask)


def _answer_counts(table: pa.Table) -> pa.Table:
    """Sums of the counts; which chunk was first; the table; counts of counts."""
    part = table.column("part")[0].as_py()
    chunks, sizes, (keys, counts) = _columns(table, np.int64)
    distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    owner = np.zeros(len(keys), np.int8)
    owner[first] = 1
    cuts = np.cumsum(sizes)[:-1]
    rows = [(c, part, pack(n, o)) for c, n, o in zip(chunks, np.split(sums[inverse], cuts), np.split(owner, cuts), strict=True)]
    seen = sums > 0
    kept = distinct[seen]
    rows.append((TABLE, part, pack(np.diff(kept, prepend=np.uint64(0)), sums[seen])))
    of = np.bincount(sums[seen & (sums <= LARGEST + 1)], minlength=LARGEST + 2)
    rows.append((SUMS, part, squeeze(np.concatenate([[sums.sum(), seen.sum()], of[1:]]).astype(np.int64))))
    return pa.Table.from_batches([blob_batch(rows)])


def _sums(answers: DataFrame) -> np.ndarray:
    """Total, distinct, and counts of counts, from one row of each partition."""
    rows = answers.where(F.col("chunk") == SUMS).select("blob").collect()
    return sum((np.frombuffer(expand(r.blob), np.int64) for r in rows), np.zeros(LARGEST + 3, np.int64))


def discounts(of: np.ndarray, largest: int = LARGEST) -> np.ndarray:
    """Katz's discount ratios for counts 0 to ``largest``; index 0 is unused.

    ``of[r - 1]`` is the number of keys counted r times.  The largest limit
    under which all ratios are between 0 and 1 is taken; without any, half a
    count is taken from each.
    """
    for k in range(largest, 0, -1):
        n = of[: k + 1].astype(float)
        if (n <= 0).any():
            continue
        r = np.arange(1, k + 1)
        common = (k + 1) * n[k] / n[0]
        if common >= 1:
            continue
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[1.0], d, np.ones(largest - k)])
    return np.concatenate([[1.0], (np.arange(1, largest + 1) - 0.5) / np.arange(1, largest + 1)])


def discounted(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(ratios), ratios[np.minimum(counts, len(ratios) - 1)], 1.0)


class Unigrams:
    """Token probabilities from counts, and of the unknown token."""

    def __init__(self, total: int, distinct: int, of: np.ndarray):
        self.total, self.distinct, self.ratios = total, distinct, discounts(of)
        r = np.arange(1, len(self.ratios))
        lost = float(((r - discounted(r, self.ratios)) * of[: len(r)]).sum())
        # Where nothing is discounted the unknown token counts once.
        self.all = float(total) if lost > 0 else total + 1.0
        self.unknown = (lost if lost > 0 else 1.0) / self.all

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.ratios) / self.all, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.total + self.distinct + 1)


class Recursion:
    """Probabilities of the tokens of a chunk, from the answers about grams and contexts of each order."""

    def __init__(self, tokens: Tokens, answers: list[dict[int, bytes]], parts: int, unigrams: Unigrams, ratios: list[np.ndarray]):
        single = Asked(tokens.keys, parts, TOKEN_BITS)
        self.counts = single.read(answers[0], np.int64, np.int8)[0][single.inverse]
        self.p = unigrams.p(self.counts)
        for order in range(2, (len(answers) + 3) // 2):  # those whose contexts are answered too
            grams, contexts = Asked(tokens.grams(order), parts), Asked(tokens.context(order), parts)
            counts = grams.read(answers[2 * order - 3], np.int64, np.int8)[0][grams.inverse]
            below, weight = (x[contexts.inverse] for x in contexts.read(answers[2 * order - 2], np.int64, np.float64))
            seen, known = discounted(counts, ratios[order - 2]) / np.maximum(below, 1), below > 0
            self.p = np.where(counts > 0, seen, np.where(known, weight, 1.0) * self.p)


def _ask_contexts(parts: int, order: int, unigrams: Unigrams, ratios: list[np.ndarray]):
    def ask(chunk: Chunk, answers: list[dict[int, bytes]]) -> pa.RecordBatch:
        tokens = Tokens(chunk)
        lower = Recursion(tokens, answers, parts, unigrams, ratios).p
        grams, contexts = Asked(tokens.grams(order), parts), Asked(tokens.context(order), parts)
        counts, owner = grams.read(answers[-1], np.int64, np.int8)
        own = (owner == 1) & (counts > 0)
        first = grams.first[own]
        # How many continuations the chunk owns of each count that is discounted.
        few = [np.bincount(contexts.inverse[first[counts[own] == r]], minlength=len(contexts.keys)).astype(np.int32) for r in range(1, len(ratios[order - 2]))]
        sums = [np.bincount(contexts.inverse[first], counts[own], len(contexts.keys)).astype(np.int64), *few, np.bincount(contexts.inverse[first], lower[first], len(contexts.keys))]
        return blob_batch(contexts.rows(chunk.number, *sums))

    return each_chunk(ask)


def _answer_contexts(ratios: np.ndarray):
    """Each context's denominator, 0 if it is unseen, and its backoff weight."""
    r = np.arange(1, len(ratios))
    lost = r - discounted(r, ratios)

    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        chunks, sizes, (keys, *values) = _columns(table, np.int64, *[np.int32] * len(r), np.float64)
        distinct, inverse = np.unique(keys, return_inverse=True)
        count, *small, lower = (np.bincount(inverse, v, len(distinct)) for v in values)
        left = sum(x * n for x, n in zip(lost, small, strict=True))
        # A context none of whose continuations is discounted leaves one count over.
        below = np.where(left > 0, count, count + 1)
        left = np.where(left > 0, left, 1.0)
        weight = np.where(count > 0, left / np.maximum(below, 1) / np.maximum(1 - lower, 1e-300), 1.0)
        below = np.where(count > 0, below, 0).astype(np.int64)
        cuts = np.cumsum(sizes)[:-1]
        rows = [(c, part, pack(n, w)) for c, n, w in zip(chunks, np.split(below[inverse], cuts), np.split(weight[inverse], cuts), strict=True)]
        seen = count > 0
        rows.append((TABLE, part, pack(np.diff(distinct[seen], prepend=np.uint64(0)), below[seen], weight[seen])))
        return pa.Table.from_batches([blob_batch(rows)])

    return answer


def _score(parts: int, unigrams: Unigrams, ratios: list[np.ndarray]):
    def score(chunk: Chunk, answers: list[dict[int, bytes]]) -> pa.RecordBatch:
        tokens = Tokens(chunk)
        found = Recursion(tokens, answers, parts, unigrams, ratios)
        total = [np.concatenate([[0.0], np.cumsum(np.log10(x))]) for x in (found.p, unigrams.base(found.counts))]
        known = np.concatenate([[0], np.cumsum(found.counts > 0)])
        a, b = tokens.at[:-1], tokens.at[1:]
        columns = [pa.array(chunk.ids, pa.int64(), mask=~chunk.has_id), pa.array(chunk.flags.astype(np.int32)), pa.array(b - a), pa.array(known[b] - known[a]), pa.array(total[1][b] - total[1][a]), pa.array(total[0][b] - total[0][a])]
        return pa.RecordBatch.from_arrays(columns, names=_SCORES.names)

    return each_chunk(score)


def score_by_katz(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Train on the rows that are not ``held_out`` and score all, by grams of ``order`` tokens at most.

    Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score, both log10 of the whole text.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order {order} is not between 1 and {MOST_ORDER}")
    work = Scratch(docs.sparkSession, "katz")
    chunks, parts = write_chunks(docs, work, F.coalesce(held_out, F.lit(False)).cast("int"))

    def counted(k: int) -> DataFrame:
        return save_chunkwise(work, by_part(chunks.mapInArrow(_ask_counts(parts, k), BLOBS), _answer_counts), f"grams_{k}")

    one = counted(1)
    total, distinct, *of = _sums(one).tolist()
    unigrams, ratios, answers = Unigrams(total, distinct, np.array(of)), [], [one.where("chunk >= 0")]
    for k in range(2, order + 1):
        grams = counted(k)
        ratios.append(discounts(_sums(grams)[2:]))
        answers.append(grams.where("chunk >= 0"))
        asked = with_answers(chunks, *answers).mapInArrow(_ask_contexts(parts, k, unigrams, ratios), BLOBS)
        answers.append(save_chunkwise(work, by_part(asked, _answer_contexts(ratios[-1])), f"contexts_{k}").where("chunk >= 0"))
    scored = with_answers(chunks, *answers).mapInArrow(_score(parts, unigrams, ratios), _SCORES)
    scored = save_chunkwise(work, scored, "scores")
    work.drop("chunks")
    return scored.select("doc_id", (F.col("flag") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_by_katz(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
