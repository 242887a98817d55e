"""Toxicity from class-conditional Kneser-Ney models.

Two models of how words are spelled, of toxic and of ordinary documents, are
compared word by word.  Each gives a sign's probability after up to five signs
of its word: absolutely discounted counts of its class, interpolated with the
next shorter context, whose counts are Kneser-Ney continuation counts.  The
weight of a shorter context is for both classes that of the class that knows
less, and the shortest one has shared counts, so a rare expression is judged by
the parts that are known and one that neither class knows says nothing.

``learn`` takes a bounded sample of labelled documents, and all their words; the
constant of the logistic function is moved from the share of toxic documents in
the sample to that of all labels.  A document's evidence
is the difference of the two log-likelihoods, normalised by the number of words,
over all the document, over its most toxic passage, and over its words of
strong difference alone; a logistic function of these, fitted on documents whose counts were left out, is its score.

Defined results.  A null or empty text has no words and no evidence; its score
is the logistic function at 0 evidence.  Null labels are no labels; of several
labels of a document the largest counts.  Without labels of both kinds every
score is 0.  Repeated rows are scored one by one; a null id is never trained on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .words import array_slices, byte_buffers, split_words, text_slices

#: Labelled documents of each kind, at most, that the models are fitted on.
SAMPLE_ROWS = 4_000
#: Signs of the longest context, and of the pieces that longer words are cut in.
ORDER, PIECE = 5, 40
#: Words whose differences a Python worker remembers before it begins anew.
CACHE_WORDS = 400_000
#: Words of a passage.
PASSAGE = 4
#: Differences above this are evidence of their own.
STRONG = 3.0
#: No word counts for more than this, in natural logarithms.
CLIP = 8.0
THRESHOLD = 0.7

_COUNTS = T.StructType([T.StructField("word", T.StringType()), *[T.StructField(f"n{i}", T.LongType()) for i in range(4)]])
#: Counts of toxic and ordinary documents: of the first fold, and of both.
_FITS = ("n0", "n1"), ("n2", "n3")
_KEYED = T.StructType([T.StructField(c, T.LongType()) for c in ("gram", "context", *sum(_FITS, ()))])
_PLAIN = re.compile(r"[\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 94  # a sign that no plain word has


def plain_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct plain words, their numbers in all texts, and where texts begin.

    Words are lower-cased and lose all but letters and digits; those with
    nothing left are passed over.
    """
    words, at = split_words(*byte_buffers(texts))
    coded = words.dictionary_encode()
    number: dict[str, int] = {}
    table = np.full(len(coded.dictionary), -1, np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        if plain := _PLAIN.sub("", word.lower()):
            table[i] = number.setdefault(plain, len(number))
    codes = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.int64)
    kept = codes >= 0
    return list(number), codes[kept], np.concatenate([[0], np.cumsum(kept)])[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that have a word."""
    for batch in text_slices(batches):
        words, codes, at = plain_words(batch.column("text"))
        kind = batch.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(np.repeat(np.arange(len(kind)), np.diff(at)) * max(1, len(words)) + codes)
        doc, word = pairs // max(1, len(words)), pairs % max(1, len(words))
        of = [np.bincount(word[kind[doc] == i], minlength=len(words)) for i in range(4)]
        counts = [of[0], of[1], of[0] + of[2], of[1] + of[3]]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=_COUNTS.names)


class Spelling:
    """Signs of words between edges, and keys of the contexts they stand in."""

    def __init__(self, words: list[str]):
        pieces = [(i, w[k : k + PIECE]) for i, w in enumerate(words) for k in range(0, len(w), PIECE)]
        text = "".join(f"^{p}^" for _, p in pieces)
        self.signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(p) + 2 for _, p in pieces], np.int64)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = np.arange(len(self.signs)) - begin  # signs before it in its piece
        self.word = np.repeat(np.array([i for i, _ in pieces], np.int64), sizes)
        self.some = np.flatnonzero(self.place > 0)  # signs to be predicted

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signs with at least ``level`` before them: which, gram keys, context keys."""
        at = self.some[self.place[self.some] >= level]
        return at, *_hashes([self.signs[at - back] for back in range(level, -1, -1)])


def _hashes(signs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gram keys and context keys of signs, given with those before them, the last one last."""
    with np.errstate(over="ignore"):
        context = np.full(len(signs[0]), np.uint64(len(signs)))
        for sign in signs[:-1]:
            context = (context ^ (context >> np.uint64(29))) * _MULTIPLIER + sign
        gram = (context ^ (context >> np.uint64(31))) * _MULTIPLIER + signs[-1]
        return gram ^ (gram >> np.uint64(32)), context


def _keys_of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys instead of grams, all of the same length."""
    for batch in batches:
        if batch.num_rows:
            text = "".join(batch.column("g").to_pylist())
            signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(batch.num_rows, -1)
            keys = [pa.array(k.view(np.int64)) for k in _hashes(list(signs.T))]
            yield pa.RecordBatch.from_arrays([*keys, *[batch.column(c) for c in _KEYED.names[2:]]], names=_KEYED.names)


@dataclass
class _Table:
    keys: np.ndarray  # sorted
    values: np.ndarray

    @staticmethod
    def sums(keys: np.ndarray, values: np.ndarray) -> _Table:
        distinct, inverse = np.unique(keys, return_inverse=True)
        return _Table(distinct, np.column_stack([np.bincount(inverse, v, len(distinct)) for v in values.T]).astype(np.float32))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Rows for ``keys``; zeros for those that are missing."""
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.values[at], 0)


def discount(counts: np.ndarray) -> float:
    """What absolute discounting takes from each count: n1 / (n1 + 2 n2), from counts of counts."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


@dataclass
class ToxicityModel:
    """Counts (toxic, ordinary) of grams and contexts by level; logistic weights."""

    grams: list[_Table]
    contexts: list[_Table]  # counts and discounted counts, each of both classes
    discounts: np.ndarray  # by level and class
    weights: np.ndarray  # constant, whole text, passage, strong words

    @staticmethod
    def of(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> ToxicityModel:
        """From keys of grams and contexts, and counts of grams, of each level."""
        grams, contexts, discounts = [], [], []
        for gram, context, n in levels:
            some = n.any(1)
            gram, context, n = gram[some], context[some], n[some].astype(np.float32)
            d = np.array([discount(c) for c in n.T], np.float32)
            grams.append(_Table.sums(gram, n))
            contexts.append(_Table.sums(context, np.column_stack([n, np.maximum(n - d, 0)])))
            discounts.append(d)
        return ToxicityModel(grams, contexts, np.array(discounts), np.zeros(4))

    @staticmethod
    def step(n: np.ndarray, c: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Probabilities of both classes at one level from those of the level below.

        Discounted counts of the class have the share that the class with the
        fewest known continuations can give; the rest is the level below.
        """
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(c[:, :2] > 0, (c[:, :2] - c[:, 2:]) / c[:, :2], 1.0).max(1)[:, None]
            own = np.where(c[:, 2:] > 0, np.maximum(n - d, 0) / c[:, 2:], lower)
        return (1 - rest) * own + rest * lower

    def differences(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word by the toxic model less the ordinary."""
        spelling = Spelling(words)
        p = np.ones((len(spelling.signs), 2))
        for level in range(ORDER + 1):
            at, gram, context = spelling.keys(level)
            n, c = self.grams[level].get(gram), self.contexts[level].get(context)
            if level == 0:  # shared by the classes; one sign more than are known
                p[at] = ((n.sum(1) + 1) / (c[:, :2].sum(1) + len(self.grams[0].keys) + 1))[:, None]
                continue
            p[at] = self.step(n, c, p[at], self.discounts[level])
        ratio = np.log(p[spelling.some, 0]) - np.log(p[spelling.some, 1])
        return np.clip(np.bincount(spelling.word[spelling.some], ratio, len(words)), -CLIP, CLIP)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Mean difference of each text, of its most toxic passage, and beyond ``STRONG``."""
        words, at = split_words(*byte_buffers(texts))
        out = np.zeros((len(texts), 3))
        coded = words.dictionary_encode()
        value = self._known(coded.dictionary.to_pylist()) if len(coded.dictionary) else np.zeros(0)
        each = value[coded.indices.to_numpy(zero_copy_only=False)]
        kept = ~np.isnan(each)
        each, at = each[kept], np.concatenate([[0], np.cumsum(kept)])[at]
        if not len(each):
            return out
        total = np.concatenate([[0.0], np.cumsum(each)])
        strong = np.concatenate([[0.0], np.cumsum(np.maximum(each - STRONG, 0))])
        n = np.diff(at)
        out[:, 0] = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
        out[:, 2] = (strong[at[1:]] - strong[at[:-1]]) / np.maximum(n, 1)
        begin = np.arange(len(each))
        passage = (total[np.minimum(begin + PASSAGE, np.repeat(at[1:], n))] - total[begin]) / PASSAGE
        some = n > 0
        out[some, 1] = np.maximum.reduceat(passage, at[:-1][some])
        return out

    def _known(self, words: list[str]) -> np.ndarray:
        """Differences of raw words, by their plain forms; NaN for those that have none."""
        known = self.__dict__.setdefault("cache", {})
        if len(known) > CACHE_WORDS:
            known.clear()
        found = [known.get(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            plain = {w: _PLAIN.sub("", w.lower()) for w in (words[i] for i in new)}
            forms = list(dict.fromkeys(filter(None, plain.values())))
            value = dict(zip(forms, self.differences(forms).tolist() if forms else [], strict=True))
            value[""] = math.nan
            known.update((w, value[x]) for w, x in plain.items())
            for i in new:
                found[i] = known[words[i]]
        return np.array(found, float)

    def score(self, texts: pa.Array) -> np.ndarray:
        return _logistic(_design(self.evidence(texts)) @ self.weights)


def _design(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), evidence[:, 0], evidence[:, 1], 30 * evidence[:, 2]])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.01] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def gram_counts(words: DataFrame, work: Scratch) -> list[DataFrame]:
    """(g, n0 to n3) by level: the grams of all words, with counts of ``_FITS``.

    A sign counts at the level of its longest context; at each lower level it
    counts once for each kind of the grams that are longer by a sign.
    """
    names = _KEYED.names[2:]
    piece = F.explode(F.expr(f"transform(sequence(0, length(word) - 1, {PIECE}), k -> concat('^', substring(word, k + 1, {PIECE}), '^'))"))
    pieces = words.select(piece.alias("p"), *names)
    longest = F.explode(F.expr(f"transform(sequence(1, length(p) - 1), i -> substring(p, greatest(i - {ORDER}, 0) + 1, least(i, {ORDER}) + 1))"))
    sums = [F.sum(c).alias(c) for c in names]
    own = work.save(pieces.select(longest.alias("g"), *names).groupBy("g").agg(*sums), "grams")
    levels: list[DataFrame] = []
    for level in range(ORDER, -1, -1):
        rows = own.where(F.length("g") == level + 1)
        if levels:
            kinds = levels[-1].select(F.expr("substring(g, 2)").alias("g"), *[(F.col(c) > 0).cast("long").alias(c) for c in names])
            rows = rows.unionByName(kinds).groupBy("g").agg(*sums)
        levels.append(work.save(rows, f"grams_{level}"))
    return levels[::-1]


def _model(levels: list[DataFrame], fit: tuple[str, str]) -> ToxicityModel:
    """The model of the two counts ``fit``; the tables are bounded by the sample."""
    found = []
    for rows in levels:
        table = rows.where(" OR ".join(f"{c} > 0" for c in fit)).mapInArrow(_keys_of_grams, _KEYED).select("gram", "context", *fit).toArrow()
        keys = [table.column(c).to_numpy().view(np.uint64) for c in ("gram", "context")]
        found.append((*keys, np.column_stack([table.column(c).to_numpy().astype(np.float32) for c in fit])))
        del table
    return ToxicityModel.of(found)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel | None:
    """Models from at most ``sample_rows`` labelled documents of each kind.

    ``kind`` is twice the fold plus the class: 0 and 2 toxic, 1 and 3 ordinary.
    The second fold, a third of the sample, is left out of the counts that the
    logistic weights are fitted on.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    if set(sizes) != {True, False}:
        return None
    share = {k: 0.95 * sample_rows / n if n > sample_rows else 1.0 for k, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    known = known.where(place < F.when(F.col("toxic") == 1, share[True]).otherwise(share[False]))
    # The labels of the sample are broadcast, so that only its texts are shuffled:
    # a share of 0.95 of the bound keeps them near it, some bytes each.
    kind = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).cast("int") * 2 + F.when(F.col("toxic") == 1, 0).otherwise(1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", kind.alias("kind"))
    rows = work.save(rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.min("kind").alias("kind")).select("text", "kind"), "sample")
    counts = [f"n{i}" for i in range(4)]
    found = rows.mapInArrow(_count, _COUNTS).groupBy("word").agg(*[F.sum(c).alias(c) for c in counts])
    levels = gram_counts(found, work)
    # The logistic weights, from the documents of the other fold.
    shared = spark.sparkContext.broadcast(_model(levels, _FITS[0]))
    own = rows.where(F.col("kind") >= 2).select("kind", _evidence(shared).alias("e")).select("kind", "e.*").toPandas()
    shared.destroy()
    model = _model(levels, _FITS[1])
    if own["kind"].nunique() == 2:
        model.weights = _fit(_design(own[["mean", "passage", "strong"]].to_numpy(float)), (own["kind"] == 2).to_numpy(float))
    # The sample has other shares of the two kinds than the labels have.
    model.weights[0] -= np.log(share[True] / share[False])
    work.drop("sample", "grams", *[f"grams_{level}" for level in range(ORDER + 1)])
    return model


def _evidence(shared: Broadcast) -> Column:
    @F.arrow_udf("mean double, passage double, strong double")
    def evidence(texts: pa.Array) -> pa.Array:
        got = np.concatenate([shared.value.evidence(t) for t in array_slices(texts)] or [np.zeros((0, 3))])
        return pa.StructArray.from_arrays([pa.array(x) for x in got.T], names=["mean", "passage", "strong"])

    return evidence("text")


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> Column:
    """Score column, 0 to 1, of the whole text."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([shared.value.score(t) for t in array_slices(texts)] or [np.zeros(0)]))

    return toxicity(F.col(text))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs.where(remainder != 1), labels.where(remainder != 1))
    scored = docs.select("doc_id", (F.coalesce(remainder, F.lit(0)) == 1).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
