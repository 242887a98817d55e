"""Quality rules: decision lists learned by sequential covering.

``text_stats`` computes statistics of whole texts.  ``learn`` grows rules, each
a conjunction of thresholds that picks out low quality, on two thirds of the
labelled rows by information gain and prunes them on the others; rows that a
rule covers are set aside before the next one is grown.  ``DecisionList.column``
is the ordered conditional expression of the rules.

Defined results.  A null or empty text has no words: all its statistics are 0
and it fails the base rule.  A null label is no label; of several labels of a
document the smallest counts.  Without labels of both kinds the list is empty
and only the base rule rejects.  Repeated rows are judged one by one, and other
columns are kept as they are.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import SPACE, array_slices, byte_buffers, split_words

#: Labelled rows, at most, from which rules are learned.
SAMPLE_ROWS = 20_000
#: Share of truly low-quality rows that a rule must have among those it covers.
MIN_PRECISION = 0.9
#: Rows of the training part that a rule must cover.
MIN_COVER = 8
MAX_RULES = 12
MAX_CONDITIONS = 4
#: Words of a repeated window.
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_stops", "n_short", "n_chars"]
#: Statistics that thresholds may be set on, as SQL over the counts.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "digits_per_char": "n_digits / greatest(n_chars, 1)",
    "upper_per_char": "n_upper / greatest(n_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "short_words": "n_short / greatest(n_words, 1)",
}

_STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _mask(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(x) for x in signs]] = True
    return out


_SYMBOLS, _DIGITS, _STOPS = _mask("#*$%&|<>"), _mask("0123456789"), _mask(".!?")
_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def repeated_words(codes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text in windows that the text has twice or more.

    ``codes`` number the words, ``at`` says where each text begins.  Windows are
    numbered exactly, by pairs of numbers of their parts.
    """
    n, docs = len(codes), len(at) - 1
    if n < window:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(at))
    grams, width = codes.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        m = n - width - step + 1
        own = grams[:m] * (int(grams.max()) + 1) + grams[step : step + m]
        grams, width = pd.factorize(own)[0].astype(np.int64), width + step
    same = doc[: n - window + 1] == doc[window - 1 :]
    key = grams * docs + doc[: n - window + 1]
    number = pd.factorize(key)[0]
    twice = same & (np.bincount(number[same], minlength=number.max() + 1)[number] > 1)
    edges = np.zeros(n + 1, np.int64)
    begins = np.flatnonzero(twice)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[at[1:]] - total[at[:-1]]


def _dup_lines(text: str) -> tuple[int, int]:
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return lines, dup


def count_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of one slice."""
    data, off = byte_buffers(texts)
    words, at = split_words(data, off)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def per_text(flags: np.ndarray, bounds: np.ndarray = off) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    points = (data & 0xC0) != 0x80
    lines = [_dup_lines(t or "") for t in texts.to_pylist()]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]) if len(words) else np.zeros(0, np.int64)
    pairs = np.unique(doc * (int(codes.max()) + 1) + codes) // (int(codes.max()) + 1) if len(codes) else doc
    return {
        "n_words": np.diff(at),
        "word_chars": per_text(points & ~SPACE[data]),
        "n_symbols": per_text(_SYMBOLS[data]),
        "n_dup_lines": np.array([x[1] for x in lines], np.int64),
        "n_repeat_words": repeated_words(codes, at),
        "n_lines": np.array([x[0] for x in lines], np.int64),
        "n_distinct": np.bincount(pairs, minlength=len(texts)),
        "n_digits": per_text(_DIGITS[data]),
        "n_upper": per_text(_UPPER[data]),
        "n_stops": per_text(_STOPS[data]),
        "n_short": per_text(lengths <= 1, at),
        "n_chars": per_text(points),
    }


@F.arrow_udf(_STATS)
def text_stats(texts: pa.Array) -> pa.Array:
    parts = [count_stats(x) for x in array_slices(texts)]
    columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
    return pa.StructArray.from_arrays(columns, names=COUNTS)


# --------------------------------------------------------------- the rules


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.above else x < self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a row that one of them covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self, counts: str) -> Column:
        """0 where no rule applies, else the number of the first that does.

        ``counts`` is the struct column that holds the counts.
        """
        out = None
        for n, rule in enumerate(self.rules, 1):
            test = F.expr(" AND ".join(within(counts, c.sql()) for c in rule))
            out = F.when(test, F.lit(n)) if out is None else out.when(test, F.lit(n))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def within(struct: str, sql: str) -> str:
    """``sql`` with the counts as fields of ``struct``, whatever columns there are."""
    return re.sub(rf"\b({'|'.join(COUNTS)})\b", rf"{struct}.\1", sql)


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold with the largest gain over the rows that are left."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best = None
    base = math.log2(p0 / (p0 + n0))
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below = np.cumsum(b)[cut - 1]
        size = cut
        for above in (True, False):
            p = (p0 - below if above else below).astype(float)
            t = (len(v) - size if above else size).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - base), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                low, high = float(v[cut[i] - 1]), float(v[cut[i]])
                best = (float(gain[i]), Condition(name, above, (low + high) / 2))
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> DecisionList:
    """Sequential covering; rows of ``part`` 0 prune what the others grow."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & (part != 0), left & (part == 0)
        rule: list[Condition] = []
        rows = grow.copy()
        while len(rule) < MAX_CONDITIONS and bad[rows].sum() >= MIN_COVER and not bad[rows].all():
            found = _best_condition({k: v[rows] for k, v in x.items()}, bad[rows])
            if not found:
                break
            rule.append(found[1])
            rows &= found[1].holds(x[found[1].feature])
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            hit = _covers(r, x, len(bad)) & prune
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)))
        hit = _covers(rule, x, len(bad)) & left
        if (hit & bad).sum() < MIN_COVER or (hit & bad).sum() < MIN_PRECISION * hit.sum() or worth(rule) < 2 * MIN_PRECISION - 1:
            break
        rules.append(tuple(rule))
        left &= ~hit
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Rules from at most ``sample_rows`` labelled rows, those of the least hashes of the id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    if total > sample_rows:
        share = int(0.95 * sample_rows / total * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(known), "doc_id")  # bounded by the sample, some bytes each
        .select("doc_id", "quality", text_stats("text").alias("s"))
        .select("doc_id", "quality", "s.*")
        .select("doc_id", "quality", *[F.expr(f"double({sql})").alias(name) for name, sql in FEATURES.items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES)
        .limit(sample_rows)
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    bad = rows["quality"].to_numpy() == 0
    if not bad.any() or bad.all():
        return DecisionList(())
    part = pd.util.hash_array(rows["doc_id"].to_numpy()) % 3
    return learn_rules({k: rows[k].to_numpy(float) for k in FEATURES}, bad, part)


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with a struct ``verdict``: counts, base_failed, rule, kept."""
    rows = docs.withColumn("verdict", text_stats("text"))
    rule = rules.column("verdict")
    failed = F.expr(within("verdict", BASE_FAILED))
    fields = [F.col(f"verdict.{c}") for c in COUNTS]
    return rows.withColumn("verdict", F.struct(*fields, failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a learned one rejects.

    Each row is judged by its text alone, so that repeated rows go or stay
    together; a null or empty text has too few words and goes.  Without labels
    of both kinds only the base rule holds.
    """
    judged = judge(docs.select(F.struct("*").alias("row"), "text"), learn(docs, labels))
    return judged.where("verdict.kept").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, learn(docs, labels)).select(
        "doc_id", *[f"verdict.{c}" for c in COUNTS[:5]], "verdict.base_failed", "verdict.kept", "verdict.rule"
    )
