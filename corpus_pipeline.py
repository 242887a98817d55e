"""The corpus pipeline: quality rules, line dedup, near copies, decontamination, packing.

Each stage works on all rows that the one before kept and, but for the last,
returns the columns of ``documents``.  Tables that a stage needs besides its
documents (labels, benchmark) come from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parafold.llm.decontamination import drop_leaks
from parafold.llm.jaccard import keep_one
from parafold.llm.lines import dedup_lines
from parafold.llm.packing import pack
from parafold.llm.quality import keep_good
from parafold.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    A null or empty text has too few words and goes; repeated rows go or stay
    together; without labels of both kinds only the base rule holds.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; those that lost all words go.

    Of equal or alike lines that of the least (doc_id, line) stays, null ids
    last.  Texts without words, null ones too, have no lines to lose and stay;
    rows that repeat id and text lose the same lines.
    """
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id.

    Rows that repeat id and text are one document.  Rows without an id, or with
    one that another text has too, come after all others, by a hash of the row.
    Texts without words match nothing and stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item.

    Null and empty texts have no passage and stay; repeated rows go or stay
    together; an empty benchmark drops nothing.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is in which sequence.

    Every row is packed, repeated ones one by one; a null or empty text is the
    closing id alone.  The tokenizer's path is a parameter of ``pack``.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned rules and connected groups are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of ``sf_dir``; each is written and read again."""
    work, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
