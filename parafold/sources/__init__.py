"""Reading and writing of tables, documents and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, every value a string; an empty field is ''."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    return rows.na.fill("")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file, nested fields as structs."""
    return spark.read.option("multiLine", True).json(path)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, text): the paragraphs of each document, in order; a null text has none."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("idx", "text"))


def flat_text_rows(paragraph_rows: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """Paragraphs and then table cells as (doc_id, part, idx, text); cells have table_idx, row_idx, col_idx."""
    cells = cell_rows.select("doc_id", F.lit(1).alias("part"), F.struct("table_idx", "row_idx", "col_idx").alias("idx"), "text")
    plain = paragraph_rows.select("doc_id", F.lit(0).alias("part"), F.struct(F.col("idx").alias("table_idx"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx")).alias("idx"), "text")
    return plain.unionByName(cells)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of the paths that exists, in any store that Spark reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return path
    raise FileNotFoundError(", ".join(paths))


def write_edited(edited: DataFrame, source: str, target: str) -> None:
    """Write an edited copy of ``source`` to ``target``; the source stays as it is."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target must differ from the source")
    edited.write.mode("overwrite").parquet(target)
