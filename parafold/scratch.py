"""Working tables in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
and the master is local, so that there is one machine, a temporary folder of this
process is used instead; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python.  Texts average some kilobytes, so
#: this keeps a batch at a few megabytes; operators slice batches further.
ARROW_ROWS = "1000"


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as ``__``) for the duration of a block."""
    before = {}
    for key, value in conf.items():
        key = key.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared working folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = tempfile.mkdtemp(prefix="parafold-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    conf = spark._jsc.hadoopConfiguration()
    qualified = path.getFileSystem(conf).makeQualified(path).toString()
    return "file://" + qualified[5:] if qualified.startswith("file:/") and not qualified.startswith("file://") else qualified


class Scratch:
    """A folder of working tables for one run of one operator.

    A saved table cuts lineage: what reads it needs no earlier shuffle, so an
    executor that is lost costs only its running tasks.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/parafold/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, arrow_rows: str = ARROW_ROWS) -> DataFrame:
        """Write ``df`` as Parquet and return the table read again.

        Shuffle files of the write are removed once it has ended.
        """
        path = self.path(name)
        with settings(
            self.spark,
            spark__sql__execution__arrow__maxRecordsPerBatch=arrow_rows,
            spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
            spark__sql__parquet__compression__codec="zstd",
            # Plans of many expressions are long; the driver keeps their text for each job.
            spark__sql__maxPlanStringLength="20000",
        ):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and collect the driver's garbage.

        Plans of the jobs that read them are garbage by then: left alone they
        grow the driver's heap to its limit, and broadcasts and shuffles wait for
        Spark's cleaner, which acts on what has been collected.
        """
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark._jvm.System.gc()
