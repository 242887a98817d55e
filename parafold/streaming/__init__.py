"""Live series: lines of text files as a stream, and a filter that keeps its state from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed state needs, as session settings.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def read_lines(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of CSV lines of new files in a folder; a line that does not fit has nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def summarise(stream: DataFrame, ts: str, value: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes of each time window; rows later than ``late`` are left out."""
    seen = stream.withWatermark(ts, late)
    return seen.groupBy(F.window(ts, width).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), "n", "mean", "low", "high")


def save_batches(stream: DataFrame, checkpoint: str, save: Callable[[DataFrame, int], None]):
    """Hand each micro-batch to ``save``; batches repeat after a failure, so it must overwrite by number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


class _Complementary(StatefulProcessor):
    """Angle and time of the last row of a key; a timer forgets a key that is idle."""

    def __init__(self, alpha: float, idle_ms: int):
        self.alpha, self.idle_ms = alpha, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "angle double, micros long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("micros", kind="stable")
        angle, last, timer = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for micros, rate, measured in zip(batch["micros"].tolist(), batch["rate"].tolist(), batch["measured"].tolist(), strict=True):
            late = last is not None and micros < last
            if not late:
                if last is not None and micros - last > self.idle_ms * 1000:
                    angle = None  # idle for so long that it begins anew, whether the timer came first or not
                angle = measured if angle is None else self.alpha * (angle + rate * (micros - last) / 1e6) + (1 - self.alpha) * measured
                last = micros
            out.append((key[0], micros, None if late else angle, late))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = last // 1000 + self.idle_ms
        self.handle.registerTimer(timer)
        self.state.update((angle, last, timer))
        yield pd.DataFrame(out, columns=["key", "micros", "angle", "late"]).astype({"angle": float})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def complementary_stream(stream: DataFrame, alpha: float = 0.98, late: str = "10 minutes", idle_seconds: float = 3600.0, key: str = "user_id", ts: str = "ts", rate: str = "rate", measured: str = "measured") -> DataFrame:
    """(key, micros, angle, late) of a stream of readings: the complementary filter of each key, whose angle is kept between batches.

    Rows of a batch are taken in order of time, with the seconds since the row
    before as their step; the first angle of a key is as measured.  A row that
    is older than what its key has seen is ``late`` and changes nothing; one
    beyond the watermark ``late`` does not come.  A key without rows for
    ``idle_seconds`` of event time is forgotten and begins anew.  Rows with a
    null are left out; keys are integers.  State is in the checkpoint of the
    query, so that a restart goes on from the last batch.  The session needs
    ``STATE_STORE``.
    """
    known = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(rate).isNotNull() & F.col(measured).isNotNull())
    rows = known.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(rate).cast("double").alias("rate"), F.col(measured).cast("double").alias("measured"))
    keyed = rows.withWatermark("at", late).groupBy("key")
    return keyed.transformWithStateInPandas(_Complementary(alpha, int(idle_seconds * 1000)), "key long, micros long, angle double, late boolean", "Append", "EventTime")
