"""The same rules on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptloom.functions.guardrail import verdict


def guarded(stream: DataFrame, text: str = "text") -> DataFrame:
    """A stream with ``allowed`` and ``reason``; stateless, so it takes any stream."""
    return stream.withColumn("_v", verdict(F.col(text))).select(*stream.columns, "_v.allowed", "_v.reason")


def verdict_counts(stream: DataFrame, time: str, text: str = "text", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Verdicts by window of event time; rows later than ``late`` are dropped, which bounds the state."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark takes no timestamps without zone
    own = guarded(timed.withWatermark(time, late), text)
    return own.groupBy(F.window(time, window), "reason").count().select("window.start", "window.end", "reason", F.col("count").alias("n"))


def run_batches(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str) -> StreamingQuery:
    """Run a batch pipeline on what has come since, into a Parquet folder with one part for each batch.

    A batch that is run again after a failure overwrites its own part, so results don't double. Rows of a batch that
    repeat a key count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        pipeline(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
