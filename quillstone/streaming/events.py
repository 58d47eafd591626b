"""Event streams. The windows and late data are extensions of this library; the progress stream is the trace contract.

Each transformation takes a DataFrame, streaming or not, so batch and stream give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, some files in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total for each window; events later than the watermark are not counted in a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """start, user_id, n for each run of a user's events with no gap of `gap` or more."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def progress(steps: DataFrame, qid: str = "qid") -> DataFrame:
    """The trace of a question as messages: its steps in order, then one terminal message, result or error."""
    body = steps.select(qid, "hop", F.lit("step").alias("kind"), F.col("tool").alias("detail"))
    end = steps.groupBy(qid).agg((F.max("hop") + 1).alias("hop"), F.bool_or(F.coalesce("confident", F.lit(False))).alias("ok")).select(qid, "hop", F.when(F.col("ok"), "result").otherwise("error").alias("kind"), F.lit("").alias("detail"))
    return body.unionByName(end)


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hands each batch to `send`; a batch number that was sent before can be told by the sink."""
    w = stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
