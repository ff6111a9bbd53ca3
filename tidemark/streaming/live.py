"""The same rules as Structured Streaming: idempotent ingest, windowed counts, and a stateful delivery queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = 3


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events of Parquet files in a folder, with event time as a timestamp that watermarks accept."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(stream: DataFrame, key: str = "event_id", late: str = "240 minutes") -> DataFrame:
    """Each key once: the lookback of a crawl is the watermark, so state is bounded."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, width: str = "1 hour", late: str = "240 minutes") -> DataFrame:
    """Counts of each window and type, given out when the watermark has passed the window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def delivery_queue(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """user_id, delivered, waiting after each batch: clicks enqueue, keeping the last `keep`, purchases deliver the oldest."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, delivered = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, event_id in zip(rows.event_type, rows.event_id, strict=True):
            if kind == "click":
                queue = [*queue, int(event_id)][-keep:]
            elif kind == "purchase" and queue:
                queue, delivered = queue[1:], delivered + 1
        state.update((queue, delivered))
        yield pd.DataFrame({"user_id": [key[0]], "delivered": [delivered], "waiting": [",".join(map(str, queue))]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, delivered long, waiting string", "queue array<long>, delivered long", "update", GroupStateTimeout.NoTimeout)


def run_once(frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for the files that are there, as a table in memory: for tests and small tables."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination(300)
    finally:
        query.stop()
    return frame.sparkSession.table(name)
