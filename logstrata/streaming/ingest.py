"""Streams into tables, and rollups of streams by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logstrata.database import Database


def stream_into(db: Database, name: str, stream: DataFrame, checkpoint: str, interval: float | None = None) -> StreamingQuery:
    """Appends every micro-batch of a stream to a table: the streaming counterpart of inserting and flushing at an interval.

    A batch's number is recorded in the catalog in the same step that makes its rows count, under the checkpoint's name; so a batch that
    is tried again is appended once, also after a restart.
    """

    def append(batch: DataFrame, number: int) -> None:
        db.insert_frame(name, batch, (checkpoint.rstrip("/"), number))

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval} seconds").start()


def rollup(stream: DataFrame, ts: str, width: str, lateness: str, keys: list[str], aggregates: dict[str, Column], unit: int = 1000) -> DataFrame:
    """Tumbling windows over whole-number times (``unit`` to the second), closed ``lateness`` after their end.

    The watermark bounds the state; rows later than that are dropped by it.
    """
    timed = stream.withColumn("__at", F.timestamp_micros((F.col(ts) * F.lit(1_000_000 // unit)).cast("long"))).withWatermark("__at", lateness)
    grouped = timed.groupBy(F.window("__at", width), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    start = (F.unix_micros(F.col("window.start")) / F.lit(1_000_000 // unit)).cast("long")
    return grouped.select(start.alias("bucket"), *keys, *aggregates)
