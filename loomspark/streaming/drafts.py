"""Streams: the state of an edit log as it grows, and latest rows per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators.relational import latest_wins


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per window and type; events later than the watermark are left out."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = stream.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_table(stream: DataFrame, keys: list[str], version: list[str], path: str, checkpoint: str, read: Callable[[], DataFrame | None]) -> StreamingQuery:
    """A table of the latest row per key, kept up to date by the stream; each batch writes a new version under ``path``."""

    def merge(batch: DataFrame, number: int) -> None:
        old = read()
        rows = batch if old is None else old.unionByName(batch)
        order = [F.col(c).desc() for c in version]
        latest_wins(rows, keys, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
