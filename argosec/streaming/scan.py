"""Continuous scan (an extension): new files of a folder in micro-batches, with the batch plan and the incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.operators.secrets import secrets

FILE = "path string, content string"


def stream_secrets(spark: SparkSession, source: str, sink: str, checkpoint: str, trigger: dict | None = None):
    """Secret findings of files that arrive as JSON rows (path, content). A batch that runs again replaces its own output."""

    def each(batch: DataFrame, epoch: int) -> None:
        secrets(batch).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    rows = spark.readStream.schema(FILE).json(source)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events_per_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event type in tumbling windows with a watermark; batch and stream alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
