"""Streams: an extension, the batch operators over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxlens.operators.suppression import suppress


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows of each window and key. Rows later than the watermark allows are dropped; state of closed windows goes."""
    span = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Spans of a key's rows without a gap that long."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def suppress_each_batch(stream: DataFrame, keys: list[str], path: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Appends what survives suppression. An image's detections must come in one batch. A batch that runs again after a failure replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        suppress(batch, keys, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Complete results of an aggregate: each batch replaces the table's folder."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
