"""Streams of candidates: the same gate as the batch path, ids once within a watermark, versions appended by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import gate


def gated(stream: DataFrame, statement: str = "statement") -> DataFrame:
    """The stream with ok, verb and reasons."""
    return stream.withColumn("_g", gate.decidable(F.col(statement))).select("*", "_g.ok", "_g.verb", "_g.reasons").drop("_g")


def once(stream: DataFrame, id: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Each id once within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([id])


def verdict_counts(stream: DataFrame, time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Verdicts by time window; late rows count up to the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "ok").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "ok", "n")


def append_versions(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch once as its own version below path (a batch that is tried again replaces its version)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
