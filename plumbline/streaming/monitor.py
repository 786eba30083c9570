"""Continuous profiling: each micro-batch of a stream is profiled and its figures are appended, once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.profile import Profile, profile_columns


def monitor(stream: DataFrame, path: str, checkpoint: str, mode: str = "safe", **trigger) -> StreamingQuery:
    """Starts a query that writes one profile row per column and batch under ``path``, partitioned by batch.

    A batch that is run again after a failure replaces its own partition, so every batch counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = profile_columns(batch, mode)
        made = Profile("batch", {}, rows).to_df(batch.sparkSession).withColumn("batch_id", F.lit(batch_id))
        made.drop("batch_id").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_quality(stream: DataFrame, time: str, columns: list[str], window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Rows and missing values per event-time window, with a watermark for late rows."""
    counts = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"{c}_missing") for c in columns]
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), *counts)
