"""Structured Streaming form of the incremental appends: results arrive in files, and state follows exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from carrierscan.operators.cohorts import latest


def stream_results(spark, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Result files as a stream, at most ``files`` of them in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_batches(stream: DataFrame, target: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Append every micro-batch with its number. A batch that runs again after a failure writes to its own folder anew, so no row counts twice."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.dropDuplicates(key).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/batch_id={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, target: str, key: list[str]) -> DataFrame:
    return latest(spark.read.parquet(target).drop("batch_id"), key, "batch")


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")
