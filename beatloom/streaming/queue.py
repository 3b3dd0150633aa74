"""Polling a drop folder of jobs with Structured Streaming.

A checkpoint keeps which files were taken, so a restart resumes where the
last run ended and no job is taken twice; done jobs are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beatloom.operators.jobs import status


def pending(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Stream of the jobs dropped as parquet that are still to be processed."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("state", status(F.col("status"))).where(~F.col("state").isin("done", "blocked", "skipped"))


def poll(jobs: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Hands each batch of jobs to ``take``; once over what is there, or ``every`` so often."""
    writer = jobs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(spark: SparkSession, folder: str, schema, checkpoint: str, out: str) -> DataFrame:
    """Takes all pending jobs into the parquet folder ``out`` and returns what it holds."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    poll(pending(spark, folder, schema), checkpoint, take).awaitTermination()
    rows = pending_schema(schema)
    return spark.read.schema(rows).parquet(out)


def pending_schema(schema):
    """Schema of the taken jobs."""
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField("state", T.StringType())])


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, bearing late data up to a watermark; works on streams and tables."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), "event_type", "n_events")
