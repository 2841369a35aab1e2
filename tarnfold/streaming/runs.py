"""Run counts kept up to date by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.session import shared_dir


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type and window of event time; works on batches and on streams alike."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """All files there are at path as one stream, to the end: a batch writes the windows that it changed, and state older than the watermark is dropped.

    Results and the stream's checkpoint lie in the shared folder, so a stopped run goes on
    where it was, and the driver holds none of it.
    """
    schema = spark.read.parquet(path).schema
    base = f"{shared_dir(spark)}/tarnfold-runs-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, so that a single file serves as well as a folder

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    query = windowed_counts(source).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema("started timestamp, event_type string, n long, total double, batch int").parquet(f"{base}/counts")
    # An updated window is written again by a later batch, and the last one counts.
    return every.groupBy("started", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
