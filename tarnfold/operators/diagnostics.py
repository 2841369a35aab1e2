"""Metrics that an operation's own job collects, and the append-only ledger that keeps them.

Counts are observed while the rows pass by on their way to where they are written, so no
second job counts them; they are those of the tasks that succeeded. A record is one row of
one file; records are never changed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "operation string, started timestamp, duration_ms double, success boolean, error string, metrics map<string,double>, notes map<string,string>"


class Diagnostics:
    """The records of operations below a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @contextmanager
    def operation(self, name: str, **notes: str) -> Iterator[dict[str, float]]:
        """Time what runs inside, and record it with the numbers that it put into the given dict, whether it ends well or not."""
        metrics: dict[str, float] = {}
        started, began, wrong = datetime.now(UTC).replace(tzinfo=None), time.perf_counter(), None
        try:
            yield metrics
        except BaseException as e:
            wrong = type(e).__name__
            raise
        finally:
            row = (name, started, (time.perf_counter() - began) * 1000, wrong is None, wrong, {k: float(v) for k, v in metrics.items() if v is not None}, {k: str(v) for k, v in notes.items()})
            self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def written(self, name: str, df: DataFrame, path: str, metrics: dict[str, Column], **notes: str) -> DataFrame:
        """df as it was written to path; `metrics` are aggregates over its rows, worked out by the job that writes them."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        with self.operation(name, **notes) as held:
            df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.mode("errorifexists").parquet(path)
            held.update({k: v for k, v in seen.get.items() if v is not None})
        return self.spark.read.schema(df.schema).parquet(path)

    def records(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def latest(self, n: int) -> DataFrame:
        """The newest n records of each operation."""
        nth = F.row_number().over(Window.partitionBy("operation").orderBy(F.desc("started"), F.desc("duration_ms")))
        return self.records().withColumn("nth", nth).filter(F.col("nth") <= n)

    def summary(self) -> DataFrame:
        """A row an operation: how often it ran and failed, and its mean and longest time."""
        return self.records().groupBy("operation").agg(F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failed"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("longest_ms"))
