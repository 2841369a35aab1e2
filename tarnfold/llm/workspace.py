"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

Written tables cut lineage and survive lost executors: a task that is lost is run
again from files which every executor can read. What a result still reads stays until
the driver ends, and goes then.
"""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.session import shared_dir


class Workspace:
    """A folder of one run of an operator. Tables that no result reads are dropped on the way, the others with the driver."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tarnfold-{name}-{uuid.uuid4().hex}"
        atexit.register(self._leave)

    def _leave(self) -> None:
        try:
            self.drop("")
        except (Py4JError, OSError, AttributeError):  # the JVM ended first
            pass

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df and read it back with its own schema, so empty results keep their columns."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(conf).delete(path, True)


# The word rule of the contracts. A word is a run of bytes other than these six.
BLANKS = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def is_fold(key: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text falls on the remainder; a null id falls on none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
