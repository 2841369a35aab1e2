"""Session construction and table access shared by queries, tests and the bench."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarnfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine expects; cluster settings given elsewhere win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


# The tables whose rows are texts, and how many of them a Python worker gets at once where the session doesn't say. Spark's own 10,000 let workers grow until files hold as many.
TEXTS, TEXT_ROWS = {"documents", "pages", "conversations"}, 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    if name in TEXTS and spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(TEXT_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local one is set only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("tarnfold.local.shared", spark.conf.get("tarnfold.local.shared", f"file:///tmp/tarnfold-{uuid.uuid4().hex}"))
    return spark.conf.get("tarnfold.local.shared")


def saver(spark: SparkSession, name: str):
    """save(df, step): df written below the shared folder and read again, so that lineage ends there."""
    base = f"{shared_dir(spark)}/tarnfold-{name}-{uuid.uuid4().hex}"

    def save(df: DataFrame, step: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{base}/{step}")
        return spark.read.schema(df.schema).parquet(f"{base}/{step}")

    return save
