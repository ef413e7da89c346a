"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds: documents may be very long, and a batch of 10,000 of them fills a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the folder of spark.checkpoint.dir and read on from there; lost executors then cost nothing.

    Only where the session names no folder, as in tests, a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let shuffle files that nothing refers to any more be removed; they stay until the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without_estimates(df: DataFrame) -> DataFrame:
    """The checkpointed rows without the size that the planner reckoned for the plan they came from.

    A checkpoint keeps that estimate, and a join's is the product of its sides'. In a loop of joins and checkpoints its
    digits double with each join, until the driver does nothing but multiply.
    """
    session, rows = df.sparkSession._jsparkSession, df._jdf
    return DataFrame(session.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), df.sparkSession)
