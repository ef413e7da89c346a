"""Documents that keep coming: files or rows to index tables, batch by batch, each batch as often as it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lectern.plans.index import text_postings


def write_batch(batch: DataFrame, epoch: int, path: str, id_col: str, text: str) -> None:
    """A batch's postings replace what an earlier try of the same batch wrote, so a repeated batch changes nothing."""
    postings = text_postings(batch, text, text, id_col).withColumn("epoch", F.lit(epoch))
    documents = batch.withColumn("epoch", F.lit(epoch))
    for name, df in (("postings", postings), ("documents", documents)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{path}/{name}")


def start(spark: SparkSession, source: str, schema: StructType, path: str, id_col: str = "doc_id", text: str = "text", files: int = 100) -> StreamingQuery:
    """Follow a folder of Parquet files and index what arrives, until all that is there is done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.option("checkpointLocation", f"{path}/progress").foreachBatch(lambda b, e: write_batch(b, e, path, id_col, text)).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents as their latest epoch has them."""
    rows = spark.read.parquet(f"{path}/documents")
    newest = rows.groupBy(id_col).agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, [id_col, "epoch"], "left_semi")


def latest_postings(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Postings of the latest epoch of each document: an old version's words are gone at once."""
    newest = spark.read.parquet(f"{path}/documents").groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{path}/postings").join(newest, ["doc_id", "epoch"], "left_semi").drop("epoch")


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events of each window and type; works on streams, where later ones than the watermark are dropped, and on tables."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
