"""Structured Streaming variants of the duplicate check and of daily counts.

Each runs to the end of what is there (AvailableNow), with its checkpoint and output in the shared folder, so a restarted
driver goes on where it stopped; the result is then read as a table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, what: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="labframe-stream-")
    return f"{base.rstrip('/')}/labframe-{what}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def _drain(stream: DataFrame, mode: str, what: str) -> DataFrame:
    spark = stream.sparkSession
    out = folder(spark, what)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/progress").outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    # An update holds the newest row per group; the batch number tells which one that is.
    writer.foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{out}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def first_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_hash of every first upload; state is the set of hashes seen."""
    hashed = _stream(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"))
    return _drain(hashed.dropDuplicates(["content_hash"]), "append", "uploads")


def daily_counts(spark: SparkSession, sf_dir: str, late: str = "60 days") -> DataFrame:
    """event_type, day, n over tumbling days; rows that come later than the watermark allows are dropped."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = events.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")
    rows = _drain(counted, "update", "days")
    return rows.groupBy("event_type", "day").agg(F.max_by("n", "_batch").alias("n"))
