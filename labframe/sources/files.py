"""Readers: uploaded files, page artifacts, tables. Decoding PDFs and scans is left to an optional plug-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe import schema

MAX_UPLOAD_BYTES = 10 * 1024 * 1024
NATIVE_TEXT_CHARS = 20


def sniff(content: Column) -> Column:
    """application/pdf, image/png or image/jpeg by the first bytes, else null."""
    def head(n: int) -> Column:
        return F.hex(F.substring(content, 1, n))

    return F.when(head(4) == "25504446", "application/pdf").when(head(8) == "89504E470D0A1A0A", "image/png").when(head(3) == "FFD8FF", "image/jpeg")


def page_source(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > NATIVE_TEXT_CHARS, "PDF_NATIVE").otherwise("OCR")


def uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): path, length, mime, content_hash, content; refused files keep a reason and no content.
    Spark leaves empty files out."""
    files = spark.read.format("binaryFile").load(path).withColumn("mime", sniff(F.col("content")))
    reason = F.when(F.col("length") > MAX_UPLOAD_BYTES, "too large").when(F.col("mime").isNull(), "unsupported type")
    files = files.withColumn("reason", reason)
    accepted = files.filter("reason is null").select("path", "length", "mime", F.sha2("content", 256).alias("content_hash"), "content")
    return accepted, files.filter("reason is not null").select("path", "length", "reason")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """document_id and one row per page of JSON artifacts; unreadable files become rows with a null document_id."""
    docs = spark.read.schema(schema.ARTIFACT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return docs.select("document_id", "schema_version", F.size("pages").alias("n_pages"), F.explode_outer("pages").alias("page")).select("document_id", "schema_version", "n_pages", "page.*")


def settings(stored: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """One row of settings: stored values of known keys over the defaults."""
    picks = [F.coalesce(F.max(F.when(F.col("key") == k, F.col("value").try_cast("double"))), F.lit(float(v))).alias(k) for k, v in defaults.items()]
    return stored.agg(*picks)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The rows, written to a folder and read again: later steps and lost executors don't compute them anew."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
