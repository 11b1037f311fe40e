"""The list's columns per document, kept up to date by each batch instead of being made from all fields for every list.

Fields and summaries are stored tables in buckets by document. A batch changes the fields of the documents that it names and
summarizes these anew, from their own buckets; all other rows stay as they lie. A list then reads the summaries only.

Cases: a document whose last fields go has no summary. Corrections of fields that aren't there are left out. An empty batch
changes nothing. A batch that is given twice leaves what it left the first time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe import schema
from labframe.sources.store import Store

FIELDS = "doc_id long, field_id string, field_name string, value string, current_value string, state string"


def summarize(fields: DataFrame) -> DataFrame:
    """doc_id, patient_name, patient_id, n_fields, needs_attention."""
    def now(name: str):
        return F.max(F.when(F.col("field_name") == name, F.col("current_value")))

    return fields.groupBy("doc_id").agg(
        now("patient_name").alias("patient_name"), now("patient_id").alias("patient_id"), F.count("*").alias("n_fields"), F.coalesce(F.bool_or(F.col("state").isin(schema.ATTENTION_STATES)), F.lit(False)).alias("needs_attention"))


class KeptSummary:
    """Fields and their summaries below ``path``; made empty if there are none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.fields, self.rows = Store(spark, f"{path}/fields"), Store(spark, f"{path}/summaries")
        if not self.fields.versions():
            none = spark.createDataFrame([], FIELDS)
            self.fields.create(none, ["doc_id"], buckets)
            self.rows.create(summarize(none), ["doc_id"], buckets)

    def _refresh(self, ids: DataFrame) -> None:
        self.rows.swap(ids, summarize(self.fields.read().join(ids, "doc_id", "left_semi")))

    def extracted(self, batch: DataFrame) -> None:
        """The fields of new extractions (FIELDS without current_value) take the place of all that their documents had."""
        rows = batch.withColumn("current_value", F.col("value")).select(*[c.split()[0] for c in FIELDS.split(", ")])
        ids = batch.select("doc_id").distinct()
        self.fields.swap(ids, rows)
        self._refresh(ids)

    def corrected(self, batch: DataFrame) -> None:
        """Corrections: doc_id, field_id, seq, new_value, state. Of several for a field the last one counts."""
        last = batch.groupBy("doc_id", "field_id").agg(F.max_by(F.struct("new_value", "state"), "seq").alias("c"))
        ids = batch.select("doc_id").distinct()
        held = self.fields.read().join(ids, "doc_id", "left_semi").join(last, ["doc_id", "field_id"], "left")
        hit = F.col("c").isNotNull()
        rows = held.withColumns({"current_value": F.when(hit, F.col("c.new_value")).otherwise(F.col("current_value")), "state": F.when(hit, F.col("c.state")).otherwise(F.col("state"))})
        self.fields.swap(ids, rows.drop("c").select(*[c.split()[0] for c in FIELDS.split(", ")]))
        self._refresh(ids)

    def read(self) -> DataFrame:
        return self.rows.read()
