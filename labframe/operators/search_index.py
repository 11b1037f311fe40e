"""Substring search by an index of trigrams, instead of a scan that lowers every text.

The index has one row per document, version and different trigram of its lowered texts, stored by trigram. A batch of new or
changed documents adds rows under a new version and a row to the table of current versions, so nothing is rewritten; postings of
older versions lose their join. A search reads the postings of the term's trigrams only, keeps documents that have all of them,
and verifies the term on the texts of these. Terms of less than three characters have no trigram and are looked up by a scan.

Cases: null texts have no trigrams. A document that is added twice in a batch counts with all its texts. Wildcards in the term
mean themselves; case doesn't matter. An empty term is in every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
#: Folders of postings; a term reads those of its trigrams.
BUCKETS = 32


def _grams(text):
    n = F.length(text)
    return F.when(n >= SIZE, F.array_distinct(F.transform(F.sequence(F.lit(1), n - SIZE + 1), lambda i: F.substring(text, i, SIZE)))).otherwise(F.array().cast("array<string>"))


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """An index below ``path``. ``texts`` given to it have id and text, any number of rows per id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, texts: DataFrame, version: int) -> None:
        """Documents of a batch, with all their texts, in the place of what was known of them. Writing a version again changes
        nothing: it lies in folders of its own."""
        lowered = texts.select("id", F.lower("text").alias("text"))
        grams = lowered.select("id", F.explode(_grams(F.col("text"))).alias("gram")).distinct().withColumn("bucket", _bucket(F.col("gram")))
        # Postings of a frequent trigram are spread over tasks by id, and each task sorts its own for the reader's statistics.
        dealt = grams.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/version={version}")
        lowered.write.mode("overwrite").parquet(f"{self.path}/texts/version={version}")

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")

    def texts(self) -> DataFrame:
        """id, text, version: what stands now."""
        kind = dict(self.spark.read.parquet(f"{self.path}/texts").dtypes)["id"]
        all_ = self._read("texts", f"id {kind}, text string, version long")
        return all_.join(all_.groupBy("id").agg(F.max("version").alias("version")), ["id", "version"], "left_semi")

    def search(self, term: str) -> DataFrame:
        """id of each document with the term in one of its texts."""
        term, now = term.lower(), self.texts()
        hit = F.contains(F.col("text"), F.lit(term))
        grams = sorted({term[i : i + SIZE] for i in range(len(term) - SIZE + 1)})
        if not grams:
            return now.filter(hit).select("id").distinct()
        kind = dict(now.dtypes)["id"]
        postings = self._read("postings", f"id {kind}, gram string, version long, bucket int")
        numbers = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(g)) for g in grams]))).collect()]
        own = postings.filter(F.col("bucket").isin(sorted(set(numbers))) & F.col("gram").isin(grams))
        likely = own.groupBy("id", "version").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
        return now.join(likely, ["id", "version"], "left_semi").filter(hit).select("id").distinct()
