"""A stored table that batches replace and upsert while others read it.

Rows lie in buckets by the hash of their key. A change writes the buckets that it touches anew, into a folder of its own, and
then one small manifest that says which folder holds each bucket. Readers go by the newest manifest, so they see the table
before a change or after it, never in between. A manifest is created under the next number and only if nobody else has done so:
of two writers that started from the same version one fails and must begin again. What no kept manifest names can be removed.

The driver holds one entry per bucket. A change reads and writes touched buckets only; keys are never collected.

Cases: null keys are keys. Of rows with equal keys in one change the greatest row stays (by the columns in their order). An
empty change makes no version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(Exception):
    """Another writer has made the next version."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests ----------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """schema, keys, buckets and parts (bucket: folder) of a version, by default the newest."""
        version = self.versions()[-1] if version is None else version
        source = self._fs.open(self._hadoop(f"{self.path}/manifests/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest is written aside and renamed, which does nothing if the name is taken."""
        aside, at = self._hadoop(f"{self.path}/manifests/_{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/manifests/{version}")
        out = self._fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    # Rows ---------------------------------------------------------------------------------------------------------------

    @staticmethod
    def _bucket(keys: list[str], buckets: int):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Rows by bucket into a new folder; which buckets it holds."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = [x.getPath().getName() for x in self._fs.listStatus(self._hadoop(f"{self.path}/{folder}")) if x.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in there}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        self._publish(0, {"schema": rows.schema.json(), "keys": keys, "buckets": buckets, "parts": self._write(rows, keys, buckets)})

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The rows of a version, of some of its buckets if so said."""
        found = self.manifest(version)
        schema = self.spark.createDataFrame([], "x int").schema.fromJson(json.loads(found["schema"]))
        parts = [f"{self.path}/{p}" for b, p in found["parts"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _change(self, touched: DataFrame, rows, version: int | None = None) -> int:
        """A new version in which the buckets of the keys in ``touched`` hold ``rows(what they held)``."""
        version = self.versions()[-1] if version is None else version
        old = self.manifest(version)
        hit = [str(r[0]) for r in touched.select(self._bucket(old["keys"], old["buckets"])).distinct().collect()]
        if not hit:
            return version
        fresh = self._write(rows(self.read(version, hit)), old["keys"], old["buckets"])
        kept = {b: p for b, p in old["parts"].items() if b not in hit}
        self._publish(version + 1, old | {"parts": kept | fresh})
        return version + 1

    def upsert(self, rows: DataFrame, version: int | None = None) -> int:
        """One row per key of ``rows`` takes the place of the row with its key, or is added. ``version``: the one that the
        writer has seen; it fails if there is a newer one."""
        keys = self.manifest(version)["keys"]
        one = rows.groupBy(*keys).agg(F.max(F.struct(*rows.columns)).alias("r")).select("r.*")
        return self._change(one, lambda held: _without(held, one, keys).unionByName(one), version)

    def replace(self, rows: DataFrame, part: list[str], version: int | None = None) -> int:
        """All rows that agree with some of ``rows`` in ``part``, which holds the store's keys, make way for ``rows``."""
        if not set(self.manifest(version)["keys"]) <= set(part):
            raise ValueError("rows that share a part must share a bucket")
        return self._change(rows, lambda held: _without(held, rows, part).unionByName(rows), version)

    def swap(self, keys: DataFrame, rows: DataFrame, version: int | None = None) -> int:
        """All rows with one of ``keys`` make way for ``rows``, whose keys are among them; a key may be left without rows."""
        own = self.manifest(version)["keys"]
        return self._change(keys, lambda held: _without(held, keys, own).unionByName(rows), version)

    def delete(self, keys: DataFrame, version: int | None = None) -> int:
        own = self.manifest(version)["keys"]
        return self._change(keys, lambda held: _without(held, keys, own), version)

    def vacuum(self, keep: int = 2) -> int:
        """Forgets all but the last versions and removes folders that none of them names. Only when nobody reads older ones."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/manifests/{v}"), False)
        named = {p for v in versions[-keep:] for p in self.manifest(v)["parts"].values()}
        gone = 0
        for folder in self._fs.listStatus(self._hadoop(f"{self.path}/data")):
            for part in self._fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    gone += self._fs.delete(part.getPath(), True)
        return gone


def _without(held: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``held`` agrees with none of ``rows`` in ``keys``; nulls agree with nulls."""
    marks = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return held.join(marks, same, "left_anti")
