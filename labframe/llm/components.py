"""Connected components of a link table by alternating large and small stars, each round a few Spark jobs with stored results.

Cases: self-links and links with a null end are ignored; repeated links count once. An empty table gives an empty table.
Columns other than u and v are ignored. A node that a third of all links name is no single task: the least neighbours are
stored before they are joined, so both sides of the join are plain exchanges that Spark splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns u and v. Gives node, root for every node that has a link; root is the smallest node.

    Rounds go on until one changes nothing; each moves links towards smaller nodes only, so they end. Nothing but a row count
    and a checksum of each round reaches the driver.
    """
    greater, lesser = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = materialize(links.filter("u <> v").select(greater, lesser).distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == before or mark["n"] == 0:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        before = tuple(mark)
        edges = materialize(_small(materialize(_large(edges), "links")), "links")
