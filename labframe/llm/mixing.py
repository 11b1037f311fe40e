"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target from its weight. Whole multiples of the source are taken as they are; of the rest, the documents
whose hash lies under a threshold are taken once more. The threshold comes from histograms: sizes are summed by source and
the top bits of the hash, the bucket in which the budget ends is found, and only that bucket is split by the next bits, until
it holds a single hash. No documents are sorted, and thresholds are nested: a larger budget takes a superset.

Cases: null and blank texts have size 0 and are taken like others (their copies cost nothing). The null source is a source
and comes last. Rows with equal doc_id and text have one hash and are taken or left together. Very long texts are read whole; a single one may be larger than a target and is then taken or left as a whole.
An empty table gives an empty
result. Extra columns, whatever their names, pass through. Only totals per source reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labframe.llm.common import WORD_CLASS, materialize

#: Bits of a document's hash, and how many each histogram looks at.
HASH_BITS = 60
STEP_BITS = 12
MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def document_hash(id_col: str = "doc_id", text: str = "text"):
    """60 bits of MD5 over id and text: the same on every engine, and spread evenly."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 15), 16, 10).cast("long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> dict[str | None, float]:
    """Targets by source. Sources by code point, null last, take the weights in turn; all sizes are shared out by weight,
    and what is above ``max_repeat`` times a source goes to the others by weight until none is above."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    left, open_, out = float(sum(size.values())), list(weight), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > max_repeat * size[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = float(max_repeat * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: _source, source_size, target, whole (multiples), threshold (hashes below it are taken once more).

    ``sized`` has _source, _size and _hash.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("_source").agg(F.sum("_size").alias("n")).collect()
    totals = [(r["_source"], r["n"]) for r in rows]
    goal = targets(totals, weights, max_repeat)
    schema = T.StructType([
        T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("whole", T.IntegerType()), T.StructField("budget", T.DoubleType()),
    ])
    made = []
    for s, n in totals:
        whole = min(max_repeat, int(goal[s] // n)) if n else 1
        made.append((s, n, goal[s], whole, goal[s] - whole * n if n and whole < max_repeat else 0.0))
    sources = spark.createDataFrame(made, schema)
    # The boundary starts as all hashes; each step narrows it to one bucket and lowers the budget by the buckets before.
    edge = [(s, 0, b) for s, _, _, _, b in made]
    edges = spark.createDataFrame(edge, "_source string, low long, budget double")
    for used in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        width = 1 << (HASH_BITS - used)
        inside = sized.join(F.broadcast(edges), sized["_source"].eqNullSafe(edges["_source"])).drop(edges["_source"])
        span = width << STEP_BITS
        inside = inside.filter((F.col("_hash") >= F.col("low")) & (F.col("_hash") < F.col("low") + span))
        step = inside.groupBy("_source", "low", "budget", F.floor((F.col("_hash") - F.col("low")) / F.lit(width)).alias("b")).agg(F.sum("_size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("_source").orderBy("b")) - F.col("n")
        # The last bucket that starts within the budget holds the boundary.
        at = step.withColumn("before", before).filter(F.col("before") <= F.col("budget")).groupBy("_source").agg(F.max_by(F.struct("low", "b", "before", "budget", "n"), "b").alias("x"))
        found = at.select("_source", (F.col("x.low") + F.col("x.b") * width).alias("low"), (F.col("x.budget") - F.col("x.before")).alias("budget"), F.col("x.n").alias("n")).collect()
        edges = spark.createDataFrame([(r["_source"], int(r["low"]), float(r["budget"])) for r in found], "_source string, low long, budget double")
        last = found
    # One hash is left per source: it is taken if that comes nearer to the budget.
    over = {r["_source"]: int(r["low"]) + (1 if r["n"] - r["budget"] < r["budget"] else 0) for r in last} if made else {}
    limit = spark.createDataFrame([(s, over.get(s, 0) if b > 0 else 0) for s, _, _, _, b in made], "_source string, threshold long")
    return sources.join(F.broadcast(limit), sources["_source"].eqNullSafe(limit["_source"])).drop(limit["_source"]).drop("budget")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc (the row as a struct, so no column can clash), size, source_size, target, copies (how often the mix takes it)."""
    own = docs.select(F.struct("*").alias("doc"), word_count().alias("_size"), document_hash().alias("_hash"), F.col("source").alias("_source"))
    sized = materialize(own.select("_source", "_size", "_hash"), "mix")
    table = plan(sized, weights, max_repeat)
    joined = own.join(F.broadcast(table), own["_source"].eqNullSafe(table["_source"]), "left").drop(table["_source"])
    copies = F.col("whole") + F.when((F.col("_hash") < F.col("threshold")) & (F.col("whole") < max_repeat), 1).otherwise(0)
    return joined.select("doc", F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken. The small columns are stored once; texts are read once."""
    sized = materialize(docs.select("doc_id", word_count().alias("_size"), document_hash().alias("_hash"), F.col("source").alias("_source")), "mix")
    table = plan(sized.select("_source", "_size", "_hash"))
    joined = sized.join(F.broadcast(table), sized["_source"].eqNullSafe(table["_source"]), "left").drop(table["_source"])
    copies = F.col("whole") + F.when((F.col("_hash") < F.col("threshold")) & (F.col("whole") < MAX_REPEAT), 1).otherwise(0)
    return joined.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with their columns."""
    mixed = mix_documents(docs).filter("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
