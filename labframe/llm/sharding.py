"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered in the order of doc_id; a keyed Feistel network with cycle walking permutes the numbers 0 to n - 1. The
permuted number p gives shard p mod shards and slot p div shards, so counts differ by one at most, slots have no gaps, and
both can be computed for any row number, or inverted, without the data.

Cases: a null text has no bytes and the CRC of an empty text. Null doc_ids come first. Ties of doc_id are ordered by CRC and
size; rows that are equal in all three may swap places, which changes nothing that is returned. An empty table gives an
empty result. Very long texts are measured whole where they are read; only sizes and CRCs travel. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize

ROUNDS = 6
SIZE_EXTRA = 8


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (two multiplications with shifts) as the round function."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (max(n, 1) - 1).bit_length())
    return (bits + 1) // 2, bits // 2


def _keys(seed: int) -> list[int]:
    return [int(x) for x in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), (seed * 2 + 1) & (2**64 - 1))]


def _network(x: np.ndarray, n: int, seed: int, backwards: bool) -> np.ndarray:
    """One pass over the smallest power of two that holds n. The halves are masked in turn, so they needn't be equal."""
    high, low = _halves(n)
    a, b = x >> np.uint64(low), x & np.uint64((1 << low) - 1)
    order = list(enumerate(_keys(seed)))
    for i, key in order[::-1] if backwards else order:
        if i % 2 == 0:
            a = a ^ (_mix(b, key) & np.uint64((1 << high) - 1))
        else:
            b = b ^ (_mix(a, key) & np.uint64((1 << low) - 1))
    return (a << np.uint64(low)) | b


def permute(rows: np.ndarray, n: int, seed: int = 0, backwards: bool = False) -> np.ndarray:
    """Row numbers to permuted numbers, or back. Whatever lands at n or above walks on; the domain is under twice n, or 4."""
    x = _network(np.asarray(rows, dtype=np.uint64), n, seed, backwards)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], n, seed, backwards)
    return x.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies there."""
    return int(permute(np.array([slot * shards + shard]), n, seed, backwards=True)[0])


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row`` from 0 in the given order, and the number of rows. Only a count per partition reaches the driver.

    The sorted rows are stored first, so partitions can't change between counting and numbering.
    """
    within = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    stored = materialize(within.withColumn("_at", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["count"]) for r in stored.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, count in counts:
        starts.append((int(p), total))
        total += count
    if not starts:
        return stored.withColumn("row", F.lit(0).cast("long")).drop("_at"), 0
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    in_part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("_part", part).join(offsets, "_part").withColumn("row", F.col("_start") + in_part).drop("_at", "_part", "_start"), total


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, law, shard, slot, grown_shard. Texts are read once and never shuffled."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    small = docs.select("doc_id", (F.octet_length(data) + SIZE_EXTRA).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"))
    rows, n = number_rows(small, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(permute(batch.to_numpy(), n, seed))

    placed = rows.withColumn("_p", permuted("row"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
