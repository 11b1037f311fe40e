"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed in Arrow batches. Documents with one fingerprint are one node. Two fingerprints that differ in at
most two of 64 bits agree on at least two of four 16-bit blocks, so candidates meet in six groupings of 32-bit keys. Inside
a group the fingerprints lie as vertical bit planes; carry-save counters, a few machine words wide, add up the differences
of 64 pairs at a time, and a block of pairs is abandoned when all of them exceed the radius. Only a spanning forest of the
links of a group is passed on, so a group of n gives fewer than n rows.

A group with more than ``GROUP_LIMIT`` fingerprints is dealt again by two of the four bytes that its key leaves open. Again
no link is lost, and such a group shares 48 bits, so it can't hold more than 65,536 different fingerprints.

Cases: null, empty and blank texts have fingerprint zero and are linked like others. One or two words are one shingle. Long
texts are read whole. Repeated rows get the same component. Null doc_ids are linked but never name a component, unless all
are null. An empty table gives an empty result. Other columns, whatever their names, are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize
from labframe.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
GROUP_LIMIT = 1024
#: Queries by items of one comparison block.
BLOCK_QUERIES, BLOCK_ITEMS = 256, 8192


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return digest(b" ".join(words), SEED)
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))

    return docs.withColumn(into, fp(F.col(text)))


def planes(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Vertical layout: row b has bit ``bits[b]`` of all items, 64 items a word. Items have one column for each 64 bits."""
    width = -(-len(x) // 64) * 64
    rows = np.zeros((len(bits), width), np.uint8)
    rows[:, : len(x)] = ((x.T[bits // 64] >> (bits % 64)[:, None].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(rows, axis=1, bitorder="little").view("<u8")


def near(x: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of a group's items that differ in at most ``radius`` bits, block by block. Fingerprints of
    more than 64 bits have a column for each 64."""
    n, x = len(x), x.reshape(len(x), -1)
    spread = np.bitwise_or.reduce(x ^ x[0], axis=0)
    bits = np.array([b for b in range(64 * x.shape[1]) if spread[b // 64] >> np.uint64(b % 64) & np.uint64(1)], np.int64)
    counters = max(1, radius.bit_length())
    full = ~np.uint64(0)
    for at in range(0, n, BLOCK_ITEMS):
        items = x[at : at + BLOCK_ITEMS]
        vertical = planes(items, bits)
        for q in range(0, min(n, at + len(items)), BLOCK_QUERIES):
            asked = x[q : q + BLOCK_QUERIES]
            count = [np.zeros((len(asked), vertical.shape[1]), np.uint64) for _ in range(counters)]
            over = np.zeros_like(count[0])
            for k, b in enumerate(bits):
                flip = np.where(asked[:, b // 64] >> np.uint64(b % 64) & np.uint64(1), full, np.uint64(0))
                carry = vertical[k][None, :] ^ flip[:, None]
                for c in range(counters):  # carry-save addition of one bit to every pair's counter
                    count[c], carry = count[c] ^ carry, count[c] & carry
                over |= carry
                if k >= radius and k % 4 == 3 and (over | _above(count, radius) == full).all():
                    break
            else:
                hit = ~(over | _above(count, radius))
                at_q, at_i = np.nonzero(np.unpackbits(hit.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(items)])
                i, j = at_q + q, at_i + at
                ordered = i < j
                if ordered.any():
                    yield i[ordered], j[ordered]


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where a counter of len(count) bits exceeds the radius."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for c in range(len(count) - 1, -1, -1):
        if not radius >> c & 1:
            above, equal = above | (equal & count[c]), equal & ~count[c]
        else:
            equal = equal & count[c]
    return above


def forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the group's links, as pairs of fingerprints."""
    parent = list(range(len(x)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    a, b = [], []
    for i, j in near(x):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(max(p, q))
                b.append(min(p, q))
    return x[a], x[b]


def _links_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For batches sorted by key: links inside each run of one key. The last run is held back until the next key comes."""
    held: list[pd.DataFrame] = []

    def done(frame: pd.DataFrame) -> pd.DataFrame:
        k, x = frame.key.to_numpy(), frame.fp.to_numpy().view(np.uint64)
        if "sub" in frame:
            k = np.stack([k, frame["sub"].to_numpy()])
            cut = np.flatnonzero((np.diff(k, axis=1) != 0).any(axis=0)) + 1
        else:
            cut = np.flatnonzero(np.diff(k)) + 1
        u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        edges = [0, *cut.tolist(), len(x)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > 1:
                p, q = forest(x[lo:hi])
                u.append(p)
                v.append(q)
        return pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    for batch in batches:
        if not len(batch):
            continue
        names = [c for c in ("key", "sub") if c in batch]
        same = (batch[names] == batch[names].iloc[-1]).all(axis=1).to_numpy()
        cut = len(batch) - (len(same) if same.all() else int(np.argmin(same[::-1])))
        held.append(batch.iloc[:cut])
        if cut:
            yield done(pd.concat(held))
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield done(pd.concat(held))


def _two_of_four(column, width: int):
    """Six longs: the number of the pair of parts above the two parts themselves."""
    def part(k):
        return F.shiftrightunsigned(column, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    return F.array(*[
        F.shiftleft(F.lit(n).cast("long"), 2 * width).bitwiseOR(F.shiftleft(part(i), width)).bitwiseOR(part(j))
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ])


def _open_bits(key, fp):
    """The 32 bits of ``fp`` that a key of two 16-bit blocks leaves open, low blocks first."""
    pair = F.shiftright(key, 32)
    out = None
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        lo, hi = [k for k in range(4) if k not in (i, j)]
        value = F.shiftrightunsigned(fp, 16 * lo).bitwiseAND(0xFFFF).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 16 * hi).bitwiseAND(0xFFFF), 16))
        out = F.when(pair == n, value) if out is None else out.when(pair == n, value)
    return out


def link_fingerprints(distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """u, v: links that connect all fingerprints within the radius. ``distinct`` has fp without repeats."""
    keyed = distinct.select("fp", F.explode(_two_of_four(F.col("fp"), 16)).alias("key"))
    sizes = keyed.groupBy("key").count().filter("count > 1")
    met = materialize(keyed.join(sizes, "key"), "meeting")
    small = met.filter(F.col("count") <= group_limit).select("key", "fp").repartition("key").sortWithinPartitions("key")
    links = small.mapInPandas(_links_in_order, "u long, v long")
    large = met.filter(F.col("count") > group_limit)
    subs = large.select("key", "fp", F.explode(_two_of_four(_open_bits(F.col("key"), F.col("fp")), 8)).alias("sub"))
    subs = subs.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return links.unionByName(subs.mapInPandas(_links_in_order, "u long, v long"))


def component_table(prints: DataFrame) -> DataFrame:
    """fp, root, component_id for every fingerprint of ``prints`` (doc_id, fp)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(link_fingerprints(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    prints = materialize(fingerprints(docs.select("doc_id", text), text).select("doc_id", "fp"), "prints")
    table = component_table(prints)
    return prints.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The document with the smallest doc_id of every component, with the columns of ``docs``; repeated rows once."""
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.col(text).alias("body"))
    marked = fingerprints(packed, "body", "own_fp").drop("body")
    prints = materialize(fingerprints(docs.select("doc_id", text), text).select("doc_id", "fp"), "prints")
    keep = prints.join(component_table(prints), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Rows may share the kept id; of their fingerprints in one component the least one stays.
    keep = keep.groupBy("root").agg(F.min("fp").alias("keep_fp"), F.min("doc_id").alias("keep_id"))
    on = (F.col("own_fp") == F.col("keep_fp")) & F.col("own_id").eqNullSafe(F.col("keep_id"))
    return marked.join(keep, on, "left_semi").dropDuplicates(["own_id", "own_fp"]).select("doc.*")
