"""Line dedup by a segment-partition edit join.

Two lines are linked if at most ``EDITS`` insertions, deletions or substitutions of characters turn one into the other. A
line of length l is cut into EDITS + 1 even segments; one of them survives any EDITS edits. Segments are indexed under
(length, number, bytes); a line probes the indexes of its own and slightly smaller lengths with those substrings only that
can still be the surviving segment. Lines that meet are verified by a bit-parallel automaton that keeps a band of
2 * EDITS + 1 diagonals. Linked lines form classes; of a class, only the first line in the order of (doc_id, line number)
stays in the corpus. For lines under ``MIN_CHARS`` characters two edits would link different words, so no edit is allowed
there: these lines are not indexed, and equal ones form a class.

Equal lines are one line before they are indexed, and each task of the first pass emits a line once, so a line that stands
in every document costs a few rows per task. Inside a meeting group only a spanning forest of the links is emitted. In
large groups a filter on character counts comes before the verification; it loses no link. A group of more than ``GROUP_LIMIT``
lines is dealt again: probes and entries are cut into blocks by hash, and each pair of blocks is a group of its own, so no task
holds more than one block of each and no pair is lost.

Cases: lines are compared without white space at their ends; blank lines stay, as they only part others. Null texts have no
lines. Repeated rows (same doc_id and text) are one document and lose the same lines. Null doc_ids come
first. Very long texts and lines are read whole, and a line is compared from end to end. Empty tables give empty results. Columns of other names pass through ``dedup_lines``; n_chars follows the new text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize, whole_runs
from labframe.llm.components import components

EDITS = 2
#: Lines from this length on are linked by edits, shorter ones only if they are equal.
MIN_CHARS = 30
SEED = 42
#: A task remembers so many lines that it has emitted; then it starts anew.
SEEN_LINES = 1_000_000
#: Groups from this size on are filtered by character counts first.
FILTER_FROM = 24
#: Groups above this size are cut into blocks of half of it.
GROUP_LIMIT = 4096
#: Ids of lines that meet others: up to so many (8 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_IDS = 250_000
_BLANKS = " \t\n\x0b\f\r"


def segments(n: int, k: int = EDITS + 1) -> list[tuple[int, int]]:
    """Start and length of k even segments of a line of n characters; the longer ones come last."""
    base, extra = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = base + (i >= k - extra)
        out.append((at, size))
        at += size
    return out


def selections(n: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(length of the index, segment number, start, size) of the substrings that a line of n characters looks up.

    If segment i of the shorter line is the first to survive, at most i edits lie before it and at most edits - i behind
    it, so its start is shifted by at most i, and by the difference in length give or take edits - i.
    """
    out = []
    for length in range(max(MIN_CHARS, n - edits), n + 1):
        delta = n - length
        for i, (start, size) in enumerate(segments(length, edits + 1)):
            left, right = i, edits - i
            for at in range(max(0, start - left, start + delta - right), min(n - size, start + left, start + delta + right) + 1):
                out.append((length, i, at, size))
    return out


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether at most ``edits`` edits turn a into b: for each number of errors one small bit mask over the diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # what both begin with is left out
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    band = 2 * edits + 1
    all_ = (1 << band) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits)
    # Bit d of alive[e]: b[:j] and a[:j + d - edits] are e edits apart, or fewer.
    alive = [1 << edits]
    for _ in range(edits):
        alive.append(alive[-1] | alive[-1] << 1 & all_)
    for j, c in enumerate(b):
        match = where.get(c, 0) >> j & all_
        before = alive[0]
        alive[0] = before & match
        for e in range(1, edits + 1):
            now = alive[e]
            alive[e] = (now & match) | before | before >> 1 | (alive[e - 1] << 1 & all_)
            before = now
        if not alive[edits]:
            return False
    # Running past the end of a only adds errors that a true end would not have, so the last diagonal decides.
    return bool(alive[edits] >> (len(a) - len(b) + edits) & 1)


def _line_hash(column):
    """63 bits: the lowest is free for the role that a line plays in a group."""
    return F.xxhash64(column).bitwiseAND(F.lit(-2).cast("long"))


def occurrences(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """doc_id, row_key, line_no, line for every line that takes part. row_key tells rows of one doc_id apart."""
    lines = docs.select("doc_id", F.xxhash64(text).alias("row_key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(_BLANKS))).filter(F.length("line") >= min_chars)


def _keys(docs: DataFrame, text: str) -> DataFrame:
    """key, val: hash of an index entry or probe, and the line's hash with the role in the lowest bit (1 for a probe)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        seen: set[int] = set()
        plans: dict[int, tuple[list, list]] = {}
        for batch in batches:
            keys: list[int] = []
            vals: list[int] = []
            for t in batch.iloc[:, 0]:
                for raw in (t or "").split("\n"):
                    line = raw.strip(_BLANKS)
                    n = len(line)
                    if n < MIN_CHARS:
                        continue
                    data = line.encode("utf-8", "surrogatepass")
                    h = digest(data, SEED) & ~1
                    if h in seen:
                        continue
                    if len(seen) >= SEEN_LINES:
                        seen.clear()
                    seen.add(h)
                    if n not in plans:
                        plans[n] = [(n * 4 + i, at, at + size) for i, (at, size) in enumerate(segments(n))], [
                            (length * 4 + i, at, at + size) for length, i, at, size in selections(n)
                        ]
                    own, asked = plans[n]
                    if len(data) == n:
                        keys += [digest(data[a:b], s) for s, a, b in own]
                        keys += [digest(data[a:b], s) for s, a, b in asked]
                    else:
                        keys += [digest(line[a:b].encode("utf-8", "surrogatepass"), s) for s, a, b in own]
                        keys += [digest(line[a:b].encode("utf-8", "surrogatepass"), s) for s, a, b in asked]
                    vals += [h] * len(own)
                    vals += [h | 1] * len(asked)
                if len(keys) > 500_000:
                    yield _longs(key=keys, val=vals)
                    keys, vals = [], []
            yield _longs(key=keys, val=vals)

    return docs.select(text).mapInPandas(emit, "key long, val long")


def _longs(**columns: list[int]) -> pd.DataFrame:
    return pd.DataFrame({k: np.array(v, dtype=np.uint64).view(np.int64) for k, v in columns.items()})


def _runs(batches: Iterator[pd.DataFrame], handle) -> Iterator[pd.DataFrame]:
    """Calls ``handle`` with frames that hold whole runs of one key; the batches are sorted by key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch.key.to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        held.append(batch.iloc[:cut])
        if cut:
            yield handle(pd.concat(held))
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield handle(pd.concat(held))


def meetings(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, id, probe: the rows of all groups in which a probe meets the index entry of another line."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates()
        k, v = frame.key.to_numpy(), frame.val.to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        probe, line = v & 1, v & ~np.int64(1)
        differ = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
        both = (np.minimum.reduceat(probe, starts) == 0) & (np.maximum.reduceat(probe, starts) == 1)
        keep = np.repeat(differ & both, np.diff(np.concatenate((starts, [len(k)]))))
        return pd.DataFrame({"key": k[keep], "id": line[keep], "probe": probe[keep].astype(bool)})

    rows = _keys(docs, text).repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(lambda batches: _runs(batches, meet), "key long, id long, probe boolean")


def _counts(lines: list[str]) -> np.ndarray:
    """Characters by code point modulo 16. One edit changes two of the counts by one at most."""
    out = np.zeros((len(lines), 16), np.int32)
    for row, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[row] = np.bincount(codes & 15, minlength=16)
    return out


def group_links(ids: np.ndarray, lines: list[str], probe: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between probes and index entries of one group."""
    parent = {i: i for i in ids.tolist()}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    u, v = [], []
    asks, holds = np.flatnonzero(probe), np.flatnonzero(~probe)
    counts = _counts(lines) if len(ids) >= FILTER_FROM else None
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    for p in asks.tolist():
        near = holds[np.abs(size[holds] - size[p]) <= EDITS]
        if counts is not None and len(near):
            near = near[np.abs(counts[near] - counts[p]).sum(axis=1) <= 2 * EDITS]
        for q in near.tolist():
            a, b = find(int(ids[p])), find(int(ids[q]))
            if a != b and within(lines[p], lines[q]):
                parent[max(a, b)] = min(a, b)
                u.append(max(a, b))
                v.append(min(a, b))
    return u, v


def dealt(met: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``met`` with the cell (p, e) of each row: a probe goes to all blocks of entries, an entry to all blocks of probes."""
    sizes = met.groupBy("key").count().filter(F.col("count") > group_limit)
    sizes = sizes.select("key", F.ceil(F.col("count") / max(1, group_limit // 2)).cast("int").alias("blocks"))
    rows = met.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", "id", "probe", F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).alias("p"), F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).alias("e"))


def links(docs: DataFrame, text: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """u, v: hashes of lines whose links connect every class."""
    met = materialize(meetings(docs, text), "meeting")
    ids = materialize(met.select("id").distinct(), "ids")
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    lines = occurrences(docs, text, MIN_CHARS).select(_line_hash(F.col("line")).alias("id"), "line")
    lines = lines.join(F.broadcast(ids) if small else ids, "id", "left_semi").distinct()
    cell = ["key", "p", "e"]
    grouped = dealt(met, group_limit).join(lines, "id").repartition(*cell).sortWithinPartitions(*cell)

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        k = frame[cell].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1)))).tolist()
        u, v = [], []
        for lo, hi in zip(starts, [*starts[1:], len(k)], strict=True):
            part = frame.iloc[lo:hi]
            a, b = group_links(part.id.to_numpy(), part.line.tolist(), part.probe.to_numpy())
            u += a
            v += b
        return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

    return grouped.mapInPandas(lambda batches: whole_runs(batches, cell, verify), "u long, v long")


def line_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_key, line_no, kept, first_id: for every line that takes part, whether it stays and whose line stays."""
    roots = components(links(docs, text))
    hashed = occurrences(docs, text).select("doc_id", "row_key", "line_no", _line_hash(F.col("line")).alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    rows = materialize(hashed, "lines")
    # Lines without a link are told apart by 127 bits; linked ones go by the root of their class.
    joined = rows.join(roots.withColumnRenamed("node", "h"), "h", "left")
    classed = joined.select("doc_id", "row_key", "line_no", F.coalesce("root", "h").alias("c"), F.when(F.col("root").isNull(), F.col("h2")).alias("c2"))
    place = F.struct("doc_id", "line_no", "row_key")
    first = classed.groupBy("c", "c2").agg(F.min(place).alias("first")).withColumnRenamed("c", "k").withColumnRenamed("c2", "k2")
    on = (F.col("c") == F.col("k")) & F.col("c2").eqNullSafe(F.col("k2"))
    return classed.join(first, on).select("doc_id", "row_key", "line_no", (place == F.col("first")).alias("kept"), F.col("first.doc_id").alias("first_id"))


def removed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_key, removed (line numbers) of the documents that lose lines."""
    gone = line_classes(docs, text).filter(~F.coalesce("kept", F.lit(True)))
    return gone.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))


def dedup_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed_lines (numbers), first_ids (documents that keep them)."""
    own = docs.select("doc_id", F.xxhash64(text).alias("row_key"), F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"))
    gone = removed_lines(docs, text).withColumnsRenamed({"doc_id": "_id", "row_key": "_row"})
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_row")), "left")
    none = F.array().cast("array<int>")
    return joined.select(
        "doc_id", "n_lines", F.coalesce(F.size(F.coalesce("removed", none)), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed_lines"), F.coalesce("first_ids", F.array().cast("array<long>")).alias("first_ids"),
    )


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the lines that go, in the same columns."""
    gone = removed_lines(docs.select("doc_id", text), text).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_row"), "removed")
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_row"), F.col(text).alias("body"))
    joined = packed.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_row") == F.col("gone_row")), "left")
    kept = F.array_join(F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    cut = F.col("doc").withField(f"`{text}`", kept)
    if "n_chars" in docs.columns:
        cut = cut.withField("n_chars", F.length(kept).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("removed").isNull(), F.col("doc")).otherwise(cut).alias("doc")).select("doc.*")
