"""Near-duplicate documents at a similarity of 0.8: SimHash's bit-sliced comparison on candidates from min-wise bands.

Two texts are linked if of their different five-word shingles together at least four in five are common to both (Jaccard
similarity of 0.8). Such texts differ in a sixth of the bits of their SimHash, so no grouping by equal blocks of bits finds
them; the grouping here is by bands of least hashes instead. ``BANDS`` keys of ``ROWS`` least hashes each are made per text; a
pair at the limit shares none of them with probability (1 - 0.8 ** 4) ** 40, under one in a billion. Inside a group,
fingerprints of 128 bits are compared as vertical bit planes (``simhash.near``); RADIUS lies 5.9 standard deviations above the
distance expected at the limit. Texts of few shingles have rough fingerprints and skip that filter. What passes is verified on
all shingles.

It goes in two rounds. First two pairs per text: with its neighbour by size, and with the middle of one of its groups, the text
whose fingerprint is nearest to the majority of the group's bits. Near-copies of one text are linked so, and most groups have one
component; these are done. In the others pairs of different components follow. Small groups give these pairs as rows. Large
groups are cut into blocks, and each pair of blocks is compared inside a task on the shingles themselves: their numbers in
common come from products of incidence matrices, and only a spanning forest of the links leaves the task. A group of many
near-copies thus costs a few rows per text, linked or not.

Cases: words are compared in lower case; texts of up to five words are one shingle. Null, empty and blank texts are alike.
Texts with the same shingles are one node. Repeated rows are one document. Null doc_ids are linked but never stay, unless all
of a component are null. An empty table gives an empty result. Columns of other names pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize, whole_runs
from labframe.llm.components import components
from labframe.llm.simhash import near

SHINGLE = 5
#: Similarity as a fraction.
SHARE, OF = 4, 5
SEED = 42
BANDS, ROWS = 40, 4
RADIUS = 43
#: Texts of so many shingles or fewer are compared without fingerprints.
FEW = 64
#: Groups up to this size give pairs as rows; larger ones are compared inside tasks.
SMALL_GROUP = 48
#: Such groups are cut into blocks of half of so many texts, and of so many shingles.
GROUP_LIMIT, BLOCK_SHINGLES = 2048, 2_000_000
#: A task remembers so many hashes of words; then it starts anew.
SEEN_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= SEEN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(n, SHINGLE)
    if not n:
        return h
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : n - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key per band: the least hashes under ROWS multipliers, mixed with the number of the band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(s), 1024):
        least = np.minimum(least, (s[at : at + 1024, None] * _FACTORS).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(31)
    return out


def fingerprint(s: np.ndarray) -> np.ndarray:
    """SimHash of 128 bits: a bit is 1 if set in over half the shingles' hashes; the second word is of the hashes mixed again."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(s), 1 << 14):
        part = s[at : at + (1 << 14)]
        again = (part ^ (part >> np.uint64(32))) * _FACTORS[0]
        both = np.stack([part * _MIX, again ^ (again >> np.uint64(31))], axis=1).astype("<u8").view(np.uint8)
        ones += np.unpackbits(both, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(s), bitorder="little").view("<u8")


def alike(common, n, m):
    """Whether sets of n and m shingles with so many in common are near duplicates."""
    return (SHARE + OF) * common >= SHARE * (n + m)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_key, node, n, f0, f1, bands for every row: the hash of its shingles, their number, fingerprint, band keys."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                sets = [shingles(t, words) for t in part.text]
                prints = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pd.DataFrame({
                    "doc_id": part.doc_id, "row_key": part.row_key, "node": np.array([node_of(s) for s in sets], np.uint64).view(np.int64),
                    "n": np.array([len(s) for s in sets], np.int64), "f0": prints[:, 0], "f1": prints[:, 1],
                    "bands": [band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets],
                })

    own = docs.select("doc_id", F.xxhash64(text).alias("row_key"), F.col(text).alias("text"))
    return own.mapInPandas(emit, "doc_id long, row_key long, node long, n long, f0 long, f1 long, bands array<long>")


def _starts(k: np.ndarray) -> list[int]:
    """Where the runs of equal rows begin, and the end."""
    return [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]


def _middle(f: np.ndarray) -> tuple[int, np.ndarray]:
    """The item nearest to the majority of bits, and the distance of all items from it."""
    bits = np.unpackbits(f.view(np.uint8), axis=1)
    at = int(np.argmin((bits != (bits.mean(axis=0) > 0.5)).sum(axis=1)))
    return at, np.bitwise_count(f ^ f[at]).sum(axis=1)


def meetings(nodes: DataFrame) -> DataFrame:
    """key, node, n, f0, f1, prev, mid, far: the groups of two texts or more. prev is a text's neighbour by size, mid the middle of
    the group and far its distance; both null where they can't be alike."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        k, node, n = (frame[c].to_numpy() for c in ("key", "node", "n"))
        f = np.ascontiguousarray(frame[["f0", "f1"]].to_numpy()).view(np.uint64)
        follows = np.concatenate(([False], k[1:] == k[:-1]))[: len(k)]
        keep = follows | np.concatenate((follows[1:], [False]))[: len(k)]

        def possible(m, far):
            return (OF * np.minimum(n, m) >= SHARE * np.maximum(n, m)) & ((far <= RADIUS) | (np.minimum(n, m) <= FEW))

        prev = pd.array(np.roll(node, 1), dtype="Int64")
        prev[~(follows & possible(np.roll(n, 1), np.bitwise_count(f ^ np.roll(f, 1, axis=0)).sum(axis=1)))] = pd.NA
        middle, size, far = node.copy(), n.copy(), np.zeros(len(k), np.int64)
        edges = np.flatnonzero(~follows).tolist() + [len(k)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > 2:
                at, far[lo:hi] = _middle(f[lo:hi])
                middle[lo:hi], size[lo:hi] = node[lo + at], n[lo + at]
        mid = pd.array(middle, dtype="Int64")
        mid[(middle == node) | ~possible(size, far)] = pd.NA
        return pd.DataFrame({"key": k, "node": node, "n": n, "f0": frame.f0, "f1": frame.f1, "prev": prev, "mid": mid, "far": far})[keep]

    rows = nodes.select(F.explode("bands").alias("key"), "node", "n", "f0", "f1").repartition("key").sortWithinPartitions("key", "n", "node")
    return rows.mapInPandas(lambda batches: whole_runs(batches, ["key"], meet), "key long, node long, n long, f0 long, f1 long, prev long, mid long, far long")


def near_pairs(n: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a group that can be alike. Sizes are in rising order."""
    few = int(np.searchsorted(n, FEW * OF // SHARE, side="right"))
    for i in range(few - 1):
        j = np.arange(i + 1, min(few, int(np.searchsorted(n, n[i] * OF // SHARE, side="right"))))
        yield np.full(len(j), i), j
    first = int(np.searchsorted(n, FEW, side="right"))
    if len(n) - first > 1:
        for i, j in near(f[first:], RADIUS):
            i, j = i + first, j + first
            ok = (OF * n[i] >= SHARE * n[j]) & (j >= few)
            yield i[ok], j[ok]


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n, f0, f1, root, size, total: the groups that hold several components; stored."""
    rooted = met.select("key", "node", "n", "f0", "f1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").drop("a", "b")
    return materialize(rooted.join(sizes, "key"), "unsettled")


def small_pairs(rows: DataFrame) -> DataFrame:
    """u, v: the pairs of different components that meet in small groups and can be alike."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        k, f = frame[["key"]].to_numpy(), np.ascontiguousarray(frame[["f0", "f1"]].to_numpy()).view(np.uint64)
        node, n, root = (frame[c].to_numpy().astype(np.int64) for c in ("node", "n", "root"))
        edges = _starts(k)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            for i, j in near_pairs(n[lo:hi], f[lo:hi]) if hi > lo else ():
                i, j = i + lo, j + lo
                ok = root[i] != root[j]
                u.append(node[i[ok]])
                v.append(node[j[ok]])
        a, b = np.concatenate(u), np.concatenate(v)
        return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)}).drop_duplicates()

    dealt = rows.select("key", "node", "n", "f0", "f1", "root").repartition("key").sortWithinPartitions("key", "n", "node")
    return dealt.mapInPandas(lambda batches: whole_runs(batches, ["key"], meet), "u long, v long").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common. Elements of many sets go through matrix products, a slice of
    columns at a time, those of few sets pair by pair."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, seen = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    column = np.cumsum(seen > 7) - 1
    many = seen[at] > 7
    rows, columns = owner[many], column[at[many]]
    for lo in range(0, int((seen > 7).sum()), 4096):
        some = (columns >= lo) & (columns < lo + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[rows[some], columns[some] - lo] = 1
        out += m @ m.T
    order = np.argsort(at[~many], kind="stable")
    rows, group = owner[~many][order], at[~many][order]
    for step in range(1, 7):
        same = group[step:] == group[:-step]
        np.add.at(out, (rows[:-step][same], rows[step:][same]), 1)
        np.add.at(out, (rows[step:][same], rows[:-step][same]), 1)
    return out


def large_links(rows: DataFrame, sets: DataFrame, group_limit: int) -> DataFrame:
    """u, v: links that connect the components of large groups, found on the shingles. ``sets`` has node, s."""
    blocks = F.when((F.col("size") > group_limit) | (F.col("total") > BLOCK_SHINGLES), F.ceil(F.greatest(2 * F.col("size") / group_limit, 2 * F.col("total") / BLOCK_SHINGLES))).otherwise(1)
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A pair of blocks is one cell; inside a block pairs are compared in the cell of the block with the next one.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks < 2 OR own <> other")
    dealt = dealt.select("key", "node", "root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).join(sets, "node")
    names = ["key", "lo", "hi"]

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        k, node, root = frame[names].to_numpy(), frame.node.to_numpy(), frame.root.to_numpy()
        edges, u, v = _starts(k), [], []
        for lo, hi in zip(edges, edges[1:], strict=False):
            sets_ = frame.s.iloc[lo:hi].tolist()
            n = np.array([len(x) for x in sets_])
            i, j = np.nonzero(np.triu(alike(common_counts(sets_), n[:, None], n[None, :]), 1))
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            apart = root[lo + i] != root[lo + j]
            for p, q in zip((lo + i[apart]).tolist(), (lo + j[apart]).tolist(), strict=True):
                a, b = find(int(root[p])), find(int(root[q]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    u.append(max(node[p], node[q]))
                    v.append(min(node[p], node[q]))
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    cells = dealt.repartition(*names).sortWithinPartitions(*names, "node")
    return cells.mapInPandas(lambda batches: whole_runs(batches, names, meet), "u long, v long")


def node_sets(nodes: DataFrame, docs: DataFrame, own: DataFrame, text: str) -> DataFrame:
    """node, s: the shingles of the named nodes, made again from one text each; stored."""
    places = own.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                yield pd.DataFrame({"node": part.node, "s": [shingles(t, words).view(np.int64) for t in part.text]})

    texts = docs.select(F.xxhash64(text).alias("row_key"), F.col(text).alias("text")).join(places, "row_key").dropDuplicates(["node"])
    return materialize(texts.select("node", "text").mapInPandas(emit, "node long, s array<long>"), "sets")


def verified(asked: DataFrame, docs: DataFrame, own: DataFrame, text: str) -> DataFrame:
    """The pairs (u, v) that are near duplicates."""
    asked = materialize(asked, "asked")
    sets = node_sets(asked.select(F.col("u").alias("node")).union(asked.select("v")), docs, own, text)

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in zip(a, b, strict=True)], dtype=bool)

    left = asked.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return materialize(both.filter(similar("a", "b")).select("u", "v"), "similar")


def component_table(docs: DataFrame, own: DataFrame, text: str = "text", group_limit: int = GROUP_LIMIT, small_group: int = SMALL_GROUP) -> DataFrame:
    """node, root for every node that has a near duplicate. ``own`` comes from ``sketches`` of ``docs``."""
    nodes = own.select("node", "n", "f0", "f1", "bands").filter("n > 0").dropDuplicates(["node"])
    met = materialize(meetings(nodes), "meeting")
    firsts = met.groupBy("node").agg(F.min("prev").alias("prev"), F.min_by("mid", F.when(F.col("mid").isNotNull(), F.struct("far", "mid"))).alias("mid"))
    asked = firsts.select("node", F.explode(F.array("prev", "mid")).alias("to")).filter("to IS NOT NULL")
    found = verified(asked.select(F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v")).distinct(), docs, own, text)
    rest = unsettled(met, components(found))
    links = found.unionByName(verified(small_pairs(rest.filter(F.col("size") <= small_group)), docs, own, text))
    large = rest.filter(F.col("size") > small_group)
    return components(links.unionByName(large_links(large, node_sets(large, docs, own, text), group_limit)))


def keep_one(docs: DataFrame, text: str = "text", group_limit: int = GROUP_LIMIT, small_group: int = SMALL_GROUP) -> DataFrame:
    """The document with the smallest doc_id of every component, with the columns of ``docs``; repeated rows once."""
    own = materialize(sketches(docs, text), "sketches")
    roots = component_table(docs, own, text, group_limit, small_group)
    rooted = own.select("doc_id", "row_key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Rows may share the least id; of their texts the one with the least hash stays.
    first = F.min_by(F.struct("doc_id", "row_key"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key")))
    keep = rooted.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.row_key").alias("keep_row"))
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_row"))
    on = F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_row") == F.col("keep_row"))
    return packed.join(keep, on, "left_semi").dropDuplicates(["own_id", "own_row"]).select("doc.*")
