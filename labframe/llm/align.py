"""Alignment of two tokenizers by the places where tokens of both end.

A is a byte-level vocabulary of the tokenizers library, which gives a character offset with every token; B is a sentencepiece
model with byte fallback, which gives a span of the surface with every piece. Where clean ends of both meet, the text is cut
(coarse cuts). Tokens that hold only part of a character, and byte-fallback pieces, have no clean end: groups with such tokens
are cut further where the decoded bytes of both sides end at the same byte, which may be inside a character.

Tokens that share a group are linked. ``align_documents`` counts links, and for each pair of ids the documents of the whole
corpus that hold it linked. Texts go through in blocks of bounded size: a block keeps the different pairs of its documents once,
with their counts, and each document as numbers of these pairs. Only the blocks' pairs are shuffled to be counted; the totals
come back by block and meet the block's documents. No document, and no pair, is a shuffle key with all its occurrences, so a
pair that every document holds costs one row a block.

Each different stretch between spaces is aligned once a block and kept for the next ones in a bounded table.

Cases: null and empty texts have no tokens and give zeros and an empty groups_sha256. So do texts whose tokens don't give back
the space and the text, which are those with U+2581 in them. Names of special tokens inside texts are plain text. Very long
texts are read whole; one is a block of its own if it is larger than a block. Repeated rows are documents of their own and
count as such. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labframe.llm.common import materialize
from labframe.llm.stretches import Seen, cut, distinct, join, runs, slices, sums, together

#: Bytes of text in a block. A task holds one block; larger blocks send fewer pairs through the shuffle.
BLOCK_BYTES = 8_000_000
#: Stretches that a worker keeps from one block to the next.
TABLE_ENTRIES = 300_000
#: Groups with more links than this are counted by their different ids instead of link by link.
LARGE_GROUP = 4096
#: Ids are below two to this power; a stretch's number and two ids make one key of 64 bits.
ID_BITS = 20
#: Stretches that are studied at a time.
STUDIED = 50_000
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Stretches:
    """What is known of stretches: counts, their groups as text, and the pairs of ids that they link, with how often."""

    COUNTS = ("n_a", "n_b", "n_groups", "n_links", "good")

    def __init__(self, counts: np.ndarray, text: pa.Array, first: np.ndarray, pairs: np.ndarray, times: np.ndarray):
        self.counts, self.text, self.first, self.pairs, self.times = counts, text, first, pairs, times

    @classmethod
    def none(cls) -> Stretches:
        none = np.zeros(0, np.int64)
        return cls(np.zeros((len(cls.COUNTS), 0), np.int64), pa.array([], pa.large_string()), np.zeros(1, np.int64), none, none)

    def with_more(self, more: Stretches) -> Stretches:
        return Stretches(
            np.concatenate([self.counts, more.counts], axis=1), pa.concat_arrays([self.text, more.text]), np.concatenate([self.first, self.first[-1] + more.first[1:]]),
            np.concatenate([self.pairs, more.pairs]), np.concatenate([self.times, more.times]),
        )

    def take(self, at: np.ndarray) -> Stretches:
        lengths = np.diff(self.first)[at]
        links = runs(self.first[at], lengths)
        return Stretches(self.counts[:, at], self.text.take(pa.array(at)), np.concatenate([[0], np.cumsum(lengths)]), self.pairs[links], self.times[links])


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the table of stretches."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte_of = byte_alphabet()
        with open(a_file, encoding="utf-8") as f:
            special = {x["id"] for x in json.load(f)["added_tokens"]}
        by_id = {i: piece for piece, i in self.a.get_vocab().items()}
        self.a_bytes = [b"" if i in special or i not in by_id else bytes(byte_of[c] for c in by_id[i]) for i in range(max(by_id) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.b_is_byte, strict=True)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece holds a space behind other text, so texts can't be cut at spaces")
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError("a vocabulary with too many ids")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.seen, self.table = Seen(TABLE_ENTRIES), Stretches.none()

    def encoded(self, texts: list[str]):
        """Ids, starts and ends in characters of A over space and text, and of B over the text, whose space before it is its own."""
        for x, y in zip(self.a.encode_batch([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, return_type="offset_mapping", num_threads=1), strict=True):
            yield x.ids, x.offsets, y["ids"], y["offsets"]

    def gives_back(self, text: str, a_ids: list[int], b_ids: list[int]) -> bool:
        data = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a_ids)) == data == b"".join(map(self.b_bytes.__getitem__, b_ids))

    def cuts(self, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where groups end, in bytes, and where each token of A and of B ends. Offsets count the characters of all texts."""
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # A token ends cleanly if the next one starts no earlier. Bytes of a character but its last have no width of their own.
        clean_a = np.append(a_off[1:, 0] >= a_off[:-1, 1], True)
        part = self.b_is_byte[b] & (b_off[:, 0] == b_off[:, 1])
        clean_b = ~part
        wide = np.minimum.accumulate(np.where(part, len(b), np.arange(len(b)))[::-1])[::-1]
        b_char = b_off[np.minimum(wide, len(b) - 1), 1]
        coarse = np.intersect1d(a_off[clean_a, 1], b_off[clean_b, 1])
        # Groups with a token that splits a character are refined by the decoded bytes.
        split = np.zeros(len(coarse) + 1, bool)
        at_a, at_b = np.searchsorted(coarse, a_off[:, 1]), np.searchsorted(coarse, b_char)
        split[at_a[~clean_a]] = split[at_b[part]] = True
        found = a_end[clean_a & np.isin(a_off[:, 1], coarse)]
        if split.any():
            found = np.union1d(found, np.intersect1d(a_end[split[at_a]], b_end[split[at_b]]))
        return found, a_end, b_end

    def aligned(self, texts: list[str]):
        """Flat ids of A and B over all texts, the ends of groups, of A's and of B's tokens and of texts, all in bytes."""
        a, b, a_off, b_off, at = [], [], [], [], 0
        for text, (a_ids, a_chars, b_ids, b_chars) in zip(texts, self.encoded(texts), strict=True):
            a.append(a_ids)
            b.append(b_ids)
            a_off.append(np.array(a_chars, np.int64).reshape(-1, 2) + at)
            b_off.append(np.array(b_chars, np.int64).reshape(-1, 2) + (at + 1))
            at += len(text) + 1
        a, b = (np.array([i for ids in x for i in ids], np.int64) for x in (a, b))
        return a, b, *self.cuts(a, np.concatenate(a_off), b, np.concatenate(b_off))

    def study(self, stretches: pa.Array, ok: pa.Array | None = None) -> Stretches:
        """The stretches, which are not empty, one by one. Those that can't be given back (not ok) are studied as if they were x."""
        if ok is None:  # B writes U+2581 like a space
            ok = pc.invert(pc.match_substring(stretches, "▁"))
        shown = pc.if_else(ok, stretches, "x")
        texts, order = together(shown)
        a, b, ends, a_end, b_end = self.aligned(texts)
        edge = np.cumsum(pc.binary_length(shown).to_numpy()[order] + 1)
        if not self.gives_back("".join(" " + t for t in texts), a.tolist(), b.tolist()):
            alone = pa.array([good and self.gives_back(" " + s, *next(self.encoded([s]))[::2]) for s, good in zip(shown.to_pylist(), ok.to_pylist(), strict=True)])
            if alone.equals(ok):
                raise ValueError("stretches that are not independent of each other")
            return self.study(stretches, alone)
        n, groups = len(order), len(ends)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        home = np.searchsorted(edge, ends)  # the stretch of a group
        a_first, b_first = np.searchsorted(a_group, np.arange(groups + 1)), np.searchsorted(b_group, np.arange(groups + 1))
        a_many, b_many = np.diff(a_first), np.diff(b_first)
        counts = np.zeros((5, n), np.int64)
        counts[0], counts[1] = (np.bincount(home[x], minlength=n) for x in (a_group, b_group))
        counts[2] = np.bincount(home, minlength=n)
        np.add.at(counts[3], home, a_many * b_many)
        counts[4] = ok.to_numpy(zero_copy_only=False)[order]
        sides = [join(pa.array(ids).cast(pa.large_string()), first, ",") for first, ids in ((a_first, a), (b_first, b))]
        text = join(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), np.searchsorted(home, np.arange(n + 1)), ";")
        first, pairs, times = self._pairs(a, b, a_first, b_first, home, n)
        back = np.argsort(order)
        return Stretches(counts, text, first, pairs, times).take(back)

    def _pairs(self, a, b, a_first, b_first, home, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The linked pairs of each stretch, sorted, as A's id above ID_BITS and B's id, and how often each is linked."""
        a_many, b_many = np.diff(a_first), np.diff(b_first)
        large = a_many * b_many > LARGE_GROUP
        groups = np.flatnonzero(~large)
        left = runs(a_first[groups], a_many[groups])
        of = np.repeat(groups, a_many[groups])
        right = runs(b_first[of], b_many[of])
        left, of = np.repeat(left, b_many[of]), np.repeat(of, b_many[of])
        keys, times = [home[of] << 2 * ID_BITS | a[left] << ID_BITS | b[right]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(large).tolist():
            (x, nx), (y, ny) = (np.unique(ids[first[g] : first[g + 1]], return_counts=True) for ids, first in ((a, a_first), (b, b_first)))
            keys.append((home[g] << 2 * ID_BITS | x[:, None] << ID_BITS | y).ravel())
            times.append((nx[:, None] * ny).ravel())
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate(times), minlength=len(keys)).astype(np.int64)
        return np.searchsorted(keys, np.arange(n + 1) << 2 * ID_BITS), keys & ((1 << 2 * ID_BITS) - 1), times

    def slots_of(self, stretches: pa.Array) -> np.ndarray:
        """Numbers in the table; what is new is studied and added."""
        slots, new, kept = self.seen.slots(stretches)
        if kept is not None:
            self.table = self.table.take(kept)
        for at in range(0, len(new), STUDIED):
            self.table = self.table.with_more(self.study(new.slice(at, STUDIED)))
        return slots

    def groups(self, text: str | None) -> list[tuple[int, int, list[int], list[int]]]:
        """The groups of one text: start and end in bytes of space and text, ids of A, ids of B. None if it can't be given back."""
        if not text or "▁" in text:
            return []
        a, b, ends, a_end, b_end = self.aligned([text])
        if not self.gives_back(" " + text, a.tolist(), b.tolist()):
            return []
        starts = [0, *ends[:-1].tolist()]
        a_at, b_at = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
        return [(s, e, x.tolist(), y.tolist()) for s, e, x, y in zip(starts, ends.tolist(), np.split(a, a_at[:-1]), np.split(b, b_at[:-1]), strict=True)]


def aligner_for(a_file: str, b_file: str) -> Aligner:
    """One aligner per Python worker; the worker is reused for many tasks."""
    key = (a_file, b_file)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*(f if os.path.exists(f) else SparkFiles.get(os.path.basename(f)) for f in key))
    return _ALIGNERS[key]


def token_groups(docs: DataFrame, a_file: str, b_file: str, text: str = "text", into: str = "groups") -> DataFrame:
    """``docs`` with the groups of each text: their bytes in space and text, and the ids of both tokenizers."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    @F.arrow_udf(kind)
    def grouped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = aligner_for(a_file, b_file)
        for batch in batches:
            yield pa.array([[dict(zip(("start", "end", "a", "b"), g, strict=True)) for g in aligner.groups(t)] for t in batch.to_pylist()], arrow)

    return docs.withColumn(into, grouped(F.col(text)))


#: A block's documents, one row each, and one row with its pairs: their codes and how many of its documents hold each.
BLOCK = "block long, pairs array<long>, held array<int>, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
#: Parquet names of the documents' columns that pass through.
PASSED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """A document's links: steps between the sorted numbers of its pairs, and how often each is linked."""
    return np.concatenate([np.diff(pairs, prepend=0), times]).astype("<i8").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, times = np.frombuffer(data, "<i8").reshape(2, -1)
    return np.cumsum(steps), times


def _block(aligner: Aligner, number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    found, index, edges = cut(texts)
    used, place = distinct(index, len(found))
    slots = aligner.slots_of(found.take(pa.array(used)))[place]
    table, docs = aligner.table, len(texts)
    void = sums(1 - table.counts[4][slots], edges) > 0
    n = [np.where(void, 0, sums(table.counts[k][slots], edges)) for k in range(4)]
    whole = join(table.text.take(pa.array(slots)), edges, ";")
    digests = ["" if none else hashlib.sha256(t.encode()).hexdigest() for none, t in zip((void | (n[0] == 0)).tolist(), whole.to_pylist(), strict=True)]
    # Different stretches of each document, then their pairs.
    doc = np.repeat(np.arange(docs), np.diff(edges))
    kept = ~void[doc]
    keys, many = np.unique(doc[kept] * (len(table.first) + 1) + slots[kept], return_counts=True)
    doc, slot = keys // (len(table.first) + 1), keys % (len(table.first) + 1)
    used, place = distinct(slot, len(table.first) - 1)
    part = table.take(used)
    codes, number_of = np.unique(part.pairs, return_inverse=True)
    lengths = np.diff(part.first)[place]
    at = runs(part.first[place], lengths)
    keys, inverse = np.unique(np.repeat(doc, lengths) * max(1, len(codes)) + number_of[at], return_inverse=True)
    times = np.bincount(inverse, weights=part.times[at] * np.repeat(many, lengths), minlength=len(keys)).astype(np.int64)
    doc, pair = keys // max(1, len(codes)), keys % max(1, len(codes))
    first = np.searchsorted(doc, np.arange(docs + 1))
    packer = zstandard.ZstdCompressor(1)
    links = [packer.compress(_pack(pair[lo:hi], times[lo:hi])) for lo, hi in zip(first[:-1], first[1:], strict=True)]
    held = np.bincount(pair, minlength=len(codes))
    none = pa.nulls(1, pa.int64())
    columns = [
        pa.array(np.full(docs + 1, number)), pa.array([codes, *[None] * docs], pa.list_(pa.int64())), pa.array([held, *[None] * docs], pa.list_(pa.int32())),
        pa.concat_arrays([none, ids.cast(pa.int64())]), *[pa.concat_arrays([none, pa.array(x)]) for x in n],
        pa.array([None, *digests], pa.string()), pa.array([None, *links], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "pairs", "held", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def align_blocks(docs: DataFrame, a_file: str, b_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of ``docs``, which has doc_id and text, stored in the shared folder."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(a_file, b_file)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for at, some in slices(batch.column(1), block_bytes):
                if texts and size + some.nbytes > block_bytes:
                    yield _block(aligner, number, pa.concat_arrays(ids), pa.concat_arrays(texts))
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(batch.column(0).slice(at, len(some)))
                texts.append(some)
                size += some.nbytes
            pa.default_memory_pool().release_unused()
        if texts:
            yield _block(aligner, number, pa.concat_arrays(ids), pa.concat_arrays(texts))

    return materialize(docs.select("doc_id", "text").mapInArrow(blocks, BLOCK), "align", "zstd")


def _dictionary(blocks: DataFrame) -> DataFrame:
    """Rows block, number, pair, n: how many documents of the block hold the pair."""
    listed = blocks.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("number", "x"))
    return listed.select("block", "number", F.col("x.pairs").alias("pair"), F.col("x.held").cast("long").alias("n"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, pair, n_docs and best: how many documents hold the pair linked, and whether no pair of a has more.

    One row per id of A is broadcast, which its vocabulary bounds.
    """
    counts = materialize(_dictionary(blocks).groupBy("pair").agg(F.sum("n").alias("n_docs")), "pairs")
    a, b = F.shiftright("pair", ID_BITS).cast("int"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).cast("int")
    counts = counts.select(a.alias("a"), b.alias("b"), "pair", "n_docs")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_file: str, b_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = align_blocks(docs, a_file, b_file, block_bytes)
    totals = _dictionary(blocks).drop("n").join(pair_counts(blocks), "pair").select(F.col("block").alias("of"), "number", "n_docs", "best")

    def summed(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        number = right["number"].to_numpy()
        count, best = np.zeros((2, len(number)), np.int64)
        count[number], best[number] = right["n_docs"].to_numpy(), right["best"].cast(pa.int8()).to_numpy()
        unpacker = zstandard.ZstdDecompressor()
        links = [_unpack(unpacker.decompress(x)) for x in left["links"].to_pylist()]
        n_best, total = (pa.array([int((times * of[pairs]).sum()) for pairs, times in links], pa.int64()) for of in (best, count))
        return left.select(PASSED).append_column("n_best", n_best).append_column("count_sum", total)

    result = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    rows = blocks.filter("pairs is null").select("block", *PASSED, "links")
    return rows.groupBy("block").cogroup(totals.groupBy("of")).applyInArrow(summed, result)
