"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bounded-space online best-fit: a packer holds at most ``OPEN_BINS`` open bins, stacked by their free space; one bit per free
space says which stacks are not empty, so the bin that a piece fits best is the lowest bit at or above its length. When one bin
too many is open, the fullest closes first.

Every task tokenizes its texts and packs the pieces at once, so texts and ids are never shuffled. The pieces of bins that are
still open when a task ends are dealt anew, about ``GROUP_PIECES`` to a group, and packed once more, the longest of a group
first and with a bin for each at most; only their numbers travel.

Each different stretch between spaces is tokenized once a slice and kept for the next ones in a bounded table.

Cases: null and empty texts have the end token alone. Names of special tokens inside texts are plain text. Very long texts are
tokenized whole and cut: all pieces but the first are full. Repeated rows are packed as often as they stand there. An empty
table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize
from labframe.llm.stretches import Seen, cut, distinct, runs, slices, sums, together

SEQUENCE = 1024
END_TOKEN = 2
OPEN_BINS = 1024
#: Pieces of open bins that are packed together at the end.
GROUP_PIECES = 50_000
SLICE_BYTES = 8_000_000
#: Stretches that a worker keeps from one slice to the next.
TABLE_ENTRIES = 300_000
_TOKENIZERS: dict[str, Tokens] = {}


class Packer:
    """Open bins by free space. A bin is a list of items; ``put`` gives the bins that it closes."""

    def __init__(self, size: int = SEQUENCE, most: int = OPEN_BINS):
        self.size, self.most, self.bins, self.open = size, most, 0, 0
        self.stacks: dict[int, list[tuple[int, list]]] = {}
        self.free = 0  # bit f: a bin with f tokens free is open

    def _pop(self, free: int) -> tuple[int, list]:
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.free &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, length: int, item) -> Iterator[tuple[int, list]]:
        """``item`` goes into the bin that it leaves the least room in, or into a new one; a bin holds (item, offset)."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number, held = self._pop(free)
        else:
            free, number, held = self.size, self.bins, []
            self.bins += 1
        held.append((item, self.size - free))
        free -= length
        if not free:
            yield number, held
            return
        self.stacks.setdefault(free, []).append((number, held))
        self.free |= 1 << free
        self.open += 1
        if self.open > self.most:
            yield self._pop((self.free & -self.free).bit_length() - 1)

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.free:
            yield self._pop((self.free & -self.free).bit_length() - 1)


class Tokens:
    """A byte-level tokenizer and the ids of stretches that were seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        known = self.tokenizer.get_vocab()
        # A byte-level entry has one character for each byte.
        self.sizes = np.zeros(max(known.values()) + 1, np.int64)
        self.sizes[list(known.values())] = [len(x) for x in known]
        self.seen = Seen(TABLE_ENTRIES)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def study(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each stretch, with the space before it, begin and the last end, and the ids."""
        texts, order = together(stretches)
        ids = np.array([i for some in self.encoded([" " + t for t in texts]) for i in some], np.int64)
        edge = np.cumsum(pc.binary_length(stretches).to_numpy()[order] + 1)
        end = np.cumsum(self.sizes[ids])
        ends = np.searchsorted(end, edge, "right")
        if ends[-1] != len(ids) or (end[ends - 1] != edge).any():
            raise ValueError("tokens that span a cut between stretches")
        starts, back = np.append(0, ends[:-1]), np.argsort(order)
        starts, lengths = starts[back], (ends - starts)[back]
        return np.append(0, np.cumsum(lengths)), ids[runs(starts, lengths)].astype(np.int32)

    def _slots_of(self, stretches: pa.Array) -> np.ndarray:
        slots, new, kept = self.seen.slots(stretches)
        if kept is not None:
            lengths = np.diff(self.first)[kept]
            self.first, self.ids = np.append(0, np.cumsum(lengths)), self.ids[runs(self.first[kept], lengths)]
        if len(new):
            first, ids = self.study(new)
            self.first, self.ids = np.concatenate([self.first, self.first[-1] + first[1:]]), np.concatenate([self.ids, ids])
        return slots

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text behind the other, and where each text's begin and the last ends.

        No space stands before a text's first stretch, so these are tokenized by themselves.
        """
        found, index, edges = cut(texts)
        full = edges[:-1][np.diff(edges) > 0]
        heads, which = distinct(index[full], len(found))
        head_ids = self.encoded(found.take(pa.array(heads)).to_pylist())
        inner = np.ones(len(index), bool)
        inner[full] = False
        used, place = distinct(index[inner], len(found))
        slots = self._slots_of(found.take(pa.array(used)))
        starts, lengths = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        starts[inner], lengths[inner] = self.first[slots][place], np.diff(self.first)[slots][place]
        sizes = np.array([len(x) for x in head_ids], np.int64)
        starts[full], lengths[full] = (len(self.ids) + np.cumsum(sizes) - sizes)[which], sizes[which]
        pool = np.concatenate([self.ids, np.array([i for x in head_ids for i in x], np.int32)])
        return pool[runs(starts, lengths)], np.append(0, np.cumsum(sums(lengths, edges)))


def tokens_for(path: str) -> Tokens:
    """One tokenizer per Python worker; the worker is reused for many tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokens(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _TOKENIZERS[path]


def pieces_of(length: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and end of each piece: all but the first are full."""
    end = (length - 1) % size + 1
    yield 0, end
    while end < length:
        yield end, end + size
        end += size


NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _rows(bins: list[tuple[int | None, list]]) -> pa.RecordBatch:
    """Rows of closed bins, or of open ones (no number)."""
    rows = [(*item, number, None if number is None else offset) for number, held in bins for item, offset in held]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def pack_documents(
    docs: DataFrame, path: str, size: int = SEQUENCE, end_token: int = END_TOKEN, keep_ids: bool = False, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if ``keep_ids``.

    ``docs`` has doc_id and text; ``path`` is a tokenizer installed on every worker or sent there by ``SparkContext.addFile``.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, task = tokens_for(path), Packer(size, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                ids, edges = tokens.of(texts)
                done = []
                for k, doc in enumerate(batch.column(0).slice(at, len(texts)).to_pylist()):
                    own = np.append(ids[edges[k] : edges[k + 1]], end_token).astype("<u4")
                    for piece, (start, stop) in enumerate(pieces_of(len(own), size)):
                        part = own[start:stop]
                        item = (doc, piece, start, stop - start, zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None)
                        done += [(task | number, held) for number, held in packer.put(stop - start, item)]
                yield _rows(done)
            pa.default_memory_pool().release_unused()
        yield _rows([(None, held) for _, held in packer.rest()])

    stored = materialize(docs.select("doc_id", "text").mapInArrow(packed, PIECES), "pieces", "zstd")
    open_ = stored.filter("sequence_id is null")
    groups = max(1, -(-open_.count() // group_pieces))

    def again(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        packer, base, done = Packer(size, table.num_rows), (1 << 62) + (key[0].as_py() << 32), []
        columns = [table[c].to_pylist() for c in NAMES]
        for item in sorted(zip(*columns, strict=True), key=lambda x: (-x[3], x[4])):
            done += [(base + number, held) for number, held in packer.put(item[3], item)]
        return pa.Table.from_batches([_rows(done + [(base + number, held) for number, held in packer.rest()])])

    # The hash of what a piece holds deals the pieces evenly; equal pieces of one id are few enough to lie together.
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), F.lit(groups))
    dealt = open_.withColumn("_row", F.monotonically_increasing_id()).withColumn("_group", group).drop("_row")
    rest = dealt.groupBy("_group").applyInArrow(again, PIECES)
    found = stored.filter("sequence_id is not null").unionByName(rest)
    return found if keep_ids else found.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its tokens, from pieces with ids. A sequence is no longer than the packer's size."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return held.select("sequence_id", F.flatten(F.col("x.ids")).alias("tokens"))
