"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that the encoding of that prefix can end with. ``PrefixTable``
stores it. An automaton over the vocabulary names the tokens that end at each byte; the right one is that which may stand
behind the last token of the prefix before it. Short pieces fill the same table from the end, only where a token starts, and
share its entries with all pieces that begin alike. Whether two tokens may stand side by side is read off the merges that made
them, from the last one backwards: no older part of the left token may merge with one of the right token before it is used up.
Time and memory are linear in the length of a piece. Appending bytes only adds entries; an edit keeps the entries before it
and stops as soon as the old entries hold again.

A text is cut by the public pattern into pieces and each piece is encoded on its own. ``encode_documents`` runs this over
Arrow batches: the texts of a batch are cut at spaces, each different stretch is encoded once, and Arrow's own functions put
the ids of the texts together and decode them. Every task keeps caches of short pieces, bounded in entries and in the length
of their keys, and so in bytes. Rows need no shuffle.

Cases: a null text counts as empty and gives no ids. Very long texts are read whole. Repeated rows give repeated results.
An empty table gives an empty result. Extra columns are kept by ``encode_documents`` unless they bear a result's name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of one generation of a cache. A full generation becomes the old one and the old one goes; what is still in use
#: is taken over from it, so common pieces stay. A worker holds two generations of each cache.
CACHE_ENTRIES = 100_000
#: Longer pieces are not cached. An entry of a cache thus takes some 500 bytes at most.
LONGEST_KEY = 48
#: Texts are encoded together up to so many bytes.
BATCH_BYTES = 3_000_000
#: White space of Unicode, for engines whose own class holds less.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Runs of white space that a space may split in the wrong place, and controls on which libraries differ.
UNSAFE = rf"{_SPACE}{{3}}|{_SPACE}{{2}}\z|[\x1C-\x1F]"
#: Where two tokens are packed into one key, the left one stands above so many bits; before the first token stands NOTHING.
SHIFT = 24
NOTHING = (1 << SHIFT) - 1
SHORT = (5, 4, 3, 2, 1)
_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Cache:
    """A dictionary of two generations."""

    def __init__(self, entries: int):
        self.entries = entries
        self.new: dict = {}
        self.old: dict = {}

    def keep(self, key, value):
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class PrefixEncoder:
    """Ranks, the automaton that finds their tokens, and caches of pairs that may stand side by side and of pieces seen.

    Bytes are handed to the automaton as characters of the same number (Latin-1).
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte without a token")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.vocabulary = pa.array([self.bytes_of.get(i) for i in range(max(ranks.values()) + 1)], pa.large_binary())
        self.size_of = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        self.token_of = {data.decode("latin-1"): i for data, i in ranks.items()}
        #: Lengths to try, longest first, by the last six bytes, where tokens of six bytes and more end so.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for chars, i in sorted(self.token_of.items(), key=lambda x: len(x[0])):
            self.automaton.add_word(chars, i)
            if len(chars) > 5 and len(chars) != (known := self.lengths.get(chars[-6:], SHORT))[0]:
                self.lengths[chars[-6:]] = (len(chars), *known)
        #: When a token comes into being: at its rank, single bytes before all others.
        self.made = {i: i if len(b) > 1 else -1 for b, i in ranks.items()}
        self.automaton.make_automaton()
        self.pieces_of = regex.compile(pattern).findall
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.history: dict[int, bool] = {}
        self.pairs, self.prefixes, self.chunks, self.seen = _Cache(CACHE_ENTRIES), _Cache(CACHE_ENTRIES), _Cache(CACHE_ENTRIES), _Cache(CACHE_ENTRIES // 3)

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Merge by lowest rank until nothing merges or so many parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks]
            if not ranked:
                break
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one. None for single bytes, and for tokens that their bytes don't merge to."""
        if token not in self.parts:
            parts = [self.ranks[p] for p in self.merged(self.bytes_of[token], 2)]
            self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 and max(self.made[p] for p in parts) < token else None
        return self.parts[token]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right``, each whole by itself, stay apart.

        Going back in time, the neighbours at the boundary are the parts that were there before the latest merge. They would
        have merged if their rank were below that of the merge that ended them; of equal ranks the one further left goes first.
        """
        bytes_of, rank_of, made, parts, ended = self.bytes_of, self.ranks.get, self.made, self.parts, 1 << 60
        while True:
            if rank_of(bytes_of[left] + bytes_of[right], ended) < ended:
                return False
            if made[left] > made[right]:
                ended, left = left, parts[left][1]
            elif made[right] >= 0:
                ended, right = right + 1, parts[right][0]
            else:
                return True

    def _has_history(self, token: int) -> bool:
        """Whether the token and all its parts come from merges of falling rank, as in every trained vocabulary."""
        known = self.history.get(token)
        if known is None:
            parts = self.parts_of(token)
            known = self.history[token] = self.size_of[token] == 1 or parts is not None and all(map(self._has_history, parts))
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether an encoding that ends with ``left`` (NOTHING: an empty one) may go on with ``right``; cached."""
        key = left << SHIFT | right
        known = self.pairs.new.get(key)
        if known is None:
            known = self.pairs.old.get(key)
            if known is None:
                if self._has_history(right) and (left == NOTHING or self._has_history(left)):
                    known = left == NOTHING or self.side_by_side(left, right)
                else:
                    whole = [b for b in (self.bytes_of.get(left), self.bytes_of[right]) if b is not None]
                    known = self.merged(b"".join(whole)) == whole
            self.pairs.keep(key, known)
        return known

    def extend(self, last: list[int], chars: str, start: int = 0, settled=None) -> None:
        """Add to ``last`` the last tokens of the prefixes that end in ``chars``, which begin at byte ``start``.

        ``settled`` is called with each new entry's end and stops the work when it says so.
        """
        pairs, size_of, done = self.pairs.new.get, self.size_of, len(last) - 1
        start += 1
        for end, token in self.automaton.iter(chars):
            end += start
            if end <= done:
                continue
            before = last[end - size_of[token]]
            fits = pairs(before << SHIFT | token)
            if fits or fits is None and self.may_follow(before, token):
                last.append(token)
                done = end
                if settled is not None and settled(end):
                    return

    def _last(self, chars: str) -> int:
        """The last token of a short prefix; the entries that it rests on are stored too."""
        known = self.prefixes.old.get(chars)
        if known is not None:
            return self.prefixes.keep(chars, known)
        token_of, pairs = self.token_of.get, self.pairs.new.get
        for n in self.lengths.get(chars[-6:], SHORT):
            token = token_of(chars[-n:])
            if token is None:
                continue
            start = chars[:-n]
            before = (self.prefixes.new.get(start) or self._last(start)) if start else NOTHING
            fits = pairs(before << SHIFT | token)
            if fits or fits is None and self.may_follow(before, token):
                return self.prefixes.keep(chars, token)
        raise ValueError("a prefix without a last token")

    def piece_ids(self, data: bytes) -> list[int]:
        """As the library does, a piece that is a token is that token, whatever its bytes would merge to."""
        token = self.ranks.get(data)
        if token is not None:
            return [token]
        if len(data) > LONGEST_KEY:
            return PrefixTable(self, data).ids()
        out, chars, known, size_of = [], data.decode("latin-1"), self.prefixes.new.get, self.size_of
        while chars:
            token = known(chars) or self._last(chars)
            out.append(token)
            chars = chars[: -size_of[token]]
        return out[::-1]

    def _piece(self, piece: str) -> str:
        """The ids of a piece, joined by commas. Pieces that a space begins are stretches too and stand in their cache."""
        cache, key = (self.chunks, piece[1:]) if piece[0] == " " and piece[1:] and not piece[1].isspace() else (self.seen, piece)
        ids = cache.new.get(key)
        if ids is not None:
            return ids
        ids = cache.old.get(key) or ",".join(map(str, self.piece_ids(piece.encode("utf-8", "surrogatepass"))))
        return cache.keep(key, ids) if len(piece) <= LONGEST_KEY else ids

    def joined(self, text: str) -> str:
        """The decimal ids of a text, joined by commas."""
        return ",".join(map(self._piece, self.pieces_of(text)))

    def _chunk(self, chunk: str) -> str:
        """The ids of a space and what follows it up to the next space."""
        ids = self.chunks.old.get(chunk)
        if ids is None:
            pieces = self.pieces_of(" " + chunk)
            if len(pieces) == 1:
                return self._piece(pieces[0])
            ids = ",".join(map(self._piece, pieces))
        return self.chunks.keep(chunk, ids) if len(chunk) < LONGEST_KEY else ids

    def id_texts(self, texts: pa.Array) -> pa.Array:
        """``joined`` for many texts.

        No piece of the pattern spans a space that ends a run of white space before other text, so the stretches between
        spaces can be looked up one by one. Longer runs of white space, and controls on which libraries differ, go the long
        way round.
        """
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        cut = pc.split_pattern(pc.if_else(unsafe, "", texts), " ")
        coded = cut.flatten().dictionary_encode()
        chunks, at, edges = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy().astype(np.int64)
        known, chunk = self.chunks.new.get, self._chunk
        ids = [known(c) or chunk(c) for c in chunks]
        # No space stands before the first stretch of a text; where it is empty, it has no ids, also no empty ones.
        heads, place = np.unique(at[edges[:-1]], return_inverse=True)
        at[edges[:-1]] = len(chunks) + place
        ids += [self.joined(chunks[i]) if chunks[i] else "" for i in heads.tolist()]
        empty = len(chunks) + np.flatnonzero([not chunks[i] for i in heads.tolist()])
        kept = ~np.isin(at, empty)
        edges = np.concatenate([[0], np.cumsum(kept)])[edges]
        found = pc.binary_join(pa.LargeListArray.from_arrays(edges, pa.array(ids, pa.large_string()).take(pa.array(at[kept]))), pa.scalar(",", pa.large_string()))
        if pc.any(unsafe).as_py():
            found = pa.array([self.joined(t) if u else i for t, u, i in zip(texts.to_pylist(), unsafe.to_pylist(), found.to_pylist(), strict=True)], pa.large_string())
        return found

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.joined(text).split(","))) if text else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the bytes that these ids decode to."""
        out = []
        ids = self.id_texts(texts)
        for at in range(0, len(ids), 100):
            some = ids.slice(at, 100)
            full = some.filter(pc.not_equal(some, ""))
            names = pc.split_pattern(full, ",")
            tokens = self.vocabulary.take(names.flatten().cast(pa.int32()))
            decoded = iter(pc.binary_join(pa.LargeListArray.from_arrays(names.offsets.cast(pa.int64()), tokens), pa.scalar(b"", pa.large_binary())).to_pylist())
            for i in some.to_pylist():
                out.append((i.count(",") + bool(i), hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(next(decoded) if i else b"").hexdigest()))
        pa.default_memory_pool().release_unused()
        return out


class PrefixTable:
    """The valid last token of every prefix of one piece. ``last[i]`` is for the first i bytes; ``last[0]`` is NOTHING."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [NOTHING]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: the entries of earlier prefixes stay as they are."""
        start = max(0, len(self.data) - self.encoder.longest)
        self.data += data
        self.encoder.extend(self.last, self.data[start:].decode("latin-1"), start)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in the place of bytes start to stop; gives the number of entries computed anew.

        Entries up to ``start`` stay. Behind the edit, the new entries are compared with the old ones: after as many equal
        ones as the longest token has bytes, no later entry can differ and the old ones are taken over.
        """
        old, shift, equal = self.last, len(data) - (stop - start), 0
        self.data = self.data[:start] + data + self.data[stop:]
        last = self.last = old[: start + 1]

        def settled(end: int) -> bool:
            nonlocal equal
            behind = end - shift > stop and end > start + len(data)
            equal = equal + 1 if behind and last[end] == old[end - shift] else 0
            return equal >= self.encoder.longest

        from_ = max(0, start - self.encoder.longest)
        self.encoder.extend(last, self.data[from_:].decode("latin-1"), from_, settled)
        done = len(last) - start - 1
        last += old[len(last) - shift :]
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= self.encoder.size_of[self.last[at]]
        return out[::-1]


def encoder_for(rank_file: str, pattern: str) -> PrefixEncoder:
    """One encoder per Python worker; the worker is reused for many tasks."""
    key = (rank_file, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(load_ranks(rank_file), pattern)
    return _ENCODERS[key]


RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def _local_file(rank_file: str) -> str:
    import os

    return rank_file if os.path.exists(rank_file) else SparkFiles.get(os.path.basename(rank_file))


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, nulls as empty ones, in slices of about BATCH_BYTES."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_BYTES, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256. ``rank_file`` is a vocabulary installed on every worker, or
    one that was sent there by ``SparkContext.addFile``. The decoded bytes come from the ids, not from the text."""

    @F.arrow_udf(RESULT)
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_for(_local_file(rank_file), pattern)
        for batch in batches:
            rows = [r for part in _parts(batch) for r in encoder.digests(part)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=RESULT.names)

    kept = [c for c in docs.columns if c not in RESULT.names]
    return docs.select(*kept, digests(F.col(text)).alias("_bpe")).select(*kept, *[F.col(f"_bpe.{c}").alias(c) for c in RESULT.names])


def token_ids(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with an array of ids, for a trainer."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_for(_local_file(rank_file), pattern)
        for batch in batches:
            yield pa.array([[int(i) for i in x.split(",")] if x else [] for part in _parts(batch) for x in encoder.id_texts(part).to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(into, ids(F.col(text)))
