"""Texts cut at single spaces, so that each different stretch between spaces is tokenized once.

A space between two characters that are no white space always starts a piece of the byte-level pattern, and no token of a
vocabulary whose tokens hold a space at their front only can span it. So the ids of a text are those of its stretches, each
with the space before it, put one behind the other. Every other white space stays inside its stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by Python's rule, which holds all that the libraries count as such.
_SPACE = r"[\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts with spaces at which they may not be cut.
UNSAFE = rf"{_SPACE} | {_SPACE}|^ | $"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Stretches that are handed to a library in one string.
TOGETHER = 100


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """The texts, nulls as empty ones, in slices of about ``most`` bytes, and where each begins."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different stretches, for each stretch of the texts in turn which one it is, and where each text's begin and the
    last ends. An empty text has none."""
    if pc.any(pc.match_substring_regex(texts, UNSAFE)).as_py():
        lists = pa.array([CUT.split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
    else:
        lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    index, edges = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        full = index != empty
        index, edges = index[full], np.concatenate([[0], np.cumsum(full)])[edges]
    return coded.dictionary, index, edges


class Seen:
    """Numbers for stretches, handed out in turn. When there are more than ``entries``, those that the next call needs stay."""

    def __init__(self, entries: int):
        self.entries, self.known = entries, pa.array([], pa.large_string())

    def slots(self, found: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray | None]:
        """The numbers of ``found``, whose values differ; which of them are new; and the old numbers of those that stay, if some go."""
        at, kept = pc.index_in(found, value_set=self.known), None
        new = pc.is_null(at)
        if len(self.known) > self.entries:
            kept = at.drop_null().to_numpy().astype(np.int64)
            self.known = found.filter(pc.invert(new))
            at = pc.if_else(new, None, pa.array(np.cumsum(~new.to_numpy(zero_copy_only=False)) - 1))
        fresh, is_new = found.filter(new), new.to_numpy(zero_copy_only=False)
        slots = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        slots[is_new] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        return slots, fresh, kept


def together(stretches: pa.Array) -> tuple[list[str], np.ndarray]:
    """Texts of several stretches joined by spaces, and the numbers of the stretches in their order. Those with white space at
    an end go alone."""
    odd = pc.match_substring_regex(stretches, rf"^{_SPACE}|{_SPACE}$|^$").to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd)
    lists = pa.LargeListArray.from_arrays(np.append(np.arange(0, len(plain), TOGETHER), len(plain)), stretches.take(pa.array(plain)))
    odd = np.flatnonzero(odd)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist() + stretches.take(pa.array(odd)).to_pylist(), np.concatenate([plain, odd])


def distinct(index: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers below ``most``, sorted, and where each of ``index`` stands among them."""
    there = np.zeros(most, bool)
    there[index] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[index]


def join(values: pa.Array, edges: np.ndarray, separator: str) -> pa.Array:
    """The runs between edges, each joined to one string."""
    return pc.binary_join(pa.LargeListArray.from_arrays(edges, values), pa.scalar(separator, pa.large_string()))


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the runs between edges; empty runs give 0."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return ends[edges[1:]] - ends[edges[:-1]]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run behind the other."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)
