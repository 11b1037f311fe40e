"""State that events change one after another, per key, with bounded memory.

Rows are dealt by key and sorted inside the partitions; each task walks its rows once and holds the state of one key. A key with
very many events is long, but never held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """For each key: ``state = start()``, then for each row in ``order`` ``step(state, *values of columns)``, which may return
    tuples to emit (key values are put before them), then ``state.done()``, which returns one tuple or None. Nulls come first
    in the order and arrive as None; null keys are keys."""
    names = [c.split()[0] for c in schema.split(", ")]
    picked = rows.select(*keys, *[F.col(c) for c in dict.fromkeys([*order, *columns]) if c not in keys])
    dealt = picked.repartition(*keys).sortWithinPartitions(*keys, *order)
    width = len(keys)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for batch in batches:
            clean = batch.astype(object).where(batch.notna(), None)
            for values in zip(*[clean[k] for k in keys], *[clean[c] for c in columns], strict=True):
                if state is None or values[:width] != key:
                    if state is not None and (last := state.done()) is not None:
                        out.append((*key, *last))
                    key, state = values[:width], start()
                out += [(*key, *x) for x in step(state, *values[width:]) or ()]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if state is not None and (last := state.done()) is not None:
            out.append((*key, *last))
        yield pd.DataFrame(out, columns=names, dtype=object)

    return dealt.mapInPandas(walk, schema)


class Window:
    """An event is allowed while fewer than ``limit`` allowed ones lie in the window before it; the last allowed ones are kept."""

    def __init__(self, seconds: int, limit: int, inclusive: bool):
        self.seconds, self.limit, self.inclusive = seconds, limit, inclusive
        self.last: list[int] = []
        self.n = self.allowed = 0

    def step(self, t: int):
        self.n += 1
        since = t - self.seconds
        if sum(x >= since if self.inclusive else x > since for x in self.last) < self.limit:
            self.last = [*self.last, t][-self.limit :]
            self.allowed += 1

    def done(self) -> tuple[int, int]:
        return self.n, self.allowed


class Lockout:
    """After so many failures in a row attempts are refused for a while; refused ones aren't counted, a success resets."""

    def __init__(self, failures: int, seconds: int):
        self.failures, self.seconds = failures, seconds
        self.fails = self.until = self.locks = self.refused = 0

    def step(self, t: int, bad: bool):
        if t < self.until:
            self.refused += 1
        elif bad and self.fails + 1 >= self.failures:
            self.fails, self.until, self.locks = 0, t + self.seconds, self.locks + 1
        else:
            self.fails, self.until = (self.fails + 1 if bad else 0), 0

    def done(self) -> tuple[int, int]:
        return self.locks, self.refused


class Lease:
    """One document's review: who holds it, since when, and what each request comes to.

    A claim by the holder renews, by another conflicts until the lease has run out, and then takes over. Only the holder's
    heartbeat renews; the holder or an admin releases, approves, or rejects with a reason.
    """

    def __init__(self, status: str, minutes: int):
        self.status, self.seconds = status, minutes * 60
        self.holder, self.touched = None, 0

    def answer(self, t: int, user, admin: bool, action: str, reason) -> str:
        own = self.holder is not None and self.holder == user
        if action == "claim":
            if own:
                self.touched = t
                return "renewed"
            taken_over = self.holder is not None
            if taken_over:
                if self.touched >= t - self.seconds:
                    return "conflict"
                self.holder, self.status = None, "REVIEW_REQUIRED"
            if self.status != "REVIEW_REQUIRED":
                return "not reviewable"
            self.holder, self.touched, self.status = user, t, "REVIEW_IN_PROGRESS"
            return "taken over" if taken_over else "claimed"
        if self.holder is None or action == "heartbeat" and not own:
            return "no review"
        if action == "heartbeat":
            self.touched = t
            return "renewed"
        if not own and not admin:
            return "forbidden"
        if action == "reject" and not (reason or "").strip():
            return "reason required"
        self.holder, self.status = None, {"release": "REVIEW_REQUIRED", "approve": "HUMAN_APPROVED", "reject": "HUMAN_REJECTED"}[action]
        return {"release": "released", "approve": "approved", "reject": "rejected"}[action]
