"""Folds over streams whose events come out of order: state, timers, expiry, and a sink that a replay can't write twice.

An event waits in its key's state until the watermark has passed its time; then all that are due are taken in the order of
their times. So the result doesn't depend on how events fall into micro-batches, and equals ``fold.ordered_fold`` over the
same rows, as long as no event comes later than the watermark allows. Later ones are dropped.

Per key the state holds the events that wait, packed by thousands, and what the fold keeps as JSON. A timer is set for the
earliest thing that can happen: the next waiting event, an alarm of the fold (a lease that runs out), or the time from which
the state says nothing any more; then it is deleted, so keys that nobody uses don't stay.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from labframe.operators import fold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: So many waiting events are one value of the state, and so many result rows one frame.
PACK = 10_000
PLAIN = {int, str, bool, type(None)}


def _plain(x, whole: bool):
    """Whole numbers beside nulls arrive as fractions, which must not stay so."""
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return None
    return int(x) if whole else x


def _packs(events: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(events[k : k + PACK]),) for k in range(0, len(events), PACK)]


@contextmanager
def rocks_state(spark: SparkSession, partitions: int | None = None):
    """State with timers needs this store. ``partitions``: in how many parts a new query keeps its state (default: as many as
    shuffles have); it can't change later. The session's own settings come back afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


class Ordered(StatefulProcessor):
    """``start()`` makes a state, an object with plain attributes. ``step(state, t, *columns)`` gives the rows of an event.

    ``alarm(state)`` is the second from which ``ring(state)`` gives rows of its own, or None; ``ring`` must put it off.
    ``keep`` is for how many seconds after its last event a state still matters (None: for ever).
    """

    def __init__(self, waiting: str, names: list[str], start: Callable, step: Callable, alarm: Callable | None = None, ring: Callable | None = None, keep: int | None = None):
        self.columns = {c: kind in ("bigint", "long", "int") for c, kind in (x.split() for x in waiting.split(", "))}
        self.names, self.start, self.step, self.alarm, self.ring, self.keep = names, start, step, alarm or (lambda s: None), ring, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "pack binary")
        self.state = handle.getValueState("state", "json string, last long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs() // 1000, None
        for frame in rows:
            # Plain lists: a key may have few rows a batch.
            columns = [[x if type(x) in PLAIN else _plain(x, whole) for x in frame[c].tolist()] for c, whole in self.columns.items()]
            if new := [r for r in zip(*columns, strict=True) if r[0] > now or not now]:  # what is due has been taken: the rest is late
                self.events.appendList(_packs(new))
                first = min(r[0] for r in new) if first is None else min(first, min(r[0] for r in new))
        if first is not None:
            self.handle.registerTimer(max(1, first) * 1000)
        return iter(())

    def load(self):
        state = self.start()
        if self.state.exists():
            kept, last = self.state.get()
            vars(state).update(json.loads(kept))
            return state, last
        return state, None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        events = [e for (pack,) in self.events.get() for e in pickle.loads(pack)] if self.events.exists() else []
        due = sorted((e for e in events if e[0] <= now), key=lambda e: (e[0], e[1] is not None, e[1]))
        later = [e for e in events if e[0] > now]
        state, last = self.load()
        out = []

        def rings(until: int) -> None:
            while (t := self.alarm(state)) is not None and t <= until:
                out.extend(self.ring(state))

        for event in due:
            rings(event[0])
            out.extend(self.step(state, *event) or ())
            last = event[0]
        rings(now)
        if due:
            self.events.put(_packs(later)) if later else self.events.clear()
        next_ = [e[0] for e in later]
        if last is not None:
            if (t := self.alarm(state)) is not None:
                next_.append(t)
            if self.keep is not None:
                next_.append(last + self.keep + 1)
            if self.keep is not None and not later and last + self.keep < now:
                self.state.clear()
                next_ = []
            else:
                self.state.update((json.dumps(vars(state)), last))
        if next_:
            self.handle.registerTimer(max(min(next_), now + 1) * 1000)
        for k in range(0, len(out), PACK):
            yield pd.DataFrame([(*key, *r) for r in out[k : k + PACK]], columns=self.names, dtype=object)


def ordered_stream(
    rows: DataFrame, keys: list[str], t: str, columns: list[str], delay: str, start: Callable, step: Callable, schema: str,
    alarm: Callable | None = None, ring: Callable | None = None, keep: int | None = None,
) -> DataFrame:
    """The stream's rows of ``schema`` (keys first). ``t`` is a column of whole seconds; of equal times the first of ``columns``
    decides. Rows without a time are left out: they would never be due. ``delay``: how late an event may come."""
    kinds = dict(rows.dtypes)
    waiting = ", ".join([f"{t} long", *[f"{c} {kinds[c]}" for c in columns]])
    timed = rows.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("long").alias(t), *columns, F.timestamp_seconds(t).alias("_at")).withWatermark("_at", delay)
    # The step reads whole seconds. The timestamp stays out of pandas, which can't hold one beyond the year 2262.
    timed = timed.drop("_at")
    names = [c.split()[0] for c in schema.split(", ")]
    processor = Ordered(waiting, names, start, step, alarm, ring, keep)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


class Lease(fold.Lease):
    """A lease that says when it has run out, once for each time that it was touched."""

    def __init__(self, status: str, minutes: int):
        super().__init__(status, minutes)
        self.noted = -1

    def alarm(self) -> int | None:
        return self.touched + self.seconds + 1 if self.holder is not None and self.noted != self.touched else None

    def ring(self):
        self.noted = self.touched
        return [(None, "expired", self.holder, self.status)]


def lease_stream(requests: DataFrame, delay: str, minutes: int = 60, status: str = "REVIEW_REQUIRED") -> DataFrame:
    """``review.lease_log`` of a stream, and a row (seq null, outcome expired) when a lease runs out without any request.

    A lease that has run out stays with its holder until somebody claims it, so the other rows are those of the batch. A document
    whose review is over has no alarm and keeps its status.
    """
    kind = dict(requests.dtypes)
    out = f"document_id {kind['document_id']}, seq {kind['seq']}, outcome string, holder {kind['user_id']}, status string"

    def step(s: Lease, t: int, seq: int, user, admin: bool, action: str, reason):
        return [(seq, s.answer(t, user, admin, action, reason), s.holder, s.status)]

    return ordered_stream(requests, ["document_id"], "t", ["seq", "user_id", "admin", "action", "reason"], delay, lambda: Lease(status, minutes), step, out, Lease.alarm, Lease.ring)


def allowed_stream(events: DataFrame, keys: list[str], order: str, window_seconds: int, limit: int, inclusive: bool, delay: str) -> DataFrame:
    """keys, ``order``, allowed: whether each event is within the limit. ``events`` has keys, t and ``order``.

    Attempts older than the window count no more; the state of a key that has none left is deleted.
    """
    kinds = dict(events.dtypes)

    def step(s: fold.Window, t: int, number):
        before = s.allowed
        s.step(t)
        return [(number, s.allowed > before)]

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{order} {kinds[order]}", "allowed boolean"])
    return ordered_stream(events, keys, "t", [order], delay, lambda: fold.Window(window_seconds, limit, inclusive), step, schema, keep=window_seconds)


def lockout_stream(tries: DataFrame, delay: str, failures: int, seconds: int) -> DataFrame:
    """user_id, event_id, outcome of each attempt (refused, locked, failed, fine). ``tries`` has user_id, t, event_id, bad."""
    kinds = dict(tries.dtypes)

    def step(s: fold.Lockout, t: int, number, bad: bool):
        refused, locks = s.refused, s.locks
        s.step(t, bad)
        return [(number, "refused" if s.refused > refused else "locked" if s.locks > locks else "failed" if bad else "fine")]

    return ordered_stream(tries, ["user_id"], "t", ["event_id", "bad"], delay, lambda: fold.Lockout(failures, seconds), step, f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, outcome string")


# A sink that a replay can't write twice ---------------------------------------------------------------------------------

def _marks(spark: SparkSession, path: str):
    """The file system of a sink and the folder of its ledger: one empty file for each batch that is wholly there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def committed(spark: SparkSession, path: str) -> list[int]:
    """Batches that are wholly there."""
    fs, folder = _marks(spark, path)
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder)) if fs.exists(folder) else []


def put_once(batch: DataFrame, number: int, path: str, before_commit: Callable[[int], None] | None = None) -> None:
    """Writes a micro-batch under its number and then notes it in the ledger. A batch that the ledger holds is left alone; one
    that was written but not noted is written over. ``before_commit`` is called between the two."""
    spark = batch.sparkSession
    fs, folder = _marks(spark, path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(folder, str(number))
    if fs.exists(mark):
        return
    batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    if before_commit:
        before_commit(number)
    fs.create(mark, True).close()


def read_once(spark: SparkSession, path: str, schema) -> DataFrame:
    """What the ledger holds; a batch that was written but not noted isn't seen."""
    parts = [f"{path}/rows/batch={n}" for n in committed(spark, path)]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*parts).select(*schema.names)


def write_once(stream: DataFrame, path: str, before_commit: Callable[[int], None] | None = None) -> DataFrame:
    """Runs the stream to the end of what is there; gives what the sink holds. To be called again after a failure."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/progress")
    writer.foreachBatch(lambda batch, n: put_once(batch, n, path, before_commit)).start().awaitTermination()
    return read_once(stream.sparkSession, path, stream.schema)


def arrivals(rows: DataFrame, t: str, number: str, path: str, lag: int, batches: int) -> DataFrame:
    """A stream of ``rows`` as they might arrive: each up to ``lag`` seconds after its time, by a hash of its number, in so many
    files that are read one by one. A last file with a row a year later, null but for its time, lets all of it be due."""
    spark = rows.sparkSession
    late = rows.filter(F.col(t).isNotNull()).withColumn("_came", F.col(t) + F.pmod(F.xxhash64(number), F.lit(lag)))
    first, last = late.agg(F.min("_came"), F.max("_came")).first()
    step = (last - first) // batches + 1 if first is not None else 1
    for k in range(batches):
        late.filter((F.col("_came") >= (first or 0) + k * step) & (F.col("_came") < (first or 0) + (k + 1) * step)).drop("_came").coalesce(1).write.mode("append").parquet(path)
    end = spark.range(1).select(*[(F.lit((last or 0) + 366 * 86400) if c == t else F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes])
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
