"""Streams out of order, expiry of state, and replays."""

import random
from collections import Counter

import pytest

from labframe.operators import relational as R
from labframe.operators import review as W
from labframe.streaming import ordered as O

DAY = 86400


def requests(n, seed=1):
    rng = random.Random(seed)
    actions = ["claim", "claim", "heartbeat", "release", "approve", "reject"]
    return [(rng.randrange(4), i, DAY + i * 700 + rng.randrange(600), rng.choice([1, 2, 3, None]), rng.random() < 0.1, rng.choice(actions), rng.choice([None, " ", "bad scan"])) for i in range(n)]


REQUEST = "document_id long, seq long, t long, user_id long, admin boolean, action string, reason string"


def test_leases_out_of_order_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame(requests(120), REQUEST)
    stream = O.lease_stream(O.arrivals(rows, "t", "seq", f"{tmp_path}/in", 3 * 3600, 4), "3 hours")
    with O.rocks_state(spark):
        got = [tuple(r) for r in O.write_once(stream, str(tmp_path / "out")).filter("document_id is not null").collect()]
    batch = [tuple(r) for r in W.lease_log(rows).collect()]
    assert Counter(r for r in got if r[2] != "expired") == Counter(batch)
    # A lease that nobody touched for an hour ends by itself, once.
    open_, ends, at = {}, Counter(), {r[1]: r[2] for r in requests(120)}
    for d, seq, outcome, holder, _ in sorted(batch, key=lambda r: (at[r[1]], r[1])):
        if d in open_ and outcome in ("claimed", "renewed", "taken over", "released", "approved", "rejected"):
            who, touched = open_.pop(d)
            ends[d, who] += at[seq] > touched + 3600
        if outcome in ("claimed", "renewed", "taken over"):
            open_[d] = (holder, at[seq])
    for d, (who, _) in open_.items():
        ends[d, who] += 1
    assert Counter((r[0], r[3]) for r in got if r[2] == "expired") == +ends and sum(ends.values()) > 3


def test_times_beyond_2262(spark, tmp_path):
    """Nanoseconds in 64 bits end in April 2262; whole seconds don't."""
    late = [(d, seq, t + 9_223_250_000, *rest) for d, seq, t, *rest in requests(120)]
    assert late[0][2] < 2**63 // 10**9 < late[-1][2]
    rows = spark.createDataFrame(late, REQUEST)
    stream = O.lease_stream(O.arrivals(rows, "t", "seq", f"{tmp_path}/in", 3 * 3600, 3), "3 hours")
    with O.rocks_state(spark):
        got = [tuple(r) for r in O.write_once(stream, str(tmp_path / "out")).filter("seq is not null").collect()]
    assert Counter(got) == Counter(tuple(r) for r in W.lease_log(rows).collect())


def test_waiting_events_of_a_key_are_packed(spark, tmp_path):
    """Many events of one key wait as few values of the state, and all come out in order of their times."""
    n, source, out = 25_000, str(tmp_path / "in"), str(tmp_path / "out")
    kind = "user_id long, t long, event_id long"
    events = spark.range(n).selectExpr("IF(id % 5000 = 7, NULL, 7L) AS user_id", f"{DAY} + pmod(id * 7919, {n}) AS t", "id AS event_id")
    events.coalesce(1).write.mode("append").parquet(source)
    stream = O.allowed_stream(spark.readStream.schema(kind).parquet(source), ["user_id"], "event_id", 100, 2, False, "1 day")
    with O.rocks_state(spark):
        assert O.write_once(stream, out).count() == 0
        waiting = spark.read.format("statestore").option("stateVarName", "events").option("flattenCollectionTypes", True).load(f"{out}/progress")
        assert 2 <= waiting.count() <= 8
        spark.createDataFrame([(-1, 9 * DAY, None)], kind).write.mode("append").parquet(source)
        got = O.write_once(stream, out)
        counts = Counter(r.user_id for r in got.filter("allowed").collect())
        assert got.count() == got.select("event_id").distinct().count() == n
    want = R.greedy(events.selectExpr("user_id", "timestamp_seconds(t) AS ts"), ["user_id"], 100, 2, False)
    assert counts == {r.user_id: r.n_allowed for r in want.collect()}


def test_state_of_old_attempts_goes(spark, tmp_path):
    rows = spark.createDataFrame([(k, DAY * 10 + k * DAY + i * 600, 100 * k + i) for k in range(6) for i in range(4)], "user_id long, t long, event_id long")
    stream = O.allowed_stream(O.arrivals(rows, "t", "event_id", f"{tmp_path}/in", 60, 6), ["user_id"], "event_id", 3600, 2, False, "60 seconds")
    held = []

    def kept(n):
        state = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/out/progress")
        held.append(state.count())

    with O.rocks_state(spark):
        got = O.write_once(stream, str(tmp_path / "out")).filter("event_id is not null")
        counts = Counter(r.user_id for r in got.collect() if r.allowed)
        kept(0)
    want = {r.user_id: r.n_allowed for r in R.greedy(rows.selectExpr("user_id", "timestamp_seconds(t) AS ts"), ["user_id"], 3600, 2, False).collect()}
    assert counts == want and held == [0]


def test_late_events_change_nothing(spark, tmp_path):
    """An event that comes later than the delay allows is dropped, all others are as without it."""
    path = str(tmp_path / "in")
    kind = "user_id long, t long, event_id long"
    for k, rows in enumerate([[(1, DAY, 0), (1, DAY + 50, 1)], [(1, DAY + 900, 2)], [(1, DAY + 1000, 3), (1, DAY + 10, 9)], [(None, DAY * 400, None)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    with O.rocks_state(spark):
        got = O.write_once(O.allowed_stream(stream, ["user_id"], "event_id", 100, 1, False, "60 seconds"), str(tmp_path / "out"))
        assert sorted((r.event_id, r.allowed) for r in got.filter("event_id is not null").collect()) == [(0, True), (1, False), (2, True), (3, True)]


def test_a_batch_that_fails_before_its_commit_is_written_once(spark, tmp_path):
    source, out, kind = str(tmp_path / "in"), str(tmp_path / "out"), "job_id long, attempt long"
    for k in range(4):
        spark.createDataFrame([(10 * k + i, 1) for i in range(5)], kind).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    failed = []

    def fail_at_two(n):
        if n == 2 and not failed:
            failed.append(n)
            raise RuntimeError("lost before the commit")

    with pytest.raises(Exception, match="lost before the commit"):
        O.write_once(stream, out, fail_at_two)
    # What was written but not committed isn't seen.
    assert O.committed(spark, out) == [0, 1] and O.read_once(spark, out, stream.schema).count() == 10
    again = O.write_once(stream, out, fail_at_two)
    assert O.committed(spark, out) == [0, 1, 2, 3]
    assert sorted(r.job_id for r in again.collect()) == [10 * k + i for k in range(4) for i in range(5)]
    # A batch that the ledger holds is not written again.
    O.put_once(spark.createDataFrame([(99, 1)], kind), 3, out)
    assert O.read_once(spark, out, stream.schema).count() == 20


def test_nothing_gives_nothing(spark, tmp_path):
    none = spark.createDataFrame([], REQUEST)
    stream = O.lease_stream(O.arrivals(none, "t", "seq", f"{tmp_path}/in", 60, 2), "60 seconds")
    with O.rocks_state(spark):
        assert O.write_once(stream, str(tmp_path / "out")).filter("document_id is not null").count() == 0
