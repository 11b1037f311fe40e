"""WARC, chat and vectors against round trips and brute force."""

import gzip
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from labframe.llm import ann, chat, common, warc
from labframe.llm.queries import OP1_SQL


def record(payload, kind="response", extra=b""):
    http = b"HTTP/1.1 200 OK\r\n\r\n" if kind == "response" else b""
    head = b"WARC/1.1\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(payload).hexdigest().encode() + extra
    return head + b"\r\nContent-Type: application/http\r\nContent-Length: " + str(len(http + payload)).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_skips_damage_and_logs_gaps(packed):
    pack = gzip.compress if packed else (lambda b: b)
    parts = [pack(record(b"payload %d " % i * 50)) for i in range(6)]
    whole = b"".join(parts)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 6
    at = len(parts[0]) + len(parts[1]) // 2
    hurt = whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]
    found = list(warc.salvage(hurt))
    assert [x[0] for x in found] == ["record", "gap", "record", "record", "record", "record"]
    assert (found[1][1], found[1][2]) == (len(parts[0]), len(parts[0]) + len(parts[1])) and found[1][3]
    assert found[0][1] == 0 and all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False)) and found[-1][2] == len(hurt)
    assert [x[0] for x in warc.salvage(whole[:-20])] == ["record"] * 5 + ["gap"]
    assert [x[0] for x in warc.salvage(b"junk" + whole)] == ["gap"] + ["record"] * 6
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"nothing at all")] == ["gap"]


def test_payload_that_holds_a_record_is_one_record():
    inner = record(b"inner payload")
    assert [x[0] for x in warc.salvage(record(b"before\r\n" + inner + b"after"))] == ["record"]


def test_random_damage_never_loses_intact_records():
    rng = random.Random(6)
    parts = [record(b"%d:" % i + rng.randbytes(200)) for i in range(20)]
    for _ in range(50):
        bad = rng.randrange(20)
        cut = list(parts)
        cut[bad] = cut[bad][: rng.randrange(len(cut[bad]))]
        payloads = [x[5] for x in warc.salvage(b"".join(cut)) if x[0] == "record"]
        assert sum(p.startswith(b"%d:" % i) for i in range(20) if i != bad for p in payloads) == 19


def test_damaged_payload_gives_no_record_of_its_own():
    hurt = record(b"before\r\n\r\n" + record(b"inner payload") + b"after").replace(b"after", b"aftex")
    found = list(warc.salvage(record(b"one") + hurt + record(b"two")))
    assert [(x[0], x[5]) for x in found] == [("record", b"one"), ("gap", b""), ("record", b"two")] and "digest" in found[1][3]


def test_members_of_many_records_and_of_any_size():
    parts = [record(b"payload %d " % i * 50) for i in range(6)]
    two = gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2])
    assert [x[5][:9] for x in warc.salvage(two)] == [b"payload 0", b"payload 1", b"payload 2"]
    rng = random.Random(2)
    large = [record(rng.randbytes(1_500_000) * 2), *parts, record(b"z" * 30_000_000)]
    found = list(warc.salvage(gzip.compress(b"".join(large), 1) + parts[0]))
    assert [x[0] for x in found] == ["record"] * 9 and len(found[7][5]) == 30_000_000
    hurt = b"".join([*parts[:2], parts[2].replace(b"payload 2 payload", b"payload 2 paylosd", 1), b"junk", *parts[3:]])
    found = list(warc.salvage(gzip.compress(hurt)))
    assert [(x[0], x[5][:9]) for x in found] == [("record", b"payload 0"), ("record", b"payload 1"), ("gap", b""), ("record", b"payload 3"), ("record", b"payload 4"), ("record", b"payload 5")]
    noise = [record(rng.randbytes(3000)) for _ in range(40)]
    packed = gzip.compress(b"".join(noise))
    found = list(warc.salvage(packed[: len(packed) // 2] + parts[0]))
    assert 15 <= sum(x[0] == "record" for x in found[:-1]) <= 20 and [x[0] for x in found[-2:]] == ["gap", "record"]


def test_many_version_lines_take_linear_time():
    start = time.process_time()
    assert [x[0] for x in warc.salvage(b"WARC/1.1\r\nA: b\r\n" * 100_000 + record(b"last"))] == ["gap", "record"]
    assert time.process_time() - start < 10


def test_pages_without_id_or_with_clashing_columns(spark):
    big = "y" * 1500
    rows = [(None, "u", big, "p", "r"), (None, "u", big, "p", "r"), (3, None, big, "p", "r"), (4, "u" * 300_000, "z" * 300_000, "p", "r"), (5, "u", "w" * 3_000_000, "p", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_key string, response_id string")
    path = common.scratch_path(spark, "warc")
    warc.write_archives(pages, warc.shared_payloads(pages), path)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_digests(warc.read_archives(spark, path)).collect())
    assert got == Counter({(None, 1500, "revisit", 3): 2, (3, 1500, "response", None): 1, (4, 300_000, "response", None): 1, (5, 3_000_000, "response", None): 1})


def test_pages_round_trip(spark):
    import duckdb
    import pandas as pd

    big, ws = "x" * 1200, "line\r\n\r\nWARC/1.1\r\nfake\r\n\r\n" * 60
    rows = [(1, "http://a/b c\r\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "é" * 600), (6, "u", ws), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", ws), (9, "u", ws)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_key string").drop("payload_key")
    path = common.scratch_path(spark, "warc")
    warc.write_archives(pages, warc.shared_payloads(pages), path)
    got = sorted(tuple(r) for r in warc.page_digests(warc.read_archives(spark, path)).collect())
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert [tuple(None if x is None else x for x in r) for r in got] == sorted(con.execute(OP1_SQL).fetchall(), key=lambda r: r)
    none = pages.filter("page_id < 0")
    empty_path = common.scratch_path(spark, "warc")
    warc.write_archives(none, warc.shared_payloads(none), empty_path)
    assert warc.page_digests(warc.read_archives(spark, empty_path)).count() == 0


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "system", None), (1, 1, "user", "a\\<|b"), (1, 2, "assistant", said), (1, 3, "user", ""), (1, 4, "assistant", "\\n\\\\"), (1, 5, "user", "tail\n"),
        (2, 0, "assistant", ""), (3, 0, "user", "only"), (4, 1, "b<|\n\\role", "x"), (4, 1, None, "x"), (None, 0, "assistant", "é\U0001f642"), (5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in chat.digests(chat.expand(df)).collect()}
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append((n, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
    assert len(got) == len(by) and got[1].n_examples == 3
    assert chat.digests(chat.expand(df.filter("turn < 0"))).count() == 0


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice(["<|", "\\", "<", "|", "\n", "a", "|>", "im_end"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t) and chat.unescape(chat.escape_role(t)) == t


def brute(vectors, every, k):
    ok = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float64))
    out = {}
    for q in (i for i in ok if i % every == 0):
        scores = [(-max(float(a @ b) for a in ok[q] for b in ok[i] if len(a) == len(b)), i) for i in ok if i != q and any(len(a) == len(b) for a in ok[q] for b in ok[i])]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_vectors_awkward_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(40)] + [(200, None), (201, []), (202, [0.0] * 6), (203, [None] * 6), (204, [float("nan")] * 6), (None, [1.0] * 6)]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (302, [5.0, 5.0]), rows[3], rows[20]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, shard int, rep int")
    got = {}
    for r in sorted(ann.nearest(df, 20, 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, 20, 5)
    assert ann.nearest(df.filter("vec_id < 0")).count() == 0


def scanned(x, k=20):
    """The k nearest of every twentieth row by inner product, for rows without ties."""
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
    return np.argsort(-score, axis=1)[:, :k], score


@pytest.mark.parametrize("kind", ["clustered", "isotropic", "outlier"])
def test_recall_against_a_scan(spark, kind):
    rng = np.random.default_rng(5)
    n, dim = 6000, 64 if kind == "clustered" else 32
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = x * 0.3 + rng.normal(size=(60, dim))[rng.integers(60, size=n)]
    if kind == "outlier":
        x[17] *= 10_000
        x[18] *= 1e-6
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, least_shards=2).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want, score = scanned(x)
    assert len(got) == len(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q * 20]} & set(w.tolist())) / 20 for q, w in enumerate(want)]) >= 0.9
    assert all(abs(s - score[q // 20, i]) <= 1e-9 * max(1, abs(s)) for q, found in got.items() for i, s in found)


def test_graph_with_ties_and_repeats(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)] + [(i, rows[i][1]) for i in range(40)] + [(20, rows[21][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(ann.nearest(df, 20, 10, least_shards=1).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, 20, 10)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.95


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2500, 24)).astype(np.float32)
    graph, start = ann.build_graph(x)
    asked = x[:200]
    found, _ = ann.beam_search(x, graph, start, asked, ann.SEARCH_BEAM)
    true = np.argsort(((x[None] - asked[:, None]) ** 2).sum(axis=2), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(found, true, strict=True)]) > 0.9
    assert (graph < 0).sum() < graph.size and all(i not in row for i, row in enumerate(graph.tolist()))


def test_unit_vectors_have_one_level(spark):
    x = np.random.default_rng(3).normal(size=(200, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)  # norms a little below and above 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1e-300] * 16), (901, [1e300] * 16)], "vec_id long, embedding array<double>")
    level = {r.id: r.level for r in ann.usable(df).collect()}
    assert len(level) == 202 and len({level[i] for i in range(200)}) == 1 and level[900] < level[0] < level[901]


def test_a_wide_beam_is_sorted_few_times(monkeypatch):
    x = np.random.default_rng(0).normal(size=(2000, 24)).astype(np.float32)
    graph, start = ann.build_graph(x)
    sort, calls = np.argsort, []
    monkeypatch.setattr(ann.np, "argsort", lambda *a, **b: calls.append(1) or sort(*a, **b))
    ann.beam_search(x, graph, start, x[:50], 240)
    assert len(calls) < 120


def test_shards_in_several_tasks(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(700, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(df, 2, 5, least_shards=1).collect()))
    monkeypatch.setattr(ann, "QUERY_ROWS", 60)
    assert sorted(map(tuple, ann.nearest(df, 2, 5, least_shards=1).collect())) == whole and len(whole) == 350 * 5
