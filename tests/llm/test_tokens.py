"""Alignment, packing and resampling against plain versions, on the awkward rows of conftest and on generated texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labframe.llm import align, packing, resample, stretches
from labframe.llm.queries import BYTE_LEVEL, PIECES
from tests.llm.conftest import SCHEMA, document_rows

A_FILE, B_FILE = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)
A = Tokenizer.from_file(A_FILE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
ATOMS = [
    "a", " ", "\n", "  ", "é", "日本語", "😀", "👩‍👩‍👧", "ẞ", "\t", "▁", "<|endoftext|>", "<s>", "the", " the", "'s", "1234", "\x1c", "　", "​", "́", "ñ", "…", "ꙮ", "\x00",
    "\r\n", "𓀀", "ﷺ", "=====", "hello world", "<0x41>", "\xa0", "ſ", "Ǆ",
]


def generated(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ATOMS, k=rng.randrange(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """The rows of conftest, generated texts, a text of over a megabyte, and white space without end."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgéñ.,", k=rng.randrange(1, 12))) for _ in range(160_000))
    texts = [*generated(150, 1), long, " " * 3000, "x" * 3000, "日本 " * 400, "the end\n" * 300]
    rows = [*document_rows(), *[(1000 + i, t, "en", "a", 1, "x", 1, 1, 1, "y") for i, t in enumerate(texts)]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), [(r[0], r[1]) for r in rows]


def a_bytes():
    """By the library's own decoder, where a token is text by itself, else by the alphabet's definition."""
    shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
    byte_of = {c: b for b, c in shown.items()}
    return {i: bytes(byte_of[c] for c in piece) for piece, i in A.get_vocab().items() if piece != "<|endoftext|>"}


A_BYTES = a_bytes()
B_BYTES = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in range(B.get_piece_size())]


def plain_groups(text):
    a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
    data = (" " + (text or "")).encode()
    if not text or b"".join(A_BYTES[i] for i in a) != data or b"".join(B_BYTES[i] for i in b) != data:
        return []
    at = [{int(e): k + 1 for k, e in enumerate(np.cumsum([len(x[i]) for i in ids]))} for x, ids in ((A_BYTES, a), (B_BYTES, b))]
    out, i, j = [], 0, 0
    for end in sorted(at[0].keys() & at[1].keys()):
        k, m = at[0][end], at[1][end]
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def plain_alignment(rows):
    groups = [plain_groups(t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(p for x in links for p in x)
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = Counter()
    for (i, _), g, x in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out[
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sum(n for p, n in x.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in x.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ] += 1
    return out


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_agrees_with_brute_force(awkward, empty):
    docs, rows = awkward
    # Small blocks, so that documents of many blocks share their counts.
    got = Counter(tuple(r) for r in align.align_documents(docs, A_FILE, B_FILE, 20_000).select(ALIGNED).collect())
    assert got == plain_alignment([(i, t) for i, t in rows])
    assert align.align_documents(empty, A_FILE, B_FILE).count() == 0


def test_groups_with_their_bytes(spark):
    texts = [t for t in generated(200, 2)] + [None, "", "ẞ日", "a▁b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in align.token_groups(docs, A_FILE, B_FILE).collect():
        assert [(g.a, g.b) for g in r.groups] == plain_groups(r.text)
        data = (" " + (r.text or "")).encode()
        assert all(b"".join(A_BYTES[i] for i in g.a) == data[g.start : g.end] == b"".join(B_BYTES[i] for i in g.b) for g in r.groups)


def test_large_groups_are_counted_by_their_ids(monkeypatch):
    texts = pa.array(["ꙮ" * 40, "plain", "x😀ꙮ" * 10], pa.large_string())
    small = align.Aligner(A_FILE, B_FILE).study(texts)
    monkeypatch.setattr(align, "LARGE_GROUP", 1)
    large = align.Aligner(A_FILE, B_FILE).study(texts)
    assert (small.pairs == large.pairs).all() and (small.times == large.times).all() and (small.first == large.first).all()


def test_the_table_of_stretches_stays_small_and_right(monkeypatch):
    monkeypatch.setattr(align, "TABLE_ENTRIES", 50)
    aligner = align.Aligner(A_FILE, B_FILE)
    aligner.seen = stretches.Seen(50)
    for seed in range(6):
        texts = ["shared by all of them " + t for t in generated(20, seed)]
        found, index, edges = stretches.cut(pa.array(texts, pa.large_string()))
        used, place = stretches.distinct(index, len(found))
        slots = aligner.slots_of(found.take(pa.array(used)))[place]
        for k, t in enumerate(texts):
            own = slots[edges[k] : edges[k + 1]]
            if aligner.table.counts[4][own].all():
                assert ";".join(aligner.table.text.take(pa.array(own)).to_pylist()) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(t))
            else:
                assert plain_groups(t) == []
        assert len(aligner.seen.known) == aligner.table.counts.shape[1] < 600


def check_packing(pieces, rows, size, end_token=2):
    """Every document's ids are there once, cut as the contract says, and sequences have neither gaps nor too many tokens."""
    by, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        places[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(Counter)
    for i, t in rows:
        ids = np.array([*A.encode(t or "", add_special_tokens=False).ids, end_token], "<u4")
        first = (len(ids) - 1) % size + 1
        edges = [0, *range(first, len(ids) + 1, size)]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            want[i][k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
    assert {i: Counter((p.piece, p.start, p.length, p.ids_crc32) for p in x) for i, x in by.items()} == dict(want)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(places), sum(p.length for p in pieces)


def test_packing_loses_nothing_and_wastes_little(awkward, empty):
    docs, rows = awkward
    for size, groups in ((1024, 50_000), (16, 100)):
        n, tokens = check_packing(packing.pack_documents(docs, A_FILE, size, open_bins=64, group_pieces=groups).collect(), rows, size)
        assert n <= 1.02 * tokens / size + 2
    assert packing.pack_documents(empty, A_FILE).count() == 0


def test_packed_ids_make_sequences(spark):
    texts = [f"a short text about {i} things " * (i % 7) for i in range(60)] + [None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = packing.pack_documents(docs, A_FILE, 32, keep_ids=True).cache()
    whole = {r.sequence_id: r.tokens for r in packing.sequences(pieces).collect()}
    by = defaultdict(list)
    for p in sorted(pieces.collect(), key=lambda p: (p.doc_id, p.piece)):
        assert whole[p.sequence_id][p.offset : p.offset + p.length] == p.ids and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        by[p.doc_id] += p.ids
    assert {i: [*A.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)} == by
    assert sum(map(len, whole.values())) == sum(map(len, by.values()))


def test_packer_chooses_the_best_fit_and_closes_the_fullest():
    rng = random.Random(5)
    for most in (1, 3, 10):
        packer, open_, closed, want = packing.Packer(20, most), {}, [], []
        for i in range(500):
            n = rng.randrange(1, 21)
            closed += [number for number, _ in packer.put(n, i)]
            fits = [f for f in open_.values() if f >= n]
            free = min(fits) if fits else 20
            at = max((b for b, f in open_.items() if f == free), default=None) if fits else None
            at = len(want) + len(open_) if at is None else at
            open_[at] = free - n
            # Among equally full bins any may be chosen: compare the free space of what is open.
            if open_[at] == 0:
                want.append(open_.pop(at))
            elif len(open_) > most:
                want.append(open_.pop(min(open_, key=open_.get)))
            assert sorted(open_.values()) == sorted(f for f, s in packer.stacks.items() for _ in s) and len(closed) == len(want)
        assert len(closed) + sum(1 for _ in packer.rest()) == packer.bins


def test_pieces_but_the_first_are_full():
    assert [list(packing.pieces_of(n, 4)) for n in (1, 4, 5, 8, 11)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 5)], [(0, 4), (4, 8)], [(0, 3), (3, 7), (7, 11)]]


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, most=2):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]).encode() for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, buckets, most=2, min_words=20, share=25):
    docs = [(i, *plain_features(t, most)) for i, t in rows]
    s, t = Counter(zlib.crc32(f) % buckets for _, _, x in docs for f in x), Counter(zlib.crc32(f) % buckets for text in target for f in plain_features(text, most)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, n, x in docs:
        weight = sum(gain[zlib.crc32(f) % buckets] for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    return Counter(x[:4] for x in out), Counter((x[0], x[3], k + 1) for k, x in enumerate(order[: share * len(order) // 100]))


@pytest.mark.parametrize(("buckets", "most", "share"), [(10_000, 2, 25), (7, 3, 60)])
def test_resampling_agrees_with_brute_force(spark, awkward, empty, buckets, most, share):
    docs, rows = awkward
    target = ["Ein Ziel, ein Text", None, "the end of the older members said there", "x" * 70 + " " + "y" * 200 + " " + "x" * 70]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, goal, buckets, most, share_percent=share).collect()
    all_, drawn = plain_resample(rows, target, buckets, most, share=share)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == all_
    assert Counter((r.doc_id, r.score, r["rank"]) for r in got if r["rank"]) == drawn
    assert resample.resample(empty, goal).count() == 0 and resample.resample(docs, goal.limit(0)).filter("rank is not null").count() > 0


def test_features_stay_inside_their_texts():
    texts = ["One two\x00three", "", "four", "ÄÖ é\x1c5", "w" * 300 + " " + "v" * 64 + " " + "u" * 63, "..."]
    found, many = resample.features(pa.array(texts, pa.large_string()), 3)
    for n in range(3):
        want = [[zlib.crc32(f) for f in plain_features(t, 3)[1] if f.count(b" ") == n] for t in texts]
        assert found[n].tolist() == [x for w in want for x in w] and many[n].tolist() == [len(w) for w in want]


def test_counts_of_buckets_are_those_of_all_features(awkward):
    docs, rows = awkward
    got = {r.bucket: r.n for r in resample.bucket_counts(docs, buckets=1000).collect()}
    assert got == Counter(zlib.crc32(f) % 1000 for _, t in rows for f in plain_features(t)[1])
    assert docs.filter(F.length("text") > 1_000_000).count() == 1


def test_a_draw_favours_the_target(spark):
    """Of two kinds of documents, one like the target: most of what is drawn is of that kind."""
    rng = random.Random(9)
    kinds = [["red", "green", "blue", "white"], ["one", "two", "three", "four"]]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=40))) for i in range(400)]
    goal = spark.createDataFrame([(" ".join(rng.choices(kinds[1], k=400)),)], "text string")
    drawn = [r.doc_id for r in resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), goal).filter("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 90
