"""Document operators against brute force, on the awkward rows of conftest and on generated texts."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from labframe.llm import bpe, lines, mixing, quality, sharding, simhash, substrings
from labframe.llm.components import components
from tests.llm.conftest import document_rows


def words(t):
    return (t or "").encode().split()


def test_quality_counts_and_base_rule(docs):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.score_documents(docs).collect())
    want = Counter()
    for row in document_rows():
        t, w = row[1] or "", words(row[1])
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if triples[tuple(w[i : i + 3])] > 1}
        kept = [x for x in t.split("\n") if x.encode().split()]
        want[row[0], len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(kept) - len(set(kept)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want


def counts(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper."""
    t, w = t or "", words(t)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if triples[tuple(w[i : i + 3])] > 1}
    lines_ = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines_) - len(set(lines_)), len(covered), len(lines_), sum("A" <= c <= "Z" for c in t)


def vote(t):
    n, chars, symbols, dup, repeat, lines_, upper = counts(t)

    def ratio(a, b, good, bad):
        return 0 if b <= 0 else -1 if a >= b * bad else 1 if a <= b * good else 0

    long = 0 if n <= 0 else -1 if chars >= n * 7.0 or chars <= n * 3.0 else 1 if n * 4.2 <= chars <= n * 6.2 else 0
    return [ratio(symbols, n, 0.02, 0.2), ratio(dup, lines_, 0.1, 0.35), ratio(repeat, n, 0.1, 0.3), long, ratio(upper, chars, 0.1, 0.4)]


def verdicts(texts):
    """kept by text, from EM over the documents one by one (no histogram), in probabilities instead of logarithms."""
    v = np.array([vote(t) for t in texts])
    right = np.tile([[0.994, 0.006], [0.625, 0.375]], (v.shape[1], 1, 1))  # rule, class (good, bad), vote (good, bad)
    start, prior, extra = right.copy(), 0.8, max(1.0, 0.05 * len(v))

    def good():
        like = np.array([prior, 1 - prior]) * np.ones((len(v), 1))
        for j in range(v.shape[1]):
            for k, value in enumerate((1, -1)):
                like[v[:, j] == value] *= right[j, :, k]
        return like[:, 0] / like.sum(axis=1)

    for _ in range(50):
        p = good()
        both = np.stack([p, 1 - p])
        prior = (p.sum() + 0.8 * extra) / (len(v) + extra)
        seen = np.stack([np.stack([both @ (v[:, j] == value) for value in (1, -1)], axis=1) for j in range(v.shape[1])]) + extra * start
        right = seen / seen.sum(axis=2, keepdims=True)
    fine = {}
    for t, p in zip(texts, good(), strict=True):
        n, repeat = counts(t)[0], counts(t)[4]
        fine[t] = bool(n >= 50 and 100 * repeat <= 50 * n and round(p, 9) >= 0.5)
    return fine


def generated_texts():
    rng = random.Random(11)
    out = []
    for _ in range(120):
        kind = rng.random()
        w = [rng.choice(["meeting", "council", "winter", "the", "of", "garden", "SHOUT" if kind < 0.2 else "quiet", "&&&" if 0.2 <= kind < 0.35 else "plain"]) + (str(rng.randrange(99)) if rng.random() < 0.6 else "")
             for _ in range(rng.randrange(30, 200))]
        text = "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
        out.append(text + ("\n" + text.split("\n")[0]) * (8 if 0.35 <= kind < 0.5 else 0))
    return out


def test_quality_verdict_against_em_over_single_documents(spark):
    texts = generated_texts()
    got = quality.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = verdicts(texts)
    assert {r.doc_id: r.kept for r in got} == {i: want[t] for i, t in enumerate(texts)}
    assert 10 < sum(want.values()) < 110 and any(not r.kept and not r.base_failed for r in got)


def test_quality_keeps_columns_and_empty_tables(docs, empty):
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.schema["n_tokens"] == docs.schema["n_tokens"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in ((r[0], r[1]) for r in document_rows()) if verdicts([r[1] for r in document_rows()])[t])
    assert quality.filter_quality(empty).count() == 0 and quality.score_documents(empty).count() == 0


def test_em_finds_precise_rules():
    rng = random.Random(3)
    patterns = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        patterns[tuple((1 if rng.random() < 0.95 else 0) if good else (-1 if rng.random() < 0.4 else 1) for _ in range(3))] += 1
    model = quality.fit_accuracies(patterns)
    assert all(t[0][-1] > 0.25 and t[1][-1] < 0.02 for t in model["table"]) and 0.7 < model["prior"] < 0.9
    assert model == quality.fit_accuracies(patterns) and quality.fit_accuracies({})["prior"] == 0.8


def test_index_grows_batch_by_batch(spark):
    rng = random.Random(15)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(80)]
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"{t} {passage} {t[:40]}" if i % 4 == 0 else t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    name = "test_" + hashlib.md5(str(rng.random()).encode() + str(time.time()).encode()).hexdigest()[:12]
    found, seen, live = set(), None, []
    for lo in (40, 0, 70, 20, 60, 10, 50, 30):  # ids fall and rise; the index is opened anew for each batch
        part = df.filter(f"doc_id >= {lo} and doc_id < {lo + 10}")
        seen = part if seen is None else seen.unionByName(part)
        index = substrings.FingerprintIndex(spark, name)
        live.append(len(index.runs))
        found |= {tuple(r) for r in substrings.add_batch(index, part, seen).collect()}
    assert live == [0, 1, 1, 2, 1, 2, 2, 3]  # pairs of a tier become one run of the next, so the last batch meets three
    assert len(substrings.FingerprintIndex(spark, name).runs) == 1
    substrings.FingerprintIndex(spark, name).drop()
    whole = substrings.FingerprintIndex(spark)
    assert found == {tuple(r) for r in substrings.add_batch(whole, df, df).collect()} and found
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), set()).add(i)
    assert Counter(i for i, _ in found) == Counter(i for ids in first.values() for i in ids if i > min(ids))
    whole.drop()
    assert substrings.FingerprintIndex(spark, name).runs == []


def test_substrings_against_brute_force(spark, docs, empty):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(r[0], r[1]) for r in document_rows()]
    for i in range(100, 190):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            a = rng.randrange(0, 40)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randrange(10, 30)]
        rows.append((i, "  ".join(w) if i % 7 else rows[-1][1]))
    rng.shuffle(rows)
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()] += 1
    got = substrings.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string"), batches=8, with_text=True)
    assert Counter(map(tuple, got.collect())) == want
    assert substrings.dedup_documents(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, s, k):
    s = list(s)
    for _ in range(k):
        at, what = rng.randrange(len(s) + 1), rng.randrange(3)
        if what == 0 or at == len(s):
            s.insert(at, rng.choice("abcdé"))
        elif what == 1:
            s[at] = rng.choice("abcdé")
        else:
            del s[at]
    return "".join(s)


def test_edit_kernel_and_segments():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randrange(30, 45)))
        b = mutated(rng, a, rng.randrange(0, 5))
        near = edits(a, b) <= lines.EDITS
        assert lines.within(a, b) == near == lines.within(b, a)
        if near and min(len(a), len(b)) >= lines.MIN_CHARS:
            short, long = sorted((a, b), key=len)
            index = {(len(short), i, short[x : x + n]) for i, (x, n) in enumerate(lines.segments(len(short)))}
            assert any((length, i, long[x : x + n]) in index for length, i, x, n in lines.selections(len(long)))


def test_lines_against_brute_force(spark, docs, empty):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(32, 60))).strip().ljust(31, "z") for _ in range(25)]
    rows = [(r[0], r[1]) for r in document_rows() if r[0] is not None and r[1] != document_rows()[-1][1]]
    rows = list(dict.fromkeys(rows)) + [(i, "\n".join(mutated(rng, rng.choice(base), rng.randrange(0, 3)) for _ in range(6))) for i in range(200, 240)]
    found = [(i, k, x.strip(" \t\n\x0b\f\r")) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n")) if t is not None]
    found = [o for o in found if len(o[2]) >= lines.MIN_CHARS]
    distinct = sorted({o[2] for o in found})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(distinct):
        for y in distinct[n + 1 :]:
            if abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2:
                root[find(y)] = find(x)
    first, want = {}, defaultdict(list)
    for o in found:
        if first.setdefault(find(o[2]), o) != o:
            want[o[0]].append(o[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed_lines for r in lines.dedup_report(df).collect() if r.removed_lines} == dict(want)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None and r.doc_id == 12)
    assert lines.dedup_lines(empty).count() == 0 and lines.dedup_report(empty).count() == 0


def test_large_groups_of_lines_lose_no_link(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(f"The meter was read on the {rng.randrange(60):02d} and shows {rng.randrange(30):02d} units" for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in components(lines.links(df)).collect()}
    assert whole and {tuple(r) for r in components(lines.links(df, group_limit=8)).collect()} == whole


def test_short_lines_go_if_equal(spark):
    rows = [(1, "All rights reserved.\n\nshort\n" + "a" * 29), (2, " All rights reserved.\nAll rights reserved!\nx\n\n" + "a" * 28 + "b"), (3, "x\n" + "a" * 29 + "\nshort\nshort"), (4, "c" * 30), (5, "c" * 29)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.removed_lines, r.first_ids) for r in lines.dedup_report(df).collect()}
    assert got == {1: ([], []), 2: ([0], [1]), 3: ([0, 1, 2, 3], [1, 2]), 4: ([], []), 5: ([], [])}
    text = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert text[2] == "All rights reserved!\nx\n\n" + "a" * 28 + "b" and text[3] == "" and text[1] == rows[0][1]


def plain_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_against_brute_force(docs, empty):
    rows = [(r[0], plain_fingerprint(r[1])) for r in document_rows()]
    values = sorted({f for _, f in rows})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(values):
        for b in values[n + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("n", [2, 70, 300])
def test_bit_sliced_comparison(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, size=max(1, n // 10), dtype=np.uint64)
    x = np.unique(np.array([int(base[i % len(base)]) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for i in range(n)], dtype=np.uint64))
    got = {(int(a), int(b)) for i, j in simhash.near(x) for a, b in zip(i, j, strict=True)}
    assert got == {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1}


def test_large_groups_are_dealt_again(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, size=8, dtype=np.uint64)
    x = np.unique(np.array([int(base[i % 8]) ^ (1 << int(rng.integers(32))) ^ (1 << int(rng.integers(64))) for i in range(600)], dtype=np.uint64))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    whole, split = ({r.node: r.root for r in components(simhash.link_fingerprints(df, limit)).collect()} for limit in (1024, 3))
    assert whole == split and whole


def test_mixing_meets_targets(docs, empty):
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == len(document_rows()) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sum(r.size for r in rows) == sum(len(words(r[1])) for r in document_rows())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken_words(docs).collect()), key=str)
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.taken_words(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0


def test_mixed_words_come_near_their_targets(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a"] * 6 + ["b"] * 2 + ["c", None])) for i in range(3000)]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        size[source[r.doc_id]] += r.size
    assert target == pytest.approx(mixing.targets(list(size.items()))) and sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_targets_are_reshared():
    got = mixing.targets([("a", 1000), ("b", 10), (None, 500)])
    assert got["b"] == 30 and got["a"] == pytest.approx(1480 / 4) and got[None] == pytest.approx(1480 * 3 / 4)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_sharding_is_a_permutation(docs, empty):
    rows = sharding.shard_documents(docs, 4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in document_rows())
    for r in rows:
        assert sharding.locate(r.row, len(rows), 4) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, len(rows), 4) == r.row
    assert sharding.shard_documents(empty).count() == 0
    for n in (1, 2, 3, 100, 1000):
        assert sorted(sharding.permute(np.arange(n), n, 3)) == list(range(n))


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.PrefixEncoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs, empty, coders):
    import public_tokenizers as P

    mine, theirs = coders
    rng = random.Random(1)
    for _ in range(800):
        t = "".join(rng.choice(["a", "é", "ß", "\x1c", "\x85", "​", " ", "\n", "1", "٣", "漢", "🙂", "'s", "'", "\t", "ab", "　", "\r\n", "ſ"]) for _ in range(rng.randrange(40)))
        ids = theirs.encode_ordinary(t)
        assert mine.encode(t) == ids and mine.decode(ids) == t.encode()
        assert mine.digests(pa.array([t, "a", t], pa.large_string()))[2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    out = bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert "doc" in out.columns and out.columns.count("n_tokens") == 1
    for r in out.collect():
        assert r.n_tokens == len(theirs.encode_ordinary(r.text or "")) and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_long_unbroken_text_in_linear_time(coders):
    mine, theirs = coders
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghinorst") for _ in range(1_000_000))
    start = time.process_time()
    (n, ids, data), = mine.digests(pa.array([text], pa.large_string()))
    assert time.process_time() - start < 60
    assert data == hashlib.sha256(text.encode()).hexdigest()
    assert mine.encode(text[:20_000]) == theirs.encode_ordinary(text[:20_000])
    assert not any(len(k) > bpe.LONGEST_KEY for c in (mine.seen, mine.chunks, mine.prefixes) for k in [*c.new, *c.old])


def test_bpe_appends_and_edits(coders):
    mine, theirs = coders
    rng = random.Random(8)
    for _ in range(500):
        data = bytes(rng.choice(b"abcdefghi ntherso\xc3\xa9\xff") for _ in range(rng.randrange(1, 60)))
        table = bpe.PrefixTable(mine, data[:10])
        table.append(data[10:])
        assert table.ids() == theirs._encode_single_piece(data)
        i = rng.randrange(len(data) + 1)
        j = rng.randrange(i, len(data) + 1)
        new = bytes(rng.choice(b"abcthe") for _ in range(rng.randrange(6)))
        table.replace(i, j, new)
        assert table.data == data[:i] + new + data[j:] and table.ids() == bpe.PrefixTable(mine, table.data).ids()
    long = bpe.PrefixTable(mine, b"the nation " * 400)
    assert long.replace(2000, 2003, b"x") < 200


def without_repeated_lines(rows):
    """(doc_id, text): of lines that are equal, or of 30 characters and more and two edits apart, the first one stays."""
    blanks, root = " \t\n\x0b\f\r", {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, t in rows:
        for x in t.split("\n"):
            root.setdefault(x.strip(blanks), x.strip(blanks))
    every = sorted(root)
    for n, a in enumerate(every):
        for b in every[n + 1 :]:
            if min(len(a), len(b)) >= 30 and abs(len(a) - len(b)) <= 2 and find(a) != find(b) and edits(a, b) <= 2:
                root[find(b)] = find(a)
    seen, out = set(), []
    for i, t in sorted(rows):
        kept = []
        for x in t.split("\n"):
            c = x.strip(blanks)
            if not c or find(c) not in seen:
                kept.append(x)
            if c:
                seen.add(find(c))
        out.append((i, "\n".join(kept)))
    return out


def test_pipeline_against_brute_force(spark, tmp_path, coders):
    import duckdb
    import pandas as pd

    from labframe.llm.queries import OP4_SQL
    from tests.llm.test_similar import kept as near_kept

    rng = random.Random(21)
    texts = [t for t in generated_texts() if rng.random() < 0.6]
    shared = "Subscribe to our letter and never miss what the council has decided in its meetings"
    for t in list(texts[:30]):  # on one line, so that a changed word keeps the whole line from going
        w = t.replace("\n", " ").split(" ")
        texts.append(" ".join(w))
        w[rng.randrange(len(w))] = "changedword"
        texts.append(" ".join(w))
    texts = [t + "\n" + shared[: 82 - i % 3] + "\nsee more" if i % 4 == 0 else t for i, t in enumerate(texts)] + [None, "", texts[0], texts[0]]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    fine = verdicts(texts)
    left = without_repeated_lines([(i, t) for i, t in enumerate(texts) if fine[t]])
    stay = set(near_kept(left))
    documents = pd.DataFrame([(i, t, rows[i][3]) for i, t in left if i in stay], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("documents", documents)
    copies = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({OP4_SQL})").fetchall() if size}
    want = Counter()
    for i, t, _ in documents.itertuples(index=False):
        if i in copies:
            ids = coders[1].encode_ordinary(t)
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += copies[i]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id in copies)
    assert got == +want and 10 < len(documents) < len(left) < len(texts)
    step = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == df.columns, name


def test_pipeline_with_nulls_and_clashing_columns(docs, empty, spark):
    for table in (docs, empty):
        step = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, "")
            assert step.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, step, "").count() == step.count()
