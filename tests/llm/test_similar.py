"""The pipeline's near-duplicate stage against brute force: Jaccard similarity of 0.8 over five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from labframe.llm import similar
from tests.llm.conftest import document_rows


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    """The ids that stay, by comparing all pairs."""
    sets = sorted({shingles(t) for _, t in rows}, key=sorted)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for n, a in enumerate(sets):
        for b in sets[n + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(b)] = find(a)
    least = {}
    for i, t in rows:
        if i is not None:
            least[find(shingles(t))] = min(i, least.get(find(shingles(t)), i))
    return sorted(least.values())


def generated():
    """Originals, copies with some words changed (similarity from 0.5 to 1, many near 0.8), and a passage that many hold."""
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(12):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(50, 160))]
        w += passage if i % 2 else []
        rows.append(" ".join(w))
        for _ in range(14):
            c = list(w)
            for _ in range(rng.randrange(1, 6)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary).upper()
            rows.append(" ".join(c[: len(c) - rng.randrange(4)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_stage_reaches_all_pairs_of_four_fifths(spark):
    rows = generated()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    assert 12 < len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, df, "").collect()) == want
    assert sorted(r.doc_id for r in similar.keep_one(df, group_limit=4, small_group=2).collect()) == want
    assert sorted(r.doc_id for r in similar.keep_one(df, group_limit=1000, small_group=2).collect()) == want


def test_numbers_in_common():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60 if i < 20 else 400, rng.integers(0, 80))) for i in range(40)]
    got = similar.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_near_stage_on_awkward_rows(docs, empty):
    out = similar.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == kept([(r[0], r[1]) for r in document_rows()])
    assert similar.keep_one(empty).count() == 0
