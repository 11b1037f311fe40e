"""Stored tables under change, the search index, and the document driver."""

import pytest

from labframe.operators import driver as DR
from labframe.operators import layout as L
from labframe.operators import search_index as IX
from labframe.operators import summary as SU
from labframe.sources import store as ST

KIND = "k long, v string"


def rows(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_readers_see_old_or_new_and_one_of_two_writers_fails(spark, tmp_path):
    store = ST.Store(spark, f"file://{tmp_path}/t")
    store.create(spark.createDataFrame([(i, "a") for i in range(20)] + [(None, "null")], KIND), ["k"], 4)
    before = store.read()
    seen = store.versions()[-1]
    assert store.upsert(spark.createDataFrame([(3, "b"), (3, "c"), (30, "new"), (None, "still null")], KIND)) == 1
    # A reader that began before the change goes on reading what it saw.
    assert rows(before) == [(None, "null"), *[(i, "a") for i in range(20)]]
    assert rows(store.read()) == sorted([(None, "still null"), *[(i, "c" if i == 3 else "a") for i in range(20)], (30, "new")], key=lambda r: (r[0] is not None, r))
    with pytest.raises(ST.Conflict):
        store.upsert(spark.createDataFrame([(1, "lost")], KIND), seen)
    assert store.versions() == [0, 1] and ("lost" not in {v for _, v in rows(store.read())})
    assert store.upsert(spark.createDataFrame([], KIND)) == 1
    assert store.delete(spark.createDataFrame([(i, "") for i in range(10, 40)], KIND)) == 2
    assert rows(store.read()) == [(None, "still null"), *[(i, "c" if i == 3 else "a") for i in range(10)]]
    assert rows(store.read(0)) == rows(before)
    assert store.vacuum(1) > 0 and store.versions() == [2] and len(rows(store.read())) == 11


def test_a_change_rewrites_touched_buckets_only(spark, tmp_path):
    store = ST.Store(spark, f"file://{tmp_path}/t")
    store.create(spark.createDataFrame([(i, "a") for i in range(200)], KIND), ["k"], 16)
    old = store.manifest()["parts"]
    store.upsert(spark.createDataFrame([(7, "b")], KIND))
    assert sum(old[b] != p for b, p in store.manifest()["parts"].items()) == 1
    with pytest.raises(ValueError):
        store.replace(spark.createDataFrame([(7, "b")], KIND), ["v"])


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    store = ST.Store(spark, f"file://{tmp_path}/t")
    store.create(spark.createDataFrame([(1, "a")], KIND), ["k"], 2)
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        store.upsert(spark.createDataFrame([(1, "b")], KIND))
    assert rows(ST.Store(spark, f"file://{tmp_path}/t").read()) == [(1, "a")]


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    texts = [(1, "Anna LOPEZ"), (1, "second text"), (2, None), (3, "100% sure"), (4, "a_b"), (5, "axb"), (6, "lop ope pez"), (7, "ÄÖÜ straße"), (8, "")]
    index = IX.SearchIndex(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(texts, "id long, text string"), 1)
    changed = [(5, "now Lopez too"), (1, "gone")]
    now = [t for t in texts if t[0] not in (1, 5)] + changed
    for standing, terms in ((texts, ["lopez", "PEZ", "%", "a_b", "äöü", "ond t", "", "x"]), (now, ["lopez", "gone", "axb", "second", "e"])):
        if standing is now:
            index.add(spark.createDataFrame(changed, "id long, text string"), 2)
            index.add(spark.createDataFrame(changed, "id long, text string"), 2)  # a replay
        for term in terms:
            assert {r.id for r in index.search(term).collect()} == {i for i, t in standing if t is not None and term.lower() in t.lower()}, term


def test_bad_uploads_land_in_quarantine(spark):
    text = "a page with more than twenty letters"
    uploads = [
        ("ok", f"%PDF-1.7\n{text}\f\fshort\f".encode()), ("locked", b"%PDF-1.7 /Encrypt\nx"), ("long", b"%PDF-1\n" + b"p\f" * 9), ("broken", b"%PDF-1\n\xff\xfe"), ("none", None), ("empty", b""), ("image", b"\xff\xd8\xff\xe0"),
        ("only head", b"%PDF-1.7"),
    ]
    pages, bad = DR.split_quarantine(DR.analyze(spark.createDataFrame(uploads, "document_id string, content binary"), 5))
    assert sorted(tuple(r) for r in pages.collect()) == sorted([("ok", 1, "PDF_NATIVE", text), ("ok", 2, "OCR", None), ("ok", 3, "OCR", None), ("image", 1, "OCR", None), ("only head", 1, "OCR", None)], key=lambda r: r[:2])
    assert {(r.document_id, r.error_type, r.step) for r in bad.collect()} == {
        ("locked", "PasswordProtected", "open"), ("long", "TooManyPages", "count"), ("broken", "Unreadable", "open"), ("none", "UnsupportedType", "sniff"), ("empty", "UnsupportedType", "sniff")}
    # The same in SQL, and a failure of the reader itself concerns its document only.
    DR.register(spark)
    assert spark.sql("SELECT error_type FROM analyze_document('d', X'255044462D310A41', NULL)").first()[0] is None


def test_words_meet_boxes_by_grid_cells(spark):
    """A page of very many boxes of all sizes, and points on edges, against a comparison of all pairs."""
    rng = __import__("random").Random(4)
    boxes = [(p, float(rng.randrange(2000)), float(rng.randrange(2000)), float(rng.choice([0, 1, 15, 16, 17, 40, 700])), float(rng.choice([0, 3, 16, 33, 900]))) for p in (1, 1, 2) for _ in range(40)] + [(1, None, 1.0, 1.0, 1.0)]
    words = [(i, rng.choice([1, 2, 3]), float(rng.randrange(2100)), float(rng.randrange(2100)), float(rng.randrange(20)), 8.0) for i in range(900)] + [(999, 1, None, 0.0, 1.0, 1.0)]
    words += [(2000 + i, b[0], b[1] - 2.0, b[2] - 4.0, 4.0, 8.0) for i, b in enumerate(boxes) if b[1] is not None]
    native = spark.createDataFrame(boxes, "page int, x double, y double, w double, h double")
    scanned = spark.createDataFrame(words, "i int, page int, x double, y double, w double, h double")

    def outside(w):
        if w[2] is None:
            return True
        cx, cy = w[2] + w[4] / 2, w[3] + w[5] / 2
        return not any(b[0] == w[1] and b[1] is not None and b[1] <= cx <= b[1] + b[3] and b[2] <= cy <= b[2] + b[4] for b in boxes)

    assert {r.i for r in L.words_outside(scanned, native, ["page"]).collect()} == {w[0] for w in words if outside(w)}
    assert L.words_outside(scanned, native.limit(0), ["page"]).count() == len(words)


def test_a_kept_summary_equals_the_full_one(spark, tmp_path):
    kept = SU.KeptSummary(spark, f"file://{tmp_path}/s", 4)
    kind = "doc_id long, field_id string, field_name string, value string, state string"
    first = [(d, f"{d}:{f}", f, f"{f} of {d}", "EXTREME_VALUE" if d == 2 else "VALID") for d in range(5) for f in ("patient_name", "glucose")]
    kept.extracted(spark.createDataFrame(first, kind))
    fixes = spark.createDataFrame([(1, "1:patient_name", 1, "no", "VALID"), (1, "1:patient_name", 2, "yes", "VALID"), (2, "2:glucose", 1, "9", "VALID"), (2, "2:patient_name", 1, "x", "VALID"), (9, "9:glucose", 1, "1", "VALID")], "doc_id long, field_id string, seq int, new_value string, state string")
    for _ in range(2):  # a replay
        kept.corrected(fixes)
    kept.extracted(spark.createDataFrame([(3, "3:patient_id", "patient_id", "P", "FLAG_MISMATCH")], kind))
    got = {r.doc_id: (r.patient_name, r.patient_id, r.n_fields, r.needs_attention) for r in kept.read().collect()}
    assert got == {0: ("patient_name of 0", None, 2, False), 1: ("yes", None, 2, False), 2: ("x", None, 2, False), 3: (None, "P", 1, True), 4: ("patient_name of 4", None, 2, False)}
    assert sorted(map(tuple, SU.summarize(kept.fields.read()).collect()), key=str) == sorted(map(tuple, kept.read().collect()), key=str)
