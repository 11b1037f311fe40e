"""Parts that no query uses: readers of uploads and artifacts, settings, guards of exports, audit and consent, what an approval writes."""

import json

import pytest

from labframe.functions import numbers as N
from labframe.operators import lifecycle as M
from labframe.operators import metrics as MX
from labframe.operators import pipeline as P
from labframe.operators import providers as PR
from labframe.operators import relational as R
from labframe.operators import review as W
from labframe.sources import files as S
from labframe.sources.config import Settings


def test_uploads_are_sorted_into_accepted_and_quarantined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MAX_UPLOAD_BYTES", 50)
    for name, content in {"a.pdf": b"%PDF-1.7 x", "b.png": b"\x89PNG\r\n\x1a\n", "c.txt": b"plain", "d.pdf": b"%PDF" + b"x" * 60}.items():
        (tmp_path / name).write_bytes(content)
    good, bad = S.uploads(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.mime) for r in good.collect()} == {("a.pdf", "application/pdf"), ("b.png", "image/png")}
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()} == {("c.txt", "unsupported type"), ("d.pdf", "too large")}


def test_artifacts_give_a_row_per_page(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1.0", "document_id": "d1", "pages": [{"page_number": 1}, {"page_number": 2}]}))
    (tmp_path / "b.json").write_text("{ not json")
    rows = S.artifacts(spark, str(tmp_path)).collect()
    assert sorted((r.document_id or "", r.n_pages or 0) for r in rows)[-2:] == [("d1", 2), ("d1", 2)] and any(r.document_id is None for r in rows)


def test_settings_lie_over_the_defaults(spark):
    stored = spark.createDataFrame([("auto_accept", "0.8"), ("unknown", "5"), ("high", "no number")], "key string, value string")
    assert S.settings(stored, {"auto_accept": 0.9, "high": 0.7}).first().asDict() == {"auto_accept": 0.8, "high": 0.7}
    assert S.settings(stored.limit(0), {"high": 0.7}).first().asDict() == {"high": 0.7}


def test_an_export_over_the_limit_is_refused(spark):
    assert R.guarded_export(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="more than 4"):
        R.guarded_export(spark.range(5), 4)


def test_confidence_is_shown_in_percent(spark):
    df = spark.createDataFrame([(0.956,), (1.0,), (95.6,), (None,)], "c double")
    assert [r[0] for r in df.select(N.scale_confidence(df.c)).collect()] == [95.6, 100.0, 95.6, None]


def test_the_log_is_for_admins_and_documents_for_all(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "audit_id int, resource_id string")
    assert [M.visible_audit(log, *who).count() for who in (("ADMIN",), ("VIEWER",), ("VIEWER", "a"))] == [3, 0, 2]


def test_documents_leave_with_consent_only(spark):
    docs = spark.range(3)
    assert [M.consented(docs, *who).count() for who in (("rule_based", False), ("remote", False), ("remote", True))] == [3, 0, 3]


def test_rows_replace_those_with_their_keys(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (1, "b"), (2, "c")], [(1, "d")]))
    assert sorted(tuple(r) for r in M.replace_rows(old, new, ["k"]).collect()) == [(1, "d"), (2, "c")]


def test_an_approval_writes_its_corrections_and_states(spark):
    changes = spark.createDataFrame([("f1", 1, "90", "95", None, "mg/dL", "typo"), ("f2", 1, "1", "2", None, None, "typo")], "field_id string, seq int, previous_value string, new_value string, previous_unit string, new_unit string, reason string")
    fields = spark.createDataFrame([(1, "f1", "glucose", "95", "mg/dL", "95", "VALID", []), (2, "f2", "glucose", "2", None, "2", "MISSING", ["x"])], "doc int, field_id string, field_name string, value string, unit string, normalized_value string, state string, messages array<string>")
    done = spark.createDataFrame([(1, "HUMAN_APPROVED"), (2, "UNRESOLVED_VALIDATION_ISSUES")], "doc int, outcome string")
    audit, states = W.outcome_rows(changes, fields, done, "doc")
    rows = audit.collect()
    assert [(r.action, r.resource_id) for r in rows] == [("FIELD_CORRECTED", "f1")]
    assert json.loads(rows[0].before_state) == {"value": "90", "document_id": 1, "field_name": "glucose"} and json.loads(rows[0].after_state) == {"value": "95", "reason": "typo", "unit": "mg/dL"}
    assert [(r.field_id, r.is_valid) for r in states.collect()] == [("f1", True)]


def test_metrics_come_from_the_pass_that_writes(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0.02), ("A", 7.0), ('b"', None)], "status string, seconds double")
    text = MX.Metrics().gauge("docs", "status", ["A", 'b"', "C"], "status").histogram("latency", "seconds", [0.1, 10.0]).write(rows, f"file://{tmp_path}/out")
    assert text.splitlines() == [
        "# TYPE docs gauge", 'docs{status="A"} 2.0', 'docs{status="b\\""} 1.0', 'docs{status="C"} 0.0', "# TYPE latency histogram", 'latency_bucket{le="0.1"} 1.0', 'latency_bucket{le="10.0"} 2.0',
        'latency_bucket{le="+Inf"} 2.0', "latency_sum 7.02", "latency_count 2.0"]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def test_answers_are_checked_and_failures_fall_back(spark):
    pages = spark.createDataFrame([(i, 1, "Glucose 92 mg/dL") for i in range(8)] + [(8, 1, None)], "doc long, page_num int, text string")
    fine = json.dumps([{"field_name": "glucose", "value": "95", "unit": "mg/dL", "confidence": 90.0, "page_num": 1}])
    said = {0: (200, fine), 1: (403, ""), 2: (500, "busy"), 3: (200, "no json"), 4: (200, fine.replace("glucose", "weight")), 5: (200, fine.replace("90.0", "900")), 6: (200, "[]"), 7: (200, "null")}

    def checked(df, by):
        rows = [(i, s, a) for i, (s, a) in said.items()]
        return PR.checked(spark.createDataFrame(rows, "doc long, status int, answer string"), by)

    kinds = {r.doc: r.error_type for r in checked(pages, "doc").collect()}
    assert kinds == {0: None, 1: "PermanentProviderError", 2: "RetryableProviderError", 3: "SchemaError", 4: "SchemaError", 5: "SchemaError", 6: None, 7: "SchemaError"}
    got = {(r.doc, r.value, r.extractor) for r in PR.extract(pages, "doc", checked).collect() if r.field_name}
    assert got == {(0, "95", "primary"), *[(i, "92", "rule_based") for i in (1, 2, 3, 4, 5, 7)]}


def test_rules_read_only_documents_that_failed(spark, monkeypatch):
    pages = spark.createDataFrame([(i, 1, "Glucose 92 mg/dL") for i in range(4)], "doc long, page_num int, text string")
    fine = json.dumps([{"field_name": "glucose", "value": "95", "unit": "mg/dL", "confidence": 90.0, "page_num": 1}])
    answered = spark.createDataFrame([(0, 200, fine), (1, 403, ""), (2, 503, ""), (3, 200, "[]")], "doc long, status int, answer string")
    rules, read = PR.rule_based, []
    monkeypatch.setattr(PR, "rule_based", lambda some, by: read.extend(r.doc for r in some.collect()) or rules(some, by))
    got = PR.extract(pages, "doc", lambda df, by: PR.checked(answered, by)).filter("field_name IS NOT NULL").collect()
    assert sorted(read) == [1, 2] and {(r.doc, r.value) for r in got} == {(0, "95"), (1, "92"), (2, "92")}


def test_a_provider_gets_one_prompt_per_document(spark):
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, None)], "doc long, page_num int, text string")

    def ask(prompts):
        return [(200, json.dumps([{"field_name": "patient_id", "value": p.split("\n", 1)[1], "confidence": 80}])) for p in prompts]

    with pytest.raises(ValueError, match="consent"):
        PR.extractor("remote", ask)
    with pytest.raises(ValueError, match="no provider"):
        PR.extractor("remote")
    assert {r.doc: r.value for r in PR.extractor("remote", ask, True)(pages, "doc").collect()} == {1: "first\nsecond", 2: ""}

    def broken(prompts):
        raise ConnectionError("down")

    assert {r.error_type for r in PR.extractor("remote", broken, True)(pages, "doc").collect()} == {"RetryableProviderError"}


def test_settings_are_typed_and_checked(spark):
    s = Settings.read({"DATE_ORDER": "DMY", "page_cap": "20", "other": "x", "secret": " "}, {"PAGE_CAP": "30", "fallback": "yes"})
    assert (s.date_order, s.page_cap, s.fallback, s.secret, s.auto_accept) == ("DMY", 30, True, "", 0.9)
    for bad, why in [
        ({"date_order": "YMD"}, "date_order"), ({"page_cap": "many"}, "type int"), ({"fallback": "perhaps"}, "true or false"), ({"auto_accept": "0.4"}, "auto_accept"), ({"low_confidence": "0.95"}, "low_confidence"),
        ({"provider": "remote"}, "consent"), ({"environment": "production", "secret": "short"}, "secret"), ({"environment": "production", "secret": "x" * 32}, "storage_key"), ({"environment": "test"}, "environment"),
    ]:
        with pytest.raises(ValueError, match=why):
            Settings.read(bad)
    assert Settings.read({"environment": "production", "secret": "x" * 32, "storage_key": "k"}).environment == "production"
    # The order of numeric dates is a setting of the flow.
    fields = spark.createDataFrame([(1, "collection_date", "03/04/2025", None, None, None, 99.0, 1)], "doc int, field_name string, value string, unit string, reference_range string, abnormal_flag string, confidence double, page_num int")
    got = {order: P.validate(fields, "doc", today="2026-01-01", order=order).filter("field_name = 'collection_date'").first().normalized_value for order in ("MDY", s.date_order)}
    assert got == {"MDY": "2025-03-04", "DMY": "2025-04-03"}
