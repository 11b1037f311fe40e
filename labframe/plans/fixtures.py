"""Derived inputs (FIXTURES.md) as one SQL text for both engines; ``{div}`` is the integer division operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RPT_FIELDS = """
SELECT event_id, event_id {div} 5 AS report_id,
  CASE event_id % 5 WHEN 0 THEN 'glucose' WHEN 1 THEN 'hemoglobin' WHEN 2 THEN 'hematocrit' WHEN 3 THEN 'white_blood_cell_count' ELSE 'platelet_count' END AS field_name,
  CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 53 = 0 THEN 'pending'
       WHEN event_id % 41 = 0 THEN CASE WHEN shown LIKE '%.%' THEN replace(shown, '.', '') ELSE concat(shown, '0') END ELSE shown END AS value,
  CASE WHEN u = 'x' THEN 'furlongs' WHEN u = 'none' THEN NULL
       WHEN u = 'alt' THEN CASE event_id % 5 WHEN 0 THEN 'mmol/L' WHEN 1 THEN 'g/L' WHEN 2 THEN 'L/L' ELSE '/uL' END
       ELSE CASE event_id % 5 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'g/dL' WHEN 2 THEN '%' ELSE 'x10^3/uL' END END AS unit,
  CASE WHEN u = 'canon' AND event_id % 3 = 0 THEN CASE event_id % 5 WHEN 0 THEN '70 - 100' WHEN 1 THEN '12.0 - 17.5' WHEN 2 THEN '36 - 50' WHEN 3 THEN '4.5 - 11.0' ELSE '150 - 450' END END AS reference_range,
  CASE WHEN event_id % 11 = 0 THEN 'H' WHEN event_id % 13 = 0 THEN 'L' END AS abnormal_flag,
  60 + c % 41 AS confidence, CASE WHEN event_id % 5 < 3 THEN 1 ELSE 2 END AS page_num,
  CASE (event_id {div} 5) % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex,
  CASE WHEN (event_id {div} 5) % 17 <> 0 THEN (event_id {div} 5) % 90 END AS age
FROM (
  SELECT *, CASE WHEN u = 'alt' THEN CASE event_id % 5 WHEN 0 THEN CAST(3 + c % 12 AS STRING) WHEN 1 THEN CAST(t10 AS STRING)
                 WHEN 2 THEN concat('0.', lpad(CAST(t10 AS STRING), 3, '0')) ELSE CAST(t10 * 100 AS STRING) END
            WHEN event_id % 5 IN (0, 4) THEN CAST(t10 {div} 10 AS STRING) ELSE concat(CAST(t10 {div} 10 AS STRING), '.', CAST(t10 % 10 AS STRING)) END AS shown
  FROM (
    SELECT *, CASE event_id % 5 WHEN 0 THEN (40 + c % 161) * 10 WHEN 1 THEN 80 + c % 121 WHEN 2 THEN 250 + c % 301 WHEN 3 THEN 20 + c % 141 ELSE (80 + c % 471) * 10 END AS t10,
           CASE WHEN event_id % 59 = 0 THEN 'x' WHEN event_id % 7 = 6 THEN 'none' WHEN event_id % 7 = 5 THEN 'alt' ELSE 'canon' END AS u
    FROM (SELECT event_id, CAST(round(abs(value) * 100) AS BIGINT) AS c FROM events) e1
  ) e2
) e3
"""

DOC_CATALOG = """
SELECT d.doc_id, concat(d.source, '_', CAST(d.doc_id AS STRING), '.pdf') AS filename, {sha} AS content_hash,
  TIMESTAMP '2024-01-01 00:00:00' + {minutes} AS created_at,
  CASE d.doc_id % 8 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'AUTO_ACCEPTED' WHEN 3 THEN 'REVIEW_REQUIRED'
       WHEN 4 THEN 'REVIEW_IN_PROGRESS' WHEN 5 THEN 'HUMAN_APPROVED' WHEN 6 THEN 'HUMAN_REJECTED' ELSE 'FAILED' END AS status,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.lang END AS doc_type,
  CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE CAST(d.n_chars % 100 AS DOUBLE) / 100 END AS overall_confidence,
  coalesce(l.toxic = 1, false) AS attention
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

RPT_DATES = """
SELECT o_orderkey, o_custkey, collected, received, dob, CASE o_orderkey % 6
    WHEN 0 THEN {iso} WHEN 1 THEN concat({mm}, '/', {dd}, '/', {yy}) WHEN 2 THEN concat({dd}, '/', {mm}, '/', {yy})
    WHEN 3 THEN concat({dd}, '.', {mm}, '.', {yy}) WHEN 4 THEN concat({dd}, '-', {mon}, '-', {yy}) ELSE concat({yy}, '/', {mm}, '/', {dd}) END AS printed
FROM (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS collected, r.received, {dob} AS dob
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS received FROM lineitem GROUP BY l_orderkey) r ON r.l_orderkey = o_orderkey
) x
"""

CORRECTIONS = """
SELECT conv_id AS field_id, turn AS seq, text AS new_value, CASE WHEN turn % 3 = 0 THEN role END AS new_unit, role AS reason
FROM conversations
"""

JOBS = """
SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'RETRYING' END AS status,
  ts AS updated_at, event_id % 4 AS recovery_count
FROM events
"""

AUDIT = "SELECT event_id AS audit_id, event_type AS action, user_id, CAST(user_id AS STRING) AS resource_id, props AS before_state, ts AS created_at FROM events"

EVAL = """
SELECT l.doc_id, l.quality AS truth, d.n_chars >= 1000 AS accepted, d.lang, d.source,
  CASE WHEN l.doc_id % 23 = 0 THEN 'missing' WHEN (d.n_chars >= 1000) = (l.quality = 1) THEN 'correct' ELSE 'wrong' END AS outcome
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""

BOXES = """
SELECT vec_id, label, CAST(vec_id % 3 + 1 AS INT) AS page, vec_id % 101 AS confidence,
  least(1000, CAST(floor(abs(CAST(embedding[{i0}] AS DOUBLE)) * 1000) AS BIGINT)) AS x, least(1000, CAST(floor(abs(CAST(embedding[{i1}] AS DOUBLE)) * 1000) AS BIGINT)) AS y,
  least(1000, CAST(floor(abs(CAST(embedding[{i2}] AS DOUBLE)) * 1000) AS BIGINT)) AS w, least(1000, CAST(floor(abs(CAST(embedding[{i3}] AS DOUBLE)) * 1000) AS BIGINT)) AS h
FROM embeddings
"""

RPT_DOCS = """
SELECT r.report_id, o.o_orderkey, o.printed, o.collected, o.received, o.dob
FROM (SELECT DISTINCT event_id {div} 5 AS report_id FROM events) r LEFT JOIN (""" + RPT_DATES + """) o ON o.o_orderkey = r.report_id
"""

RPT_HEADER = """
SELECT report_id, field_name, value FROM (
  SELECT report_id, field_name, CASE field_name
    WHEN 'patient_name' THEN CASE WHEN report_id % 7 = 0 THEN 'maria Lopez' ELSE 'Jane Roe' END
    WHEN 'patient_id' THEN CASE WHEN report_id % 11 <> 0 THEN concat('A-', CAST(report_id AS STRING)) END
    WHEN 'patient_sex' THEN CASE report_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'F' ELSE 'Unknown' END
    WHEN 'specimen_type' THEN 'whole blood' WHEN 'date_of_birth' THEN CAST(dob AS STRING) WHEN 'collection_date' THEN printed
    ELSE CASE WHEN report_id % 31 = 0 THEN '31/31/2020' ELSE CAST(received AS STRING) END END AS value
  FROM (SELECT *, {each} AS field_name FROM (""" + RPT_DOCS + """) d) e
) h WHERE value IS NOT NULL
"""
_HEADER_NAMES = "'patient_name', 'patient_id', 'patient_sex', 'specimen_type', 'date_of_birth', 'collection_date', 'received_date'"

#: Requests for reviews: twenty users, some fifty documents, an admin among the users.
REQUESTS = """
SELECT CAST(event_id % 53 AS BIGINT) AS document_id, event_id AS seq, event_id * 420 AS t, (event_id * 7) {div} 3 % 20 AS user_id, (event_id * 7) {div} 3 % 20 = 0 AS admin,
  CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'claim' WHEN 'error' THEN 'release'
       ELSE CASE WHEN event_id % 5 = 0 THEN 'approve' WHEN event_id % 5 = 1 THEN 'reject' ELSE 'claim' END END AS action,
  CASE WHEN event_id % 3 = 0 THEN 'unreadable' WHEN event_id % 3 = 1 THEN ' ' END AS reason
FROM events
"""

SPARK = {
    "div": "div", "sha": "sha2(d.text, 256)", "minutes": "make_dt_interval(0, 0, CAST(d.doc_id * 37 AS INT))", "iso": "date_format(collected, 'yyyy-MM-dd')",
    "mm": "date_format(collected, 'MM')", "dd": "date_format(collected, 'dd')", "yy": "date_format(collected, 'yyyy')", "mon": "date_format(collected, 'MMM')",
    "dob": "date_add(DATE '1930-01-01', CAST((o_custkey * 97) % 30000 AS INT))", "i0": "0", "i1": "1", "i2": "2", "i3": "3",
    "each": f"explode(array({_HEADER_NAMES}))",
}
DUCK = {
    "div": "//", "sha": "sha256(d.text)", "minutes": "to_minutes(d.doc_id * 37)", "iso": "strftime(collected, '%Y-%m-%d')",
    "mm": "strftime(collected, '%m')", "dd": "strftime(collected, '%d')", "yy": "strftime(collected, '%Y')", "mon": "strftime(collected, '%b')",
    "dob": "CAST(DATE '1930-01-01' + CAST((o_custkey * 97) % 30000 AS INT) AS DATE)", "i0": "1", "i1": "2", "i2": "3", "i3": "4",
    "each": f"unnest([{_HEADER_NAMES}])",
}
VIEWS = {
    "rpt_fields": RPT_FIELDS, "doc_catalog": DOC_CATALOG, "rpt_dates": RPT_DATES, "corrections": CORRECTIONS, "jobs": JOBS, "audit": AUDIT,
    "eval_rows": EVAL, "boxes": BOXES, "rpt_docs": RPT_DOCS, "rpt_header": RPT_HEADER, "requests": REQUESTS,
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; only the tables that it names are opened."""
    text = VIEWS[name].format(**SPARK)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in text.replace("\n", " ").replace(")", " ") + " "}
    for t, df in used.items():
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **used)


def duck(*names: str) -> str:
    """WITH clause that defines the views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**DUCK)})" for n in names)
