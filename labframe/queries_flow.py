"""Queries of whole flows: text to fields, fields to a decision, reviews, jobs, purges, exports and the evaluation."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe import schema
from labframe.functions import numbers as N
from labframe.functions import text as X
from labframe.operators import driver as DR
from labframe.operators import extract as E
from labframe.operators import layout as L
from labframe.operators import lifecycle as M
from labframe.operators import metrics as MX
from labframe.operators import pipeline as P
from labframe.operators import providers as PR
from labframe.operators import relational as R
from labframe.operators import review as W
from labframe.operators import search_index as IX
from labframe.operators import summary as SU
from labframe.plans.fixtures import duck, view
from labframe.registry import DECIDED, SQL, query
from labframe.sources import files as S
from labframe.sources import store as ST
from labframe.streaming import ordered as O
from labframe.streaming import streams as T

TODAY = "1997-01-01"
#: How many seconds after its time an event of the streams may come.
LAG = 6 * 3600
FILLER = " ".join(f"q{c}" for c in "abcdefghijklm")
PRINTED = {
    "glucose": ["Glucose", "Glu", "Glucose, fasting"], "hemoglobin": ["Hemoglobin", "Haemoglobin", "Hgb"], "hematocrit": ["Hematocrit", "Haematocrit", "Hct"],
    "white_blood_cell_count": ["White blood cell count", "WBC count", "Leukocytes"], "platelet_count": ["Platelet count", "Platelets", "PLT"],
}
HEADS = {
    "patient_name": ["Patient Name:", "Patient Name", "Patient:"], "patient_id": ["Patient ID:", "MRN No.", "Medical record number:"], "patient_sex": ["Sex:", "Gender", "Sex :"],
    "specimen_type": ["Specimen Type:", "Sample", "Specimen:"], "date_of_birth": ["DOB:", "Date of Birth:", "D.O.B."], "collection_date": ["Collection Date:", "Collected on", "Draw date"],
    "received_date": ["Received Date:", "Received", "Date received:"],
}


def _variant(names: dict[str, list[str]], pick: str):
    out = F.lit(None).cast("string")
    for name, forms in names.items():
        out = F.when(F.col("field_name") == name, F.element_at(F.array(*map(F.lit, forms)), (F.col(pick) % 3).cast("int") + 1)).otherwise(out)
    return out


# Extraction -------------------------------------------------------------------------------------------------------------

def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """report_id, page_num, text: one result per line, with decoys before it; page 2 prints glucose once more, with a number that
    must not win."""
    f = view(spark, sf, "rpt_fields")
    label = F.concat(_variant(PRINTED, "event_id"), F.when(F.col("event_id") % 2 == 0, ":").otherwise(""))
    own = F.when(F.col("event_id") % 4 == 0, F.concat_ws(" ", label, "value", "abnormal_flag", "unit", F.concat(F.lit("("), "reference_range", F.lit(")"))))
    line = own.otherwise(F.concat_ws(" ", label, "value", "unit", "abnormal_flag", "reference_range"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.when(F.col("page_num") == 1, "Physician Name: Dr Rao\nEstimated Average Glucose 140 mg/dL\nMean Cell Hemoglobin 24.0 pg 27 - 33\nHemoglobin A1c 5.5 %\n").otherwise("Glucose: 999 mg/dL\n")
    return f.groupBy("report_id", "page_num").agg(F.concat(head, lines).alias("text"))


@query(duck("rpt_fields") + r"""SELECT report_id, field_name, value, CASE WHEN unit = 'furlongs' THEN NULL ELSE unit END AS unit,
  CASE WHEN unit <> 'furlongs' OR unit IS NULL OR event_id % 4 = 0 THEN abnormal_flag END AS flag,
  CASE WHEN unit = 'furlongs' THEN NULL ELSE reference_range END AS ref, page_num
FROM rpt_fields WHERE value IS NOT NULL AND value <> 'pending'
UNION ALL SELECT report_id, 'glucose', '999', 'mg/dL', NULL, NULL, 2 FROM rpt_fields WHERE field_name = 'glucose' AND (value IS NULL OR value = 'pending')""")
def q_extract_results(spark, sf):
    got = E.extract_results(result_pages(spark, sf), "report_id")
    return got.select("report_id", "field_name", "value", "unit", "flag", "ref", "page_num")


@query(duck("rpt_fields") + """SELECT report_id, CAST(CASE WHEN value IS NULL OR value = 'pending' THEN 2 ELSE 1 END AS INT) AS page_num FROM rpt_fields WHERE field_name = 'glucose'""")
def q_first_page_wins(spark, sf):
    return E.extract_results(result_pages(spark, sf), "report_id", ["glucose"]).select("report_id", "page_num")


def header_pages(spark: SparkSession, sf: str) -> DataFrame:
    """report_id, page_num, text: the other fields under varied labels, two to a line where the report's number is even."""
    h = view(spark, sf, "rpt_header").withColumn("pick", F.col("report_id") + F.length("field_name"))
    line = F.struct("field_name", F.concat_ws(" ", _variant(HEADS, "pick"), "value").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    text = F.when(F.col("report_id") % 2 == 0, F.array_join(lines, "\n")).otherwise(F.array_join(lines, "  "))
    return h.groupBy("report_id").agg(F.concat(F.lit("Referring Physician Name: Dr Rao\n"), text).alias("text")).withColumn("page_num", F.lit(1))


@query(duck("rpt_header") + "SELECT report_id, field_name, value FROM rpt_header WHERE value <> 'Unknown'")
def q_extract_header(spark, sf):
    return E.extract_header(header_pages(spark, sf), "report_id").select("report_id", "field_name", "value")


@query(duck("rpt_fields") + r"""SELECT report_id, field_name, round(0.1 * n, 4)::DOUBLE AS x, round(0.1 * (m - 1) + 0.08, 4)::DOUBLE AS right_edge, (90.0 + (n + m - 1) / 2.0)::DOUBLE AS confidence FROM (
  SELECT *, CASE event_id % 3 WHEN 0 THEN CASE field_name WHEN 'white_blood_cell_count' THEN 4 WHEN 'platelet_count' THEN 2 ELSE 1 END
    WHEN 1 THEN CASE field_name WHEN 'white_blood_cell_count' THEN 2 ELSE 1 END ELSE CASE field_name WHEN 'glucose' THEN 2 ELSE 1 END END AS n,
    n + 1 + CASE WHEN unit IS NULL OR unit = 'furlongs' THEN 0 WHEN event_id % 4 = 0 AND abnormal_flag IS NOT NULL THEN 2 ELSE 1 END AS m
  FROM rpt_fields WHERE value IS NOT NULL AND value <> 'pending')""")
def q_word_boxes(spark, sf):
    pages = result_pages(spark, sf)
    words = E.words_of(pages, "report_id").withColumns({"confidence": F.lit(90.0) + F.col("nth"), "box": F.array(F.col("nth") * 0.1, F.col("line_no") * 0.01, F.lit(0.08), F.lit(0.008))})
    boxed = E.field_boxes(E.extract_fields(pages, "report_id", schema.NUMERIC_FIELDS), words, "report_id").filter("value <> '999'")
    return boxed.select("report_id", "field_name", F.round(F.col("box")[0], 4).alias("x"), F.round(F.col("box")[0] + F.col("box")[2], 4).alias("right_edge"), "confidence")


# Validation -------------------------------------------------------------------------------------------------------------

def field_rows(spark: SparkSession, sf: str) -> DataFrame:
    """report_id, field_name, value, unit, reference_range, abnormal_flag, confidence, page_num: results and other fields."""
    none = F.lit(None).cast("string")
    head = view(spark, sf, "rpt_header").withColumns({"unit": none, "reference_range": none, "abnormal_flag": none, "confidence": F.lit(99.0), "page_num": F.lit(1)})
    results = view(spark, sf, "rpt_fields").withColumn("confidence", F.col("confidence").cast("double"))
    return results.select("report_id", "field_name", *P.FIELD).unionByName(head.select("report_id", "field_name", *P.FIELD))


def checked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages that the fields are checked against: each value behind its label, but for one result in 29 a note instead."""
    f = view(spark, sf, "rpt_fields")
    line = F.when(F.col("event_id") % 29 == 0, F.concat_ws(" ", _variant(PRINTED, "event_id"), F.lit("see note"))).otherwise(F.concat_ws(" ", _variant(PRINTED, "event_id"), "value", "unit", "reference_range"))
    results = f.select("report_id", "page_num", F.concat_ws(" ", line, F.lit(FILLER)).alias("line"))
    head = view(spark, sf, "rpt_header").select("report_id", F.lit(1).alias("page_num"), F.concat_ws(" ", F.element_at(F.create_map(*[F.lit(x) for k, v in HEADS.items() for x in (k, v[0])]), F.col("field_name")), "value").alias("line"))
    text = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return results.unionByName(head).groupBy("report_id", "page_num").agg(text.alias("text")).withColumn("ocr_used", F.col("report_id") % 2 == 0)


@query(duck("rpt_fields") + "SELECT event_id, event_id % 29 <> 0 AS agrees FROM rpt_fields WHERE value IS NOT NULL")
def q_source_agreement(spark, sf):
    f = view(spark, sf, "rpt_fields").filter("value is not null").select("report_id", "page_num", "event_id", "field_name", "value")
    tokens = checked_pages(spark, sf).select("report_id", "page_num", X.page_tokens(F.col("text")).alias("tokens"))
    return f.join(tokens, ["report_id", "page_num"]).select("event_id", X.stands_in(F.col("value"), F.col("tokens"), F.col("field_name")).alias("agrees"))


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return P.validate(field_rows(spark, sf), "report_id", checked_pages(spark, sf), TODAY)


def _results_sql(fields: str) -> str:
    """CTEs from DECIDED on other fields: ages come from the dates that the report prints, values are checked on the page."""
    text = DECIDED.replace(duck("rpt_fields"), "").replace("FROM rpt_fields\n)", f"FROM {fields}\n)")
    text = text.replace("), flagged AS (", "), checked AS (\n  SELECT * EXCLUDE (state), state AS d_state, CASE WHEN event_id % 29 = 0 AND state <> 'MISSING' THEN 'SOURCE_MISMATCH' ELSE state END AS state FROM decided\n), flagged AS (")
    head, tail = text.split("), flagged AS (")
    tail = tail.replace("FROM decided", "FROM checked", 1).replace("('MISSING', 'INVALID_FORMAT')", "('MISSING', 'INVALID_FORMAT', 'SOURCE_MISMATCH')")
    return head + "), flagged AS (" + tail


_CTX = duck("rpt_fields", "rpt_docs", "rpt_header") + f""", docs AS (
  SELECT *, CASE WHEN o_orderkey % 6 = 2 AND day(collected) <= 12 THEN make_date(year(collected), day(collected), month(collected)) ELSE collected END AS taken,
    CASE WHEN report_id % 31 <> 0 THEN received END AS got FROM rpt_docs
), ctx AS (
  SELECT report_id, CASE WHEN a >= 0 THEN a END AS age FROM (
    SELECT report_id, year(taken) - year(dob) - CASE WHEN month(taken) * 100 + day(taken) < month(dob) * 100 + day(dob) THEN 1 ELSE 0 END AS a FROM docs)
), rpt_ctx AS (SELECT f.* EXCLUDE (age), c.age FROM rpt_fields f JOIN ctx c ON c.report_id = f.report_id)
"""
_HEADS = f""", valid AS (
  SELECT *, CASE WHEN dob <= DATE '{TODAY}' THEN dob END AS v_dob, CASE WHEN taken <= DATE '{TODAY}' THEN taken END AS v_taken, CASE WHEN got <= DATE '{TODAY}' THEN got END AS v_got FROM docs
), heads AS (
  SELECT d.report_id, m.field_name, CASE
      WHEN h.value IS NULL THEN 'MISSING'
      WHEN m.field_name = 'patient_name' AND d.report_id % 14 = 0 THEN 'POSSIBLE_MISREAD'
      WHEN m.field_name = 'received_date' AND d.report_id % 31 = 0 THEN 'INVALID_FORMAT'
      WHEN (m.field_name = 'date_of_birth' AND dob > DATE '{TODAY}') OR (m.field_name = 'collection_date' AND taken > DATE '{TODAY}') OR (m.field_name = 'received_date' AND got > DATE '{TODAY}') THEN 'IMPLAUSIBLE_VALUE'
      WHEN m.field_name = 'collection_date' AND v_taken < v_dob THEN 'INCONSISTENT_DATES'
      WHEN m.field_name = 'received_date' AND (v_got < v_taken OR v_got < v_dob) THEN 'INCONSISTENT_DATES'
      ELSE 'VALID' END AS state,
    CASE m.field_name WHEN 'patient_sex' THEN CASE d.report_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END WHEN 'date_of_birth' THEN CAST(dob AS VARCHAR) WHEN 'collection_date' THEN CAST(taken AS VARCHAR)
      WHEN 'received_date' THEN CAST(got AS VARCHAR) ELSE h.value END AS normalized_value,
    h.value IS NOT NULL AS present
  FROM valid d CROSS JOIN (SELECT unnest(['patient_name', 'patient_id', 'patient_sex', 'specimen_type', 'date_of_birth', 'collection_date', 'received_date']) AS field_name) m
  LEFT JOIN rpt_header h ON h.report_id = d.report_id AND h.field_name = m.field_name
), all_fields AS (
  SELECT report_id, field_name, state, CASE WHEN state = 'MISSING' THEN value WHEN raw IS NOT NULL THEN regexp_replace(normalized::DECIMAL(18,3)::VARCHAR, '\\.?0+$', '') END AS normalized_value, conf, category,
    CASE WHEN state = 'FLAG_MISMATCH' THEN 1 ELSE (d_state <> 'VALID')::INT + (state = 'SOURCE_MISMATCH')::INT END + (category = 'LOW')::INT AS n_messages FROM cat
  UNION ALL SELECT report_id, field_name, state, normalized_value, conf, category, (state <> 'VALID')::INT + (category = 'LOW')::INT FROM (
    SELECT *, CASE WHEN conf >= 0.9 THEN 'HIGH' WHEN conf >= 0.7 THEN 'REVIEW_RECOMMENDED' ELSE 'LOW' END AS category FROM (
      SELECT *, CASE WHEN NOT present THEN 0.0 WHEN state IN ('INVALID_FORMAT', 'IMPLAUSIBLE_VALUE') THEN 0.495 ELSE 0.99 END::DOUBLE AS conf FROM heads))
)
"""
VALIDATED = _CTX + _results_sql("rpt_ctx") + _HEADS


@query(VALIDATED + "SELECT report_id, field_name, state, normalized_value, conf, category, n_messages FROM all_fields")
def q_validate_fields(spark, sf):
    return validated(spark, sf).select("report_id", "field_name", "state", "normalized_value", "conf", "category", F.size("messages").alias("n_messages"))


_SHOWN = r"regexp_replace(normalized::DECIMAL(18,3)::VARCHAR, '\.?0+$', '')"
_CHECK = "check for a misread digit or decimal point"
_UNIT_OF = "CASE field_name WHEN 'glucose' THEN 'mg/dL' WHEN 'hemoglobin' THEN 'g/dL' WHEN 'hematocrit' THEN '%' ELSE 'x10^3/uL' END"
_WORD = "CASE {} WHEN 'H' THEN 'high' WHEN 'L' THEN 'low' ELSE 'normal' END"
_ENDS = "coalesce(lower::DOUBLE::VARCHAR, 'None') || ' - ' || coalesce(upper::DOUBLE::VARCHAR, 'None')"


@query(VALIDATED + f"""SELECT report_id, field_name, list_aggregate(list_filter([CASE WHEN state = 'FLAG_MISMATCH' THEN 'The report marks this result ' || {_WORD.format('abnormal_flag')} || ', but the value read (' || {_SHOWN} || ') is ' || {_WORD.format('direction')}
      || ' for its range (' || CASE WHEN basis = 'report' THEN trim(reference_range) ELSE 'adult range ' || {_ENDS} END || '); {_CHECK}' ELSE CASE d_state
    WHEN 'MISSING' THEN 'Required field missing' WHEN 'INVALID_FORMAT' THEN 'Invalid numeric format: ' || value
    WHEN 'UNRECOGNIZED_UNIT' THEN CASE WHEN unit IS NULL THEN 'No unit printed with the result; expected ' || {_UNIT_OF} ELSE 'Unrecognized unit ''' || unit || '''; expected ' || {_UNIT_OF} END
    WHEN 'NO_REFERENCE_RANGE' THEN 'Adult reference ranges do not apply (age ' || age || '); verify against the report''s own range'
    WHEN 'EXTREME_VALUE' THEN CASE WHEN normalized < p_lo OR normalized > p_hi THEN 'Value ' || {_SHOWN} || ' ' || {_UNIT_OF} || ' is outside any plausible result (' || p_lo::DOUBLE::VARCHAR || ' - ' || p_hi::DOUBLE::VARCHAR || '); {_CHECK}'
      ELSE 'Value ' || {_SHOWN} || ' is far outside the reference range (' || {_ENDS} || '); {_CHECK}' END
    WHEN 'OUTSIDE_REFERENCE_RANGE' THEN CASE WHEN direction IS NULL THEN 'Value ' || {_SHOWN} || ' ' || {_UNIT_OF} || ' is flagged ' || {_WORD.format('abnormal_flag')} || ' on the report'
      WHEN basis = 'report' THEN 'Value ' || {_SHOWN} || ' ' || {_UNIT_OF} || ' is outside the report''s reference range (' || trim(reference_range) || ')'
      ELSE 'Value ' || {_SHOWN} || ' is outside the adult reference range (' || {_ENDS} || ' ' || {_UNIT_OF} || ')' END END END,
  CASE WHEN state = 'SOURCE_MISMATCH' THEN 'Extracted value was not found in the document text' END, CASE WHEN category = 'LOW' THEN 'Low confidence extraction' END], lambda x: x IS NOT NULL), 'string_agg', ' | ') AS messages
FROM cat WHERE state <> 'VALID' OR category = 'LOW'""")
def q_field_messages(spark, sf):
    """What a reviewer reads about each result that isn't plainly valid."""
    rows = validated(spark, sf).filter(F.col("field_name").isin(schema.NUMERIC_FIELDS) & (F.size("messages") > 0))
    return rows.select("report_id", "field_name", F.array_join("messages", " | ").alias("messages"))


_CRITICAL = ", ".join(f"'{f}'" for f in schema.CRITICAL_FIELDS)


@query(VALIDATED + f"""SELECT report_id, round(avg(conf), 6) AS overall_confidence, CASE WHEN bool_and(state IN ('VALID', 'OUTSIDE_REFERENCE_RANGE') AND category <> 'LOW'
  AND (category = 'HIGH' OR field_name NOT IN ({_CRITICAL}))) AND avg(conf) >= 0.9 THEN 'AUTO_ACCEPTED' ELSE 'REVIEW_REQUIRED' END AS decision,
  coalesce(string_agg(field_name || ': ' || state, '; ' ORDER BY field_name) FILTER (state <> 'VALID'), '') AS summary FROM all_fields GROUP BY report_id""")
def q_decide_documents(spark, sf):
    return P.decide(validated(spark, sf), "report_id").select("report_id", "overall_confidence", "decision", F.array_join("summary", "; ").alias("summary"))


# Reviews ----------------------------------------------------------------------------------------------------------------

def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections of glucose: right, equal to what stands, implausible, blanked, or with a new unit only."""
    f = view(spark, sf, "rpt_fields").filter("field_name = 'glucose'")
    kind = F.col("report_id") % 8
    value = F.when(kind == 1, "95").when(kind == 3, "5000").when(kind == 5, "").otherwise(F.col("value"))
    unit = F.when(kind.isin(1, 3), "mg/dL").when(kind == 7, " mmol/L ")
    return f.select(F.concat_ws(":", "report_id", "field_name").alias("field_id"), F.lit(1).alias("seq"), value.alias("new_value"), unit.alias("new_unit"), F.when(kind != 4, "typo").alias("reason"))


_CHANGED = """, changed AS (SELECT * EXCLUDE (value, unit), value AS old_value, unit AS old_unit, field_name = 'glucose' AND (report_id % 8 IN (1, 3) AND (value IS DISTINCT FROM v OR unit IS DISTINCT FROM 'mg/dL')
    OR report_id % 8 = 5 OR report_id % 8 = 7 AND unit IS DISTINCT FROM 'mmol/L') AS corrected,
  CASE WHEN field_name = 'glucose' THEN CASE report_id % 8 WHEN 1 THEN '95' WHEN 3 THEN '5000' WHEN 5 THEN NULL ELSE value END ELSE value END AS value,
  CASE WHEN field_name = 'glucose' THEN CASE report_id % 8 WHEN 1 THEN 'mg/dL' WHEN 3 THEN 'mg/dL' WHEN 7 THEN 'mmol/L' ELSE unit END ELSE unit END AS unit
  FROM (SELECT *, CASE report_id % 8 WHEN 1 THEN '95' ELSE '5000' END AS v FROM rpt_ctx))
"""
_AGAIN = re.sub(r"\b(n1|n2|n3|n4|decided|checked|flagged|scored|cat)\b", r"\1_again", _results_sql("changed").split("), checked AS (")[0] + ")\n")
REVISED = VALIDATED + _CHANGED + _AGAIN + """, revised AS (
  SELECT a.report_id, a.field_name, c.state AS was, a.corrected, CASE WHEN NOT a.corrected AND a.state IN ('VALID', 'OUTSIDE_REFERENCE_RANGE') AND c.state IN ('SOURCE_MISMATCH', 'FLAG_MISMATCH') THEN c.state ELSE a.state END AS state
  FROM decided_again a JOIN cat c ON c.event_id = a.event_id
  UNION ALL SELECT report_id, field_name, state, false, state FROM heads
), kinds AS (
  SELECT *, CASE WHEN state IN ('MISSING', 'INVALID_FORMAT', 'IMPLAUSIBLE_VALUE') THEN 'blocking' WHEN state <> 'VALID' AND (corrected OR state <> was) THEN 'unseen' WHEN state <> 'VALID' THEN 'warning' END AS kind FROM revised
)
"""


def _revised(spark: SparkSession, sf: str) -> DataFrame:
    fields = S.stored(validated(spark, sf).withColumn("field_id", F.concat_ws(":", "report_id", "field_name")), T.folder(spark, "validated"))
    current = fields.select("field_id", F.col("value").alias("current_value"), F.col("unit").alias("current_unit"))
    real, _ = W.real_changes(_changes(spark, sf), current)
    return W.revalidate(fields.select("report_id", "field_id", "field_name", *P.FIELD, "state", "messages"), real, "report_id", TODAY)


@query(REVISED + "SELECT report_id, field_name, was, state, corrected, kind FROM kinds")
def q_revalidate(spark, sf):
    return _revised(spark, sf).withColumn("kind", W.issue_kind()).select("report_id", "field_name", "was", "state", "corrected", "kind")


@query(REVISED + """SELECT report_id, count(*) FILTER (kind = 'blocking') AS n_blocking, count(*) FILTER (kind = 'unseen') AS n_unseen, count(*) FILTER (kind IN ('unseen', 'warning')) AS n_warnings,
  CASE WHEN count(*) FILTER (kind = 'blocking') > 0 THEN 'UNRESOLVED_VALIDATION_ISSUES' WHEN count(*) FILTER (kind = 'unseen') > 0 AND report_id % 2 = 0 THEN 'UNCONFIRMED_WARNINGS' ELSE 'HUMAN_APPROVED' END AS outcome
FROM kinds GROUP BY report_id""")
def q_unseen_warnings(spark, sf):
    revised = S.stored(_revised(spark, sf), T.folder(spark, "revised"))
    confirmed = revised.filter("report_id % 2 = 1").select("report_id")
    return W.approvals(revised, "report_id", confirmed)


@query(duck("rpt_fields") + """, g AS (
  SELECT report_id, concat(report_id, ':glucose') AS field_id, value AS previous_value, CASE report_id % 8 WHEN 1 THEN '95' WHEN 3 THEN '5000' WHEN 5 THEN '' ELSE value END AS new_value, unit AS previous_unit,
    CASE WHEN report_id % 8 IN (1, 3) THEN 'mg/dL' WHEN report_id % 8 = 7 THEN 'mmol/L' END AS new_unit FROM rpt_fields WHERE field_name = 'glucose')
SELECT field_id, previous_value, new_value, CASE WHEN new_unit IS DISTINCT FROM previous_unit AND new_unit IS NOT NULL THEN previous_unit END AS previous_unit,
  CASE WHEN new_unit IS DISTINCT FROM previous_unit THEN new_unit END AS new_unit FROM g
WHERE new_value IS DISTINCT FROM previous_value OR (new_unit IS NOT NULL AND new_unit IS DISTINCT FROM previous_unit)""")
def q_real_changes(spark, sf):
    f = view(spark, sf, "rpt_fields").filter("field_name = 'glucose'")
    current = f.select(F.concat_ws(":", "report_id", "field_name").alias("field_id"), F.col("value").alias("current_value"), F.col("unit").alias("current_unit"))
    return W.real_changes(_changes(spark, sf), current)[0].select("field_id", "previous_value", "new_value", "previous_unit", "new_unit")


@query(duck("requests").replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY t, seq) AS n FROM requests), s AS (
  SELECT document_id, 0::BIGINT AS n, NULL::BIGINT AS seq, ''::VARCHAR AS outcome, NULL::BIGINT AS holder, 0::BIGINT AS touched, 'REVIEW_REQUIRED'::VARCHAR AS status FROM (SELECT DISTINCT document_id FROM requests)
  UNION ALL
  SELECT document_id, n, seq, o, CASE WHEN o IN ('claimed', 'taken over') THEN user_id WHEN o IN ('released', 'approved', 'rejected') OR (o = 'not reviewable' AND holder IS NOT NULL) THEN NULL ELSE holder END,
    CASE WHEN o IN ('claimed', 'taken over', 'renewed') THEN t ELSE touched END,
    CASE o WHEN 'claimed' THEN 'REVIEW_IN_PROGRESS' WHEN 'taken over' THEN 'REVIEW_IN_PROGRESS' WHEN 'released' THEN 'REVIEW_REQUIRED' WHEN 'approved' THEN 'HUMAN_APPROVED' WHEN 'rejected' THEN 'HUMAN_REJECTED' ELSE status END
  FROM (
    SELECT r.document_id, r.n, r.seq, r.t, r.user_id, s.holder, s.touched, s.status, CASE
      WHEN r.action = 'claim' THEN CASE WHEN s.holder = r.user_id THEN 'renewed' WHEN s.holder IS NOT NULL THEN CASE WHEN s.touched >= r.t - 3600 THEN 'conflict' ELSE 'taken over' END
        WHEN s.status <> 'REVIEW_REQUIRED' THEN 'not reviewable' ELSE 'claimed' END
      WHEN s.holder IS NULL OR (r.action = 'heartbeat' AND s.holder <> r.user_id) THEN 'no review' WHEN r.action = 'heartbeat' THEN 'renewed'
      WHEN s.holder <> r.user_id AND NOT r.admin THEN 'forbidden' WHEN r.action = 'reject' AND trim(coalesce(r.reason, '')) = '' THEN 'reason required'
      WHEN r.action = 'release' THEN 'released' WHEN r.action = 'approve' THEN 'approved' ELSE 'rejected' END AS o
    FROM s JOIN r ON r.document_id = s.document_id AND r.n = s.n + 1)
) SELECT document_id, seq, outcome, holder, status FROM s WHERE n > 0""")
def q_lease_state(spark, sf):
    return W.lease_log(view(spark, sf, "requests"))


# Jobs, purges, settings, accounts ---------------------------------------------------------------------------------------

_JOBS = duck("jobs")
AS_OF = "2024-01-31"


@query(_JOBS + f"""SELECT job_id, picked, CASE WHEN picked THEN 'RUNNING' ELSE status END AS status, CASE WHEN picked THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
FROM (SELECT *, status IN ('QUEUED', 'RETRYING') OR (status = 'RUNNING' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE) AS picked FROM jobs)""")
def q_job_pick_up(spark, sf):
    return M.pick_up(view(spark, sf, "jobs"), AS_OF).select("job_id", "picked", "status", "updated_at")


# Four events make a job: clicks and purchases are runs that deliver a result, the last event tells how the job stands.
_RUNS = """WITH e AS (SELECT event_id // 4 AS job_id, event_id AS attempt, event_type FROM events),
  j AS (SELECT job_id, arg_max(event_type, attempt) IN ('view', 'click') AS running, min(attempt) FILTER (event_type IN ('click', 'purchase')) AS attempt FROM e GROUP BY job_id)
SELECT job_id, attempt FROM j WHERE running AND attempt IS NOT NULL"""


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Results by job and attempt, and the jobs with their status."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.expr("event_id div 4").alias("job_id"), F.col("event_id").alias("attempt"), "event_type", F.unix_timestamp("ts").alias("t"))
    last = e.groupBy("job_id").agg(F.max_by("event_type", "attempt").alias("last"))
    return e.filter("event_type IN ('click', 'purchase')").select("job_id", "attempt", "t"), last.select("job_id", F.when(F.col("last").isin("view", "click"), "RUNNING").otherwise("SUCCEEDED").alias("status"))


@query(_RUNS)
def q_superseded_runs(spark, sf):
    runs, jobs = _runs(spark, sf)
    return M.kept_results(runs, jobs).select("job_id", "attempt")


@query(_RUNS)
def q_stream_kept_results(spark, sf):
    """The same where results come as a stream into a sink that holds each batch once."""
    runs, jobs = _runs(spark, sf)
    folder = T.folder(spark, "results")
    held = O.write_once(O.arrivals(runs, "t", "attempt", f"{folder}/in", LAG, 4), folder).filter("attempt IS NOT NULL")
    return M.kept_results(held, jobs).select("job_id", "attempt")


@query(duck("rpt_fields") + """, e AS (SELECT report_id, min(CASE WHEN value IS NULL THEN 'missing value' WHEN value = 'pending' THEN 'not a number' END) AS error FROM rpt_fields GROUP BY report_id)
SELECT f.report_id, field_name, CASE WHEN error IS NULL THEN value ELSE upper(value) END AS value, CASE WHEN error IS NULL THEN 'primary' ELSE 'rule_based' END AS extractor, error AS fallback_reason
FROM rpt_fields f JOIN e ON e.report_id = f.report_id""")
def q_fallback(spark, sf):
    f = view(spark, sf, "rpt_fields").select("report_id", "field_name", "value")
    wrong = f.groupBy("report_id").agg(F.min(F.when(F.col("value").isNull(), "missing value").when(F.col("value") == "pending", "not a number")).alias("error"))
    return M.with_fallback(f.join(wrong, "report_id"), f.withColumn("value", F.upper("value")), "report_id")


@query(_JOBS + """SELECT job_id, CASE WHEN recovery_count < 3 AND job_id % 4 <> 0 THEN 'RETRYING' ELSE 'FAILED' END AS next_status,
  CASE WHEN recovery_count < 3 AND job_id % 4 <> 0 THEN CAST(5 * power(2, recovery_count) AS BIGINT) END AS delay_seconds FROM jobs WHERE status = 'FAILED'""")
def q_permanent_errors(spark, sf):
    failed = view(spark, sf, "jobs").filter("status = 'FAILED'").select("job_id", F.col("recovery_count").alias("attempt"), F.when(F.col("job_id") % 4 == 0, "DocumentError").when(F.col("job_id") % 4 == 1, "Timeout").alias("error_type"))
    return M.retries(failed)


@query(duck("doc_catalog") + """SELECT r.doc_id, CASE WHEN d.status IS NULL THEN 'not found' WHEN d.status = 'FAILED' THEN 'queued' ELSE 'refused' END AS outcome,
  CASE WHEN d.status = 'FAILED' THEN 'UPLOADED' ELSE d.status END AS status FROM (SELECT doc_id * 3 AS doc_id FROM doc_catalog) r LEFT JOIN doc_catalog d ON d.doc_id = r.doc_id""")
def q_reprocess(spark, sf):
    docs = view(spark, sf, "doc_catalog")
    return M.reprocess(docs.select((F.col("doc_id") * 3).alias("doc_id")), docs)


@query(duck("doc_catalog") + """SELECT doc_id, first_id, doc_id = first_id OR doc_id % 2 = 0 AS accepted FROM (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content_hash ORDER BY created_at, doc_id) AS first_id FROM doc_catalog)""")
def q_accept_uploads(spark, sf):
    return M.accept_uploads(view(spark, sf, "doc_catalog").withColumn("allow_duplicate", F.col("doc_id") % 2 == 0))


def _world(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Tables of documents with extractions, fields and so on, numbered from the reports and events."""
    f = view(spark, sf, "rpt_fields")
    docs = f.select(F.col("report_id").alias("document_id")).distinct()
    return {
        "documents": docs, "extractions": docs.withColumn("extraction_id", F.col("document_id") * 10), "fields": f.select((F.col("report_id") * 10).alias("extraction_id"), F.col("event_id").alias("field_id")),
        "corrections": f.filter("event_id % 3 = 0").select(F.col("event_id").alias("field_id")), "reviews": docs.filter("document_id % 2 = 0"), "jobs": docs,
        "audit": f.select(
            F.col("event_id").alias("audit_id"), F.lit("SEEN").alias("action"), F.when(F.col("event_id") % 2 == 0, "document").otherwise("extracted_field").alias("resource_type"),
            F.when(F.col("event_id") % 2 == 0, F.col("report_id")).otherwise(F.col("event_id")).cast("string").alias("resource_id"), F.col("value").alias("before_state"), F.col("unit").alias("after_state")),
    }


@query(duck("rpt_fields") + """, d AS (SELECT DISTINCT report_id FROM rpt_fields)
SELECT * FROM (
  SELECT 'documents' AS name, count(*) AS n FROM d WHERE report_id % 6 <> 0 UNION ALL SELECT 'extractions', count(*) FROM d WHERE report_id % 6 <> 0 UNION ALL SELECT 'jobs', count(*) FROM d WHERE report_id % 6 <> 0
  UNION ALL SELECT 'reviews', count(*) FROM d WHERE report_id % 6 <> 0 AND report_id % 2 = 0 UNION ALL SELECT 'fields', count(*) FROM rpt_fields WHERE report_id % 6 <> 0
  UNION ALL SELECT 'corrections', count(*) FROM rpt_fields WHERE report_id % 6 <> 0 AND event_id % 3 = 0 UNION ALL SELECT 'audit', (SELECT count(*) FROM rpt_fields) + (SELECT count(*) FROM d WHERE report_id % 6 = 0)
  UNION ALL SELECT 'audit redacted', count(*) FROM rpt_fields WHERE report_id % 6 = 0 UNION ALL SELECT 'audit with content', count(*) FROM rpt_fields WHERE report_id % 6 <> 0 AND value IS NOT NULL)""")
def q_purge_cascade(spark, sf):
    world = _world(spark, sf)
    doomed = world["documents"].filter("document_id % 6 = 0").withColumn("reason", F.lit("old"))
    after = M.purge(world, doomed, AS_OF)
    after["audit redacted"] = after["audit"].filter("""after_state = '{"redacted":true}' AND before_state IS NULL""")
    after["audit with content"] = after["audit"].filter("before_state IS NOT NULL")
    out = None
    for name, df in after.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH c AS (SELECT event_type AS key, event_id AS seq, value / 100 AS value FROM events WHERE value / 100 BETWEEN 0 AND 1)
SELECT t.key, coalesce(c.value, 0.9) AS value FROM (SELECT DISTINCT event_type AS key FROM events UNION SELECT 'auto_accept') t
LEFT JOIN (SELECT key, arg_max(value, seq) AS value FROM c GROUP BY key) c ON c.key = t.key""")
def q_settings_upsert(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    changes = events.select(F.col("event_type").alias("key"), (F.col("value") / 100).alias("value"), F.col("event_id").alias("seq"))
    current = events.select(F.col("event_type").alias("key")).distinct().unionByName(spark.createDataFrame([("auto_accept",)], "key string")).withColumn("value", F.lit(0.9))
    return M.settings_after(current, changes)


_USERS = "SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'OPERATOR' WHEN 2 THEN 'REVIEWER' ELSE 'VIEWER' END AS role, c_custkey % 10 <> 0 AS active FROM customer"
_ACTS = "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey - c_custkey % 8 END AS actor_id, CASE WHEN c_custkey % 5 = 0 THEN 'VIEWER' ELSE 'ADMIN' END AS new_role, c_custkey % 7 <> 0 AS new_active FROM customer"


@query(f"""WITH u AS ({_USERS}), a AS ({_ACTS})
SELECT a.user_id, CASE WHEN NOT coalesce(u.role = 'ADMIN' AND u.active, false) THEN 'forbidden' WHEN a.user_id = a.actor_id AND (new_role <> 'ADMIN' OR NOT new_active) THEN 'refused' ELSE 'changed' END AS outcome
FROM a LEFT JOIN u ON u.user_id = a.actor_id""")
def q_keep_an_admin(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    return M.account_changes(spark.sql(_USERS.replace("FROM customer", "FROM {t}"), t=customers), spark.sql(_ACTS.replace("FROM customer", "FROM {t}"), t=customers))


@query(f"SELECT user_id, role, role IN ('ADMIN', 'OPERATOR') AS may_export, role IN ('ADMIN', 'REVIEWER') AS may_review, role = 'ADMIN' AS may_delete FROM ({_USERS})")
def q_role_matrix(spark, sf):
    users = spark.sql(_USERS.replace("FROM customer", "FROM {t}"), t=spark.read.parquet(f"{sf}/customer.parquet"))
    return users.select("user_id", "role", *[M.allowed(F.col("role"), a).alias(f"may_{a}") for a in ("export", "review", "delete")])


@query("""SELECT event_id AS audit_id, event_type AS action FROM events UNION ALL SELECT event_id + 1000000000, 'again' FROM events WHERE event_id % 10 = 0""")
def q_audit_append(spark, sf):
    log = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("audit_id"), F.col("event_type").alias("action"))
    more = log.filter("audit_id % 10 = 0").select((F.col("audit_id") + 1000000000).alias("audit_id"), F.lit("again").alias("action"))
    return M.append_audit(log, log.unionByName(more).unionByName(more))


# Exports, lists, evaluation ---------------------------------------------------------------------------------------------

def _export_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "rpt_docs").select(F.col("report_id").alias("document_id"))
    return docs.withColumns({"filename": F.concat(F.lit("=r"), "document_id", F.lit(".pdf")), "status": F.lit("AUTO_ACCEPTED"), "uploaded_at": F.lit("2024-01-01T00:00:00"), "extractor": F.lit("rule_based"), "overall_confidence": F.lit(95.0)})


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return R.export_items(validated(spark, sf).withColumnRenamed("report_id", "document_id").withColumn("is_corrected", F.col("document_id") % 9 == 0))


_UNIT_SQL = "CASE field_name WHEN 'glucose' THEN 'mg/dL' WHEN 'hemoglobin' THEN 'g/dL' WHEN 'hematocrit' THEN '%' WHEN 'white_blood_cell_count' THEN 'x10^3/uL' WHEN 'platelet_count' THEN 'x10^3/uL' END"
_ITEMS = VALIDATED + f""", items AS (
  SELECT a.report_id, a.field_name, coalesce(nullif(a.normalized_value, ''), p.value) AS value, {_UNIT_SQL.replace('field_name', 'a.field_name')} AS unit,
    CASE WHEN c.normalized > coalesce(c.upper, CASE WHEN c.lower IS NULL THEN c.p_hi END) THEN 'H' WHEN c.normalized < coalesce(c.lower, CASE WHEN c.upper IS NULL THEN c.p_lo END) THEN 'L' END AS flag,
    p.value AS printed_value, c.unit AS printed_unit, c.abnormal_flag AS printed_flag, c.reference_range, a.state AS validation_state, a.report_id % 9 = 0 AS corrected
  FROM all_fields a LEFT JOIN cat c ON c.report_id = a.report_id AND c.field_name = a.field_name
  LEFT JOIN (SELECT report_id, field_name, value FROM rpt_fields UNION ALL SELECT report_id, field_name, value FROM rpt_header) p ON p.report_id = a.report_id AND p.field_name = a.field_name
)
"""
_WIDE = ", ".join(
    f"max(CASE WHEN field_name = '{name}' THEN CASE WHEN left({col}, 1) IN ('=', '+', '@') OR (left({col}, 1) = '-' AND try_cast({col} AS DOUBLE) IS NULL) THEN '''' || {col} ELSE coalesce({col}, '') END ELSE '' END) AS {name}{suffix}"
    for name in R.EXPORT_FIELDS for col, suffix in (("value", ""), ("unit", "_unit"), ("flag", "_flag"), ("reference_range", "_reference_range"), ("validation_state", "_state"))
)


@query(_ITEMS + f"""SELECT CAST(report_id AS VARCHAR) AS document_id, '''=r' || report_id || '.pdf' AS filename, 'AUTO_ACCEPTED' AS status, '2024-01-01T00:00:00' AS uploaded_at, 'rule_based' AS extractor, '95.0' AS overall_confidence, {_WIDE}
FROM items GROUP BY report_id""")
def q_export_wide(spark, sf):
    return R.export_wide(_items(spark, sf), _export_docs(spark, sf))


@query(_ITEMS + """SELECT report_id, field_name, value, unit, flag, printed_value, printed_unit, printed_flag, reference_range, validation_state, corrected FROM items""")
def q_export_nested(spark, sf):
    nested = R.export_nested(_items(spark, sf))
    keys = "value string, unit string, flag string, printed_value string, printed_unit string, printed_flag string, reference_range string, validation_state string, corrected boolean"
    parsed = nested.select(F.col("document_id").alias("report_id"), F.explode(F.from_json("fields", f"map<string, struct<{keys.replace(' string', ':string').replace(' boolean', ':boolean')}>>")).alias("field_name", "item"))
    return parsed.select("report_id", "field_name", "item.*")


@query(VALIDATED + """, by_doc AS (
  SELECT report_id AS doc_id, max(CASE WHEN field_name = 'patient_name' THEN normalized_value END) AS patient_name, max(CASE WHEN field_name = 'patient_id' THEN normalized_value END) AS patient_id,
    bool_or(state IN ('EXTREME_VALUE', 'FLAG_MISMATCH', 'POSSIBLE_MISREAD')) AS needs_attention FROM all_fields GROUP BY report_id),
""" + duck("doc_catalog").removeprefix("WITH ") + """
SELECT d.doc_id, d.filename, patient_name, patient_id, coalesce(needs_attention, false) AS needs_attention, round(overall_confidence * 100, 1) AS overall_confidence
FROM doc_catalog d LEFT JOIN by_doc b ON b.doc_id = d.doc_id WHERE status IN ('REVIEW_REQUIRED', 'FAILED') AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-20 05:00:00'
  AND (contains(lower(filename), 'lopez') OR contains(lower(patient_name), 'lopez') OR contains(lower(patient_id), 'lopez') OR d.doc_id % 10 = 0 AND b.doc_id IS NOT NULL)""")
def q_list_documents(spark, sf):
    fields = validated(spark, sf).select(F.col("report_id").alias("doc_id"), F.concat_ws(":", "report_id", "field_name").alias("field_id"), "field_name", "value", F.col("value").alias("current_value"), "state")
    fields = S.stored(fields, T.folder(spark, "fields"))
    corrections = fields.filter("field_name = 'patient_name' AND doc_id % 10 = 0").select("field_id", F.lit("Ana LOPEZ").alias("new_value"))
    docs = view(spark, sf, "doc_catalog")
    # The last day ends at 05:00 UTC, where a reader five hours west has midnight.
    docs = docs.filter(F.col("created_at") < R.after_local_day("2024-01-19", "-05:00"))
    listed = R.list_documents(docs, fields, ["REVIEW_REQUIRED", "FAILED"], " Lopez ", since="2024-01-02", corrections=corrections)
    return listed.select("doc_id", "filename", "patient_name", "patient_id", "needs_attention", "overall_confidence")


@query(duck("doc_catalog") + "SELECT doc_id FROM doc_catalog WHERE status = 'REVIEW_REQUIRED' AND doc_id <> 3 ORDER BY attention DESC, created_at, doc_id LIMIT 1")
def q_next_target(spark, sf):
    return R.next_target(view(spark, sf, "doc_catalog").filter("status = 'REVIEW_REQUIRED'"), 3).select("doc_id")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{le}' AS le, count(*) FILTER (abs(value) <= {bound}) AS n FROM events" for le, bound in (("0.5", "0.5"), ("5.0", "5"), ("50.0", "50"), ("inf", "1e300"))) + ")")
def q_latency_histogram(spark, sf):
    return R.latency_histogram(spark.read.parquet(f"{sf}/events.parquet").select(F.abs("value").alias("seconds")), [0.5, 5.0, 50.0])


# What the printed reports should say, from the numbers that they were made of; misprints and missing results stay as they are.
_TRUTH = """, truth AS (
  SELECT event_id, event_id // 5 AS report_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 7 = 5 AND event_id % 59 <> 0 THEN (3 + c % 12) * 18.016 ELSE 40 + c % 161 END
    WHEN 1 THEN (80 + c % 121) / 10.0 WHEN 2 THEN (250 + c % 301) / 10.0 WHEN 3 THEN (20 + c % 141) / 10.0 ELSE 80 + c % 471 END::DOUBLE AS want
  FROM (SELECT event_id, round(abs(value) * 100)::BIGINT AS c FROM events))
"""
# The fields as extraction reads them off the pages: no unknown unit, the second page's glucose where the first has none.
_READ = """, x_fields AS (
  SELECT * REPLACE (CASE WHEN lost THEN CASE WHEN field_name = 'glucose' THEN '999' END ELSE value END AS value, CASE WHEN lost AND field_name = 'glucose' THEN 'mg/dL' WHEN unit = 'furlongs' OR lost THEN NULL ELSE unit END AS unit,
    CASE WHEN unit = 'furlongs' OR lost THEN NULL ELSE reference_range END AS reference_range, CASE WHEN (unit <> 'furlongs' OR unit IS NULL OR event_id % 4 = 0) AND NOT lost THEN abnormal_flag END AS abnormal_flag,
    CASE WHEN lost AND field_name <> 'glucose' THEN 0 ELSE 99 END AS confidence)
  FROM (SELECT *, value IS NULL OR value = 'pending' AS lost FROM rpt_fields)
), x_header AS (SELECT * FROM rpt_header WHERE value <> 'Unknown')"""
EVALUATED = VALIDATED.replace("), ctx AS (", ")" + _READ + ", ctx AS (", 1).replace("FROM rpt_fields f JOIN ctx c", "FROM x_fields f JOIN ctx c").replace(
    "event_id % 29 = 0 AND state <> 'MISSING'", "false").replace("d.report_id % 14 = 0", "false").replace("LEFT JOIN rpt_header h ON h.report_id = d.report_id AND h.field_name = m.field_name", "LEFT JOIN x_header h ON h.report_id = d.report_id AND h.field_name = m.field_name WHERE h.value IS NOT NULL OR m.field_name <> 'patient_sex'") + _TRUTH + """, outcomes AS (
  SELECT t.event_id, t.report_id, c.field_name, CASE WHEN c.raw IS NULL THEN 'missing' WHEN abs(round(c.normalized, 3)::DOUBLE - t.want) <= greatest(0.01 * abs(t.want), 0.051) THEN 'correct' ELSE 'wrong' END AS outcome
  FROM truth t JOIN cat c ON c.event_id = t.event_id), decisions AS (
  SELECT report_id, bool_and(state IN ('VALID', 'OUTSIDE_REFERENCE_RANGE') AND category <> 'LOW' AND (category = 'HIGH' OR field_name NOT IN (""" + _CRITICAL + """))) AND round(avg(conf), 6) >= 0.9 AS accepted FROM all_fields GROUP BY report_id
), judged AS (SELECT d.report_id, accepted, all_correct FROM decisions d JOIN (SELECT report_id, bool_and(outcome = 'correct') AS all_correct FROM outcomes GROUP BY report_id) o ON o.report_id = d.report_id)
"""


def _evaluated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the results and of the documents, by running the whole flow on the printed reports."""
    head = header_pages(spark, sf).select("report_id", "page_num", F.lit(0).alias("part"), "text")
    both = head.unionByName(result_pages(spark, sf).select("report_id", "page_num", F.lit(1).alias("part"), "text"))
    pages = both.groupBy("report_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x")).select("report_id", "page_num", F.array_join("x.text", "\n").alias("text"))
    fields, docs = P.run(pages, "report_id", today=TODAY, folder=T.folder(spark, "evaluated"))
    e, c = spark.read.parquet(f"{sf}/events.parquet"), F.round(F.abs("value") * 100).cast("long")
    which = F.col("event_id") % 5
    want = F.when(which == 0, F.when((F.col("event_id") % 7 == 5) & (F.col("event_id") % 59 != 0), (c % 12 + 3) * 18.016).otherwise(c % 161 + 40)).when(which == 1, (c % 121 + 80) / 10).when(
        which == 2, (c % 301 + 250) / 10).when(which == 3, (c % 141 + 20) / 10).otherwise(c % 471 + 80).cast("double")
    truth = e.select(F.expr("event_id div 5").alias("report_id"), F.element_at(F.array(*map(F.lit, PRINTED)), (which + 1).cast("int")).alias("field_name"), want.cast("string").alias("truth"))
    outcomes = R.case_outcomes(fields, truth, "report_id")
    right = outcomes.groupBy("report_id").agg(F.bool_and(F.col("outcome") == "correct").alias("all_correct"))
    return outcomes, docs.join(right, "report_id").select("report_id", (F.col("decision") == "AUTO_ACCEPTED").alias("accepted"), "all_correct")


@query(EVALUATED + "SELECT report_id, field_name, outcome FROM outcomes")
def q_case_outcomes(spark, sf):
    return _evaluated(spark, sf)[0].select("report_id", "field_name", "outcome")


@query(EVALUATED + """SELECT gate, round(value, 6) AS value, coalesce(value, 0) >= least AS passed FROM (
  SELECT 'fields' AS gate, count(*) FILTER (outcome = 'correct') / count(*) AS value, 0.97 AS least FROM outcomes
  UNION ALL SELECT 'precision', count(*) FILTER (accepted AND all_correct) / nullif(count(*) FILTER (accepted), 0), 1.0 FROM judged UNION ALL SELECT 'share', count(*) FILTER (accepted) / count(*), 0.5 FROM judged)""")
def q_gates(spark, sf):
    return R.gates(*_evaluated(spark, sf))


# Layout, guards, sources ------------------------------------------------------------------------------------------------

PAGE_WORDS = 40
_WORDS = duck("boxes") + f", words AS (SELECT *, vec_id // {PAGE_WORDS} AS sheet, y * 2 + h AS mid2 FROM boxes)"


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "boxes").withColumn("sheet", F.floor(F.col("vec_id") / PAGE_WORDS))


@query(_WORDS.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY mid2, vec_id) AS i FROM words), s AS (
  SELECT sheet, i, vec_id, x, mid2 AS anchor, h AS tall, 0 AS line FROM n WHERE i = 1
  UNION ALL SELECT n.sheet, n.i, n.vec_id, n.x, CASE WHEN n.mid2 - s.anchor <= greatest(s.tall, n.h) THEN s.anchor ELSE n.mid2 END, CASE WHEN n.mid2 - s.anchor <= greatest(s.tall, n.h) THEN s.tall ELSE n.h END,
    CASE WHEN n.mid2 - s.anchor <= greatest(s.tall, n.h) THEN s.line ELSE s.line + 1 END FROM s JOIN n ON n.sheet = s.sheet AND n.i = s.i + 1
) SELECT sheet, vec_id, line, CAST(row_number() OVER (PARTITION BY sheet, line ORDER BY x, vec_id) - 1 AS INT) AS place FROM s""")
def q_reading_order(spark, sf):
    word = F.struct(F.col("vec_id").cast("string").alias("text"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    sheets = _sheets(spark, sf).groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", word.alias("w")))), lambda p: p["w"]).alias("words"))
    rows = sheets.select("sheet", F.posexplode(L.visual_rows(F.col("words"))).alias("line", "r"))
    return rows.select("sheet", "line", F.posexplode("r.words").alias("place", "w")).select("sheet", F.col("w.text").cast("long").alias("vec_id"), "line", "place")


@query(_WORDS + """, o AS (SELECT *, vec_id % 3 AS region, vec_id % 4 AS line FROM words WHERE vec_id % 2 = 0), n AS (SELECT *, vec_id % 6 AS line FROM words WHERE vec_id % 10 = 1),
kept AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.sheet = o.sheet AND o.x * 2 + o.w BETWEEN n.x * 2 AND (n.x + n.w) * 2 AND o.y * 2 + o.h BETWEEN n.y * 2 AND (n.y + n.h) * 2)),
l AS (SELECT sheet, region, max(line) + 1 AS k FROM o GROUP BY ALL), b AS (SELECT sheet, region, sum(k) OVER (PARTITION BY sheet ORDER BY region) - k AS before FROM l), m AS (SELECT sheet, max(line) AS last FROM n GROUP BY sheet)
SELECT k.vec_id, CAST(coalesce(m.last, -1) + 1 + b.before + k.line AS BIGINT) AS line, 'MIXED' AS source_type FROM kept k JOIN b ON b.sheet = k.sheet AND b.region = k.region LEFT JOIN m ON m.sheet = k.sheet
UNION ALL SELECT vec_id, line, CASE WHEN sheet IN (SELECT sheet FROM kept) THEN 'MIXED' ELSE 'PDF_NATIVE' END FROM n""")
def q_mixed_page_merge(spark, sf):
    b = _sheets(spark, sf)
    scanned = b.filter("vec_id % 2 = 0").withColumns({"region": F.col("vec_id") % 3, "line": F.col("vec_id") % 4})
    return L.merge_pages(scanned, b.filter("vec_id % 10 = 1").withColumn("line", F.col("vec_id") % 6), ["sheet"]).select("vec_id", "line", "source_type")


@query(_WORDS + """, big AS (SELECT * FROM words WHERE w > 0 AND h > 0 AND w * h >= 5000)
SELECT vec_id FROM big b WHERE NOT EXISTS (SELECT 1 FROM big a WHERE a.sheet = b.sheet AND a.vec_id < b.vec_id AND a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h)""")
def q_embedded_regions(spark, sf):
    return L.embedded_regions(_sheets(spark, sf).withColumn("seq", F.col("vec_id")), ["sheet"], F.lit(100_000)).select("vec_id")


@query(duck("boxes") + """SELECT vec_id, least(2 * x - y, 2 * (x + w) - y, 2 * x - (y + h), 2 * (x + w) - (y + h)) + 3.0::DOUBLE AS left_edge, least(x + y, x + w + y, x + y + h, x + w + y + h) * 0.5::DOUBLE - 1 AS top,
  (2 * w + h)::DOUBLE AS width, (w + h) * 0.5::DOUBLE AS height, greatest(0, least(1, (x - 500) / 100.0))::DOUBLE AS clamped, x <= 1000 AND w <= 500 AS valid FROM boxes""")
def q_box_geometry(spark, sf):
    b = view(spark, sf, "boxes")
    box = L.box_to_original(F.array(*[F.col(c).cast("double") for c in "xywh"]), [2.0, -1.0, 3.0, 0.5, 0.5, -1.0])
    valid = L.box_valid(F.array((F.col("x") / 1000).cast("double"), (F.col("w") / 500).cast("double"), F.lit(0.0), F.lit(1.0)))
    return b.select("vec_id", *[box[i].alias(n) for i, n in enumerate(("left_edge", "top", "width", "height"))], L.clamp_box(F.array((F.col("x") - 500) / 100.0))[0].alias("clamped"), valid.alias("valid"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' END AS kind, length(trim(html)) > 20 AS is_native FROM pages""")
def q_mime_and_route(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    magic = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("255044462D312E37", "89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "3C21444F")]), (F.col("page_id") % 5 + 1).cast("int"))
    content = F.concat(magic, F.encode("html", "UTF-8"))
    return pages.select("page_id", S.sniff(content).alias("kind"), (S.page_source(F.col("html")) == "PDF_NATIVE").alias("is_native"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) AS plain,
  CASE WHEN doc_id % 3 <> 0 THEN substr(md5(doc_id::VARCHAR), 1, 8) || '-1234-5678-9abc-' || substr(md5(doc_id::VARCHAR), 1, 12) END AS correlation_id,
  'scan_' || doc_id || '.pdf' AS name, CASE doc_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex, doc_id % 5 IN (0, 4) AS password_good FROM documents""")
def q_text_guards(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    digest, n = F.md5(F.col("doc_id").cast("string")), F.col("doc_id")
    cid = F.concat(F.substring(digest, 1, 8), F.lit("-1234-5678-9abc-"), F.substring(digest, 1, 12), F.when(n % 3 == 0, "0").otherwise(""))
    path = F.concat(F.when(n % 2 == 0, "C:\\uploads\\").otherwise("/tmp/up/"), F.lit("scan_"), n, F.lit(".pdf"))
    sex = F.element_at(F.array(*map(F.lit, [" Man ", "FEMALE", "unknown", "?"])), (n % 4 + 1).cast("int"))
    password = F.element_at(F.array(*map(F.lit, ["Blue-kettle-2024", "short1A-", "alllowercaseletters", "Has-Operator-2024x", "4 small WORDS here"])), (n % 5 + 1).cast("int"))
    return d.select("doc_id", X.normalize_text(F.col("text")).alias("plain"), X.uuid_or_null(cid).alias("correlation_id"), X.basename(path).alias("name"),
                    X.normalize_sex(sex).alias("sex"), X.password_ok(password, F.lit("operator")).alias("password_good"))


@query("""SELECT event_id, CASE WHEN value / 100 <= 0 OR value / 100 > (event_id % 13) / 10 OR (event_id % 13) / 10 > 1 THEN 'Require 0 < low_confidence <= review_recommended <= 1'
  WHEN (event_id % 17) / 10 < 0.5 OR (event_id % 17) / 10 > 1 THEN 'auto_accept must be between 0.5 and 1.0' END AS problem FROM events""")
def q_thresholds(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", N.thresholds_problem(F.col("event_id") % 17 / 10, F.col("event_id") % 13 / 10, F.col("value") / 100).alias("problem"))


@query(f"""SELECT user_id, role FROM ({_USERS}) WHERE active ORDER BY CASE role WHEN 'ADMIN' THEN 1 WHEN 'OPERATOR' THEN 2 WHEN 'REVIEWER' THEN 3 ELSE 4 END, user_id""")
def q_users_by_role(spark, sf):
    users = spark.sql(_USERS.replace("FROM customer", "FROM {t}"), t=spark.read.parquet(f"{sf}/customer.parquet")).withColumn("name", F.lpad(F.col("user_id").cast("string"), 12, "0"))
    return R.by_role(users, ["ADMIN", "OPERATOR", "REVIEWER", "VIEWER"]).select("user_id", "role")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 600 MINUTE")
def q_recent_events(spark, sf):
    return R.recent(spark.read.parquet(f"{sf}/events.parquet"), "2024-01-15", 600).select("event_id")


# Streams out of order ---------------------------------------------------------------------------------------------------


_ENDED = "(SELECT max(t) FROM requests) + 366 * 86400"


def _stored(stream: DataFrame, folder: str) -> DataFrame:
    with O.rocks_state(stream.sparkSession, stream.sparkSession.sparkContext.defaultParallelism):
        return O.write_once(stream, folder)


@query(SQL["q_lease_state"].removesuffix("SELECT document_id, seq, outcome, holder, status FROM s WHERE n > 0").replace(
    "SELECT document_id, 0::BIGINT AS n,", "SELECT document_id, 0::BIGINT AS t, 0::BIGINT AS n,").replace("SELECT document_id, n, seq, o,", "SELECT document_id, t, n, seq, o,") + """
SELECT document_id, seq, outcome, holder, status FROM s WHERE n > 0
UNION ALL SELECT document_id, NULL, 'expired', holder, 'REVIEW_IN_PROGRESS' FROM (
  SELECT document_id, holder, touched, max(coalesce(later, """ + _ENDED + """)) AS until FROM (SELECT *, lead(t) OVER (PARTITION BY document_id ORDER BY n) AS later FROM s WHERE n > 0)
  WHERE holder IS NOT NULL GROUP BY document_id, holder, touched) WHERE until > touched + 3600""")
def q_stream_leases(spark, sf):
    folder = T.folder(spark, "leases")
    # No event at the epoch itself: it would count as late from the beginning.
    requests = O.arrivals(view(spark, sf, "requests").withColumn("t", F.col("t") + 86400), "t", "seq", f"{folder}/in", LAG, 5)
    return _stored(O.lease_stream(requests, f"{LAG} seconds"), folder).filter("document_id IS NOT NULL")


@query(SQL["q_rate_limit"])
def q_stream_rate_limit(spark, sf):
    folder = T.folder(spark, "limits")
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.unix_timestamp("ts").alias("t"), "event_id")
    stream = O.allowed_stream(O.arrivals(events, "t", "event_id", f"{folder}/in", LAG, 5), ["user_id"], "event_id", 86400, 2, False, f"{LAG} seconds")
    return _stored(stream, folder).filter("event_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if("allowed").alias("n_allowed"))


@query(SQL["q_lockout"])
def q_stream_lockout(spark, sf):
    folder = T.folder(spark, "lockouts")
    tries = spark.read.parquet(f"{sf}/events.parquet").filter("event_type IN ('error', 'signup')").select("user_id", F.unix_timestamp("ts").alias("t"), "event_id", (F.col("event_type") == "error").alias("bad"))
    stream = O.lockout_stream(O.arrivals(tries, "t", "event_id", f"{folder}/in", LAG, 5), f"{LAG} seconds", 3, 86400)
    return _stored(stream, folder).filter("event_id IS NOT NULL").groupBy("user_id").agg(F.count_if(F.col("outcome") == "locked").alias("n_locks"), F.count_if(F.col("outcome") == "refused").alias("n_refused"))


# Stored tables, the search index, the document driver ---------------------------------------------------------------------

@query("""WITH n AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 2 = 1) AS odd, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 2 = 0) AS even FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, coalesce(odd, even, c_acctbal)::DOUBLE AS balance FROM customer LEFT JOIN n ON o_custkey = c_custkey WHERE c_custkey % 11 <> 0""")
def q_store_upsert(spark, sf):
    """Two upserts and a deletion, each a version of its own."""
    customers, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    own = customers.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("balance"))
    store = ST.Store(spark, T.folder(spark, "accounts"))
    store.create(own, ["c_custkey"], 8)
    for rest in (0, 1):
        last = orders.filter(F.col("o_orderkey") % 2 == rest).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", "o_orderkey").cast("double").alias("balance"))
        store.upsert(last.join(customers.select("c_custkey", "c_name"), "c_custkey").select(own.columns))
    store.delete(own.filter("c_custkey % 11 = 0"))
    return store.read()


@query("""SELECT l_orderkey, l_linenumber::INT AS l_linenumber, l_quantity::DOUBLE AS quantity FROM lineitem WHERE l_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 0, o_totalprice::DOUBLE FROM orders WHERE o_orderkey % 7 = 0""")
def q_store_replace(spark, sf):
    """The rows of some orders make way for one row each, as a second run of a job replaces what the first one left."""
    lines, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders"))
    store = ST.Store(spark, T.folder(spark, "lines"))
    store.create(lines.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("quantity")), ["l_orderkey"], 8)
    again = orders.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").cast("double").alias("quantity"))
    store.replace(again, ["l_orderkey"])
    return store.read()


@query(duck("doc_catalog", "corrections") + """, t AS (
  SELECT doc_id, filename AS text FROM doc_catalog WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, new_value FROM corrections JOIN doc_catalog ON doc_id = field_id WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 'Moved_' || filename FROM doc_catalog WHERE doc_id % 5 = 0)
SELECT DISTINCT doc_id, term FROM t, (SELECT unnest(['src3_', 'the', 'moved_', '%', '1_']) AS term) WHERE contains(lower(text), term)""")
def q_search_index(spark, sf):
    """File names and corrections are indexed; a second batch renames every fifth document and drops its corrections."""
    docs = view(spark, sf, "doc_catalog").select(F.col("doc_id").alias("id"), F.col("filename").alias("text"))
    more = view(spark, sf, "corrections").select(F.col("field_id").alias("id"), F.col("new_value").alias("text")).join(docs.select("id"), "id", "left_semi")
    index = IX.SearchIndex(spark, T.folder(spark, "index"))
    index.add(docs.unionByName(more), 1)
    index.add(docs.filter("id % 5 = 0").withColumn("text", F.concat(F.lit("Moved_"), "text")), 2)
    found = [index.search(term).select(F.col("id").alias("doc_id"), F.lit(term.lower()).alias("term")) for term in ("SRC3_", "the", "Moved_", "%", "1_")]
    return functools.reduce(DataFrame.unionByName, found)


_UPLOADS = r"""SELECT page_id, page_id % 4 + 1 AS k, page_id % 7 = 0 AS locked, page_id % 5 < 3 AS pdf, page_id % 5 = 3 AS png, replace(coalesce(html, ''), chr(12), ' ') AS h FROM pages"""


@query(f"""WITH u AS ({_UPLOADS}), n AS (SELECT *, length(regexp_replace(h, '^\\s+|\\s+$', '', 'g')) > 20 AS native FROM u)
SELECT page_id::VARCHAR AS document_id, i::INT AS page_num, CASE WHEN native AND pdf THEN 'PDF_NATIVE' ELSE 'OCR' END AS source, CASE WHEN native AND pdf THEN length(h) END AS n_chars, NULL::VARCHAR AS error_type, NULL::VARCHAR AS error, NULL::VARCHAR AS step
FROM n, (SELECT unnest([1, 2, 3]) AS i) WHERE (pdf AND NOT locked AND k <= 3 AND i <= k) OR (png AND i = 1)
UNION ALL SELECT page_id::VARCHAR, NULL, NULL, NULL, CASE WHEN NOT pdf THEN 'UnsupportedType' WHEN locked THEN 'PasswordProtected' ELSE 'TooManyPages' END,
  CASE WHEN NOT pdf THEN 'Unsupported mime_type' WHEN locked THEN 'PDF is password protected' ELSE 'PDF has 4 pages; the maximum is 3' END, CASE WHEN NOT pdf THEN 'sniff' WHEN locked THEN 'open' ELSE 'count' END
FROM n WHERE NOT png AND (NOT pdf OR locked OR k > 3)""")
def q_document_driver(spark, sf):
    """Pages and quarantine rows of uploads made from the pages table: PDFs of one to four pages, some locked, images and others."""
    p, n = spark.read.parquet(f"{sf}/pages.parquet"), F.col("page_id")
    html = F.replace(F.coalesce("html", F.lit("")), F.lit("\f"), F.lit(" "))
    head = F.when(n % 5 < 3, F.concat(F.lit("%PDF-1.7"), F.when(n % 7 == 0, " /Encrypt").otherwise(""), F.lit("\n")))
    pdf = F.encode(F.concat(head, F.array_join(F.array_repeat(html, (n % 4 + 1).cast("int")), "\f")), "UTF-8")
    content = F.when(n % 5 < 3, pdf).when(n % 5 == 3, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.encode(html, "UTF-8"))
    rows = DR.analyze(p.select(n.alias("document_id"), content.alias("content")), 3)
    return rows.select("document_id", "page_num", "source", F.length("text").cast("long").alias("n_chars"), "error_type", "error", "step")


@query(duck("doc_catalog") + """, s AS (SELECT unnest(['""" + "', '".join(schema.DOCUMENT_STATUSES) + """']) AS status), c AS (SELECT overall_confidence AS x FROM doc_catalog WHERE overall_confidence IS NOT NULL)
SELECT '# TYPE documents gauge' AS line UNION ALL SELECT 'documents{status="' || s.status || '"} ' || (count(d.doc_id))::DOUBLE FROM s LEFT JOIN doc_catalog d ON d.status = s.status GROUP BY s.status
UNION ALL SELECT '# TYPE confidence histogram' UNION ALL SELECT 'confidence_bucket{le="0.5"} ' || (count(*) FILTER (x <= 0.5))::DOUBLE FROM c UNION ALL SELECT 'confidence_bucket{le="0.9"} ' || (count(*) FILTER (x <= 0.9))::DOUBLE FROM c
UNION ALL SELECT 'confidence_bucket{le="+Inf"} ' || count(*)::DOUBLE FROM c UNION ALL SELECT 'confidence_count ' || count(*)::DOUBLE FROM c""")
def q_metrics_text(spark, sf):
    """Counted while the catalogue is written; the sum, whose last digits depend on the order, is left out."""
    wanted = MX.Metrics().gauge("documents", "status", schema.DOCUMENT_STATUSES, "status").histogram("confidence", "overall_confidence", [0.5, 0.9])
    text = wanted.write(view(spark, sf, "doc_catalog"), T.folder(spark, "catalogue"))
    return spark.createDataFrame([(x,) for x in text.splitlines() if "_sum" not in x], "line string")


# Extractors, the report ---------------------------------------------------------------------------------------------------

_KIND = "report_id % 13"


@query(duck("rpt_fields") + f"""SELECT report_id, field_name, value, CASE WHEN {_KIND} IN (0, 1, 2, 3) THEN 'rule_based' ELSE 'primary' END AS extractor,
  CASE {_KIND} WHEN 0 THEN 'PermanentProviderError' WHEN 1 THEN 'RetryableProviderError' WHEN 2 THEN 'SchemaError' WHEN 3 THEN 'SchemaError' END AS fallback_reason
FROM (SELECT * REPLACE (CASE WHEN {_KIND} IN (0, 1, 2, 3) AND field_name = 'glucose' AND (value IS NULL OR value = 'pending') THEN '999' ELSE value END AS value) FROM rpt_fields)
WHERE value IS NOT NULL AND (value <> 'pending' OR {_KIND} > 3)""")
def q_extractors(spark, sf):
    """Answers of a provider made from the reports, some refused, failed or out of the schema; the rules stand in for these."""
    f = view(spark, sf, "rpt_fields")
    own = F.struct(F.when(F.col("report_id") % 13 == 3, "cholesterol").otherwise(F.col("field_name")).alias("field_name"), "value", "unit", F.col("confidence").cast("double").alias("confidence"), "page_num")
    texts = f.filter("value IS NOT NULL").groupBy("report_id").agg(F.to_json(F.collect_list(own)).alias("answer"))
    kind = F.col("report_id") % 13
    answer = F.when(kind == 2, '{"fields": []}').otherwise(F.col("answer"))
    answered = texts.select("report_id", F.when(kind == 0, 403).when(kind == 1, 503).otherwise(200).alias("status"), answer.alias("answer"))
    rows = PR.extract(result_pages(spark, sf), "report_id", lambda pages, by: PR.checked(answered, by))
    return rows.filter("field_name IS NOT NULL").select("report_id", "field_name", "value", "extractor", "fallback_reason")


@query(duck("eval_rows") + """, d AS (SELECT *, outcome = 'correct' AS ok FROM eval_rows), p AS (SELECT 1 AS n, 'Documents: ' || count(*) AS line FROM d
  UNION ALL SELECT 2, 'Field accuracy: ' || format('{:.1f}%', round(avg(ok::INT) * 100, 1)) FROM d UNION ALL SELECT 3, 'Documents fully correct: ' || format('{:.1f}%', round(avg(ok::INT) * 100, 1)) FROM d
  UNION ALL SELECT 4, 'Auto-accepted: ' || format('{:.1f}%', round(avg(accepted::INT) * 100, 1)) || ' of documents, of which fully correct: ' || format('{:.1f}%', round(avg(ok::INT) FILTER (accepted) * 100, 1)) FROM d
  UNION ALL SELECT 5, '| ' || source || ' | ' || format('{:.0f}%', round(avg(ok::INT) * 100, 0)) || ' | ' || count(*) FILTER (outcome = 'wrong') || ' | ' || count(*) FILTER (outcome = 'missing') || ' |' FROM d GROUP BY source
  UNION ALL SELECT 6, 'By lang: ' || lang || ' ' || format('{:.1f}%', round(avg(ok::INT) * 100, 1)) FROM d GROUP BY lang)
SELECT n, line FROM p""")
def q_eval_report(spark, sf):
    d = view(spark, sf, "eval_rows").withColumn("field_name", F.col("source"))
    return R.report_lines(d, d.select("accepted", (F.col("outcome") == "correct").alias("all_correct")), ["lang"])


# A kept summary -----------------------------------------------------------------------------------------------------------

@query(duck("rpt_header") + """SELECT report_id AS doc_id, max(CASE WHEN field_name = 'patient_name' THEN CASE WHEN report_id % 7 = 0 THEN upper(value) WHEN report_id % 10 = 0 THEN 'Ana LOPEZ' ELSE value END END) AS patient_name,
  max(CASE WHEN field_name = 'patient_id' THEN CASE WHEN report_id % 7 = 0 THEN upper(value) ELSE value END END) AS patient_id, count(*) AS n_fields, report_id % 14 = 0 AS needs_attention FROM rpt_header GROUP BY report_id""")
def q_kept_summary(spark, sf):
    """A batch of extractions, one of corrections, and a second extraction of every seventh document."""
    state = F.when((F.col("field_name") == "patient_name") & (F.col("report_id") % 14 == 0), "POSSIBLE_MISREAD").otherwise("VALID")
    h = view(spark, sf, "rpt_header").select(F.col("report_id").alias("doc_id"), F.concat_ws(":", "report_id", "field_name").alias("field_id"), "field_name", "value", state.alias("state"))
    h = S.stored(h, T.folder(spark, "extracted"))
    kept = SU.KeptSummary(spark, T.folder(spark, "summary"), 4)
    kept.extracted(h)
    names = h.filter("doc_id % 10 = 0 AND field_name = 'patient_name'")
    kept.corrected(names.select("doc_id", "field_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "state").withColumn("new_value", F.when(F.col("seq") == 2, "Ana LOPEZ").otherwise("first try")))
    kept.extracted(h.filter("doc_id % 7 = 0").withColumn("value", F.upper("value")))
    return kept.read()
