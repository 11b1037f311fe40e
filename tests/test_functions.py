"""Golden vectors of the normalizers, the decision order and the extraction grammar."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from labframe.functions import dates as D
from labframe.functions import numbers as N
from labframe.functions import text as X
from labframe.operators import extract as E
from labframe.operators import layout as L
from labframe.operators import relational as R
from labframe.operators import validate as V


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "want"), [
    ("5.0", 5.0), ("250,000", 250000.0), ("14,8", 14.8), ("0,361", 361.0), ("0,36", 0.36), ("5,123", 5123.0), ("-3.5 low", -3.5), ("none", None), (None, None),
])
def test_numbers(spark, text, want):
    got = one(spark, text, N.parse_number)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize(("text", "want"), [
    ("70 - 100", (70, 100)), ("(4.5 to 11.0)", (4.5, 11)), ("150,000-450,000", (150000, 450000)), ("<200", (None, 200)), (">= 60", (60, None)),
    ("see note", None), ("100 - 70", None),
])
def test_printed_ranges(spark, text, want):
    got = one(spark, text, N.printed_range)
    assert (None if got is None else tuple(None if x is None else float(x) for x in got)) == want


@pytest.mark.parametrize(("text", "order", "want"), [
    ("04/12/1998", "MDY", "1998-04-12"), ("25/12/1998", "MDY", "1998-12-25"), ("05/04/2026", "DMY", "2026-04-05"), ("14-Mar-1985", "MDY", "1985-03-14"),
    ("1985/3/14", "MDY", "1985-03-14"), ("31.12.1999", "MDY", "1999-12-31"), ("2024-02-30", "MDY", None), ("Sept 3, 2020", "MDY", None), ("12/12/98", "MDY", None),
])
def test_dates(spark, text, order, want):
    got = one(spark, text, lambda c: D.parse_date(c, F.lit(order)))
    assert (None if got is None else got.isoformat()) == want


def test_age_counts_whole_years(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29), dt.date(2018, 2, 28)), (dt.date(2010, 1, 1), dt.date(2009, 1, 1))], "b date, r date")
    assert [r[0] for r in df.select(D.age_in_years(F.col("b"), F.col("r"))).collect()] == [17, None]


DECISIONS = [
    ("glucose", "5.0", "mmol/L", None, None, None, None, "VALID", 90.08), ("hemoglobin", "145", "g/L", None, None, "M", 40, "VALID", 14.5),
    ("hemoglobin", "145", "g/dL", None, None, None, None, "EXTREME_VALUE", 145), ("platelet_count", "250,000", None, None, None, None, None, "VALID", 250),
    ("platelet_count", "90,000", None, None, None, None, None, "OUTSIDE_REFERENCE_RANGE", 90), ("glucose", "90", "furlongs", None, None, None, None, "UNRECOGNIZED_UNIT", 90),
    ("glucose", "90", None, None, None, None, None, "UNRECOGNIZED_UNIT", 90), ("glucose", "6.1", "mmol/L", "3.9 - 5.5", None, None, None, "OUTSIDE_REFERENCE_RANGE", 109.8976),
    ("hematocrit", "42", "%", None, None, None, 7, "NO_REFERENCE_RANGE", 42), ("hematocrit", "42", "%", "35 - 45", None, None, 7, "VALID", 42),
    ("glucose", "pending", "mg/dL", None, None, None, None, "INVALID_FORMAT", None), ("glucose", None, "mg/dL", None, None, None, None, "MISSING", None),
    ("glucose", "90", "mg/dL", None, "H", None, None, "OUTSIDE_REFERENCE_RANGE", 90), ("glucose", "90", "mg/dL", None, "?", None, None, "VALID", 90),
]


def test_decision_order(spark):
    cols = "i int, field_name string, value string, unit string, reference_range string, abnormal_flag string, sex string, age int"
    df = V.decide_numbers(spark.createDataFrame([(i, *d[:7]) for i, d in enumerate(DECISIONS)], cols))
    got = {r["i"]: (r["state"], None if r["normalized"] is None else float(r["normalized"])) for r in df.collect()}
    assert got == {i: (d[7], None if d[8] is None else float(d[8])) for i, d in enumerate(DECISIONS)}


def test_flag_mismatch_needs_a_printed_flag(spark):
    cols = "report_id int, field_name string, value string, unit string, reference_range string, abnormal_flag string, sex string, age int"
    rows = [(1, "white_blood_cell_count", "13.0", "K/uL", "4.5 - 11.0", None, None, None), (1, "glucose", "110", "mg/dL", "70 - 100", "H", None, None),
            (2, "white_blood_cell_count", "13.0", "K/uL", "4.5 - 11.0", None, None, None), (3, "glucose", "150", "mg/dL", None, "L", None, None)]
    df = V.flag_mismatch(V.decide_numbers(spark.createDataFrame(rows, cols)))
    got = {(r["report_id"], r["field_name"]): r["state"] for r in df.collect()}
    assert got == {(1, "white_blood_cell_count"): "FLAG_MISMATCH", (1, "glucose"): "OUTSIDE_REFERENCE_RANGE",
                   (2, "white_blood_cell_count"): "OUTSIDE_REFERENCE_RANGE", (3, "glucose"): "FLAG_MISMATCH"}


@pytest.mark.parametrize(("value", "page", "field", "want"), [
    ("92", "Glucose 92 mg/dL", "glucose", True), ("92", "Glucose 92mg/dL", "glucose", True), ("90", "Glucose 1990", "glucose", False),
    ("92", "Hgb 92", "glucose", False), ("250,000", "platelets 250000", "platelet_count", True), ("O'Brien", "patient OBRIEN", None, True),
    ("1.45", "Hgb 14.5", "hemoglobin", True), ("", "anything", None, True), ("x", None, None, False),
])
def test_source_agreement(spark, value, page, field, want):
    df = spark.createDataFrame([(value, page, field)], "v string, p string, f string")
    assert df.select(X.printed_on_page(F.col("v"), F.col("p"), F.col("f"))).first()[0] is want


@pytest.mark.parametrize(("name", "want"), [("Neil lyer", True), ("J0hn Doe", True), ("Neil Iyer", False), ("maria lopez", False), (None, False)])
def test_names(spark, name, want):
    assert one(spark, name, X.name_misread) is want


@pytest.mark.parametrize(("cell", "want"), [("=1+1", "'=1+1"), ("-5", "-5"), ("-cmd", "'-cmd"), ("@x", "'@x"), (None, ""), ("ok", "ok")])
def test_csv_cells(spark, cell, want):
    assert one(spark, cell, X.csv_cell) == want


@pytest.mark.parametrize(("line", "want"), [
    ("Glucose: 92 mg/dL 70 - 100", ("92", "mg/dL", None, "70 - 100")), ("Glucose 182 H mg/dL", ("182", "mg/dL", "H", None)), ("Glucose 14,8 mmol/L", ("14,8", "mmol/L", None, None)),
    ("Glucose 70 - 100 mg/dL", None), ("Average Glucose 120 mg/dL", None), ("Glucose 92", ("92", None, None, None)),
])
def test_result_cells(spark, line, want):
    rows = E.extract_results(spark.createDataFrame([(1, 1, line)], "d int, page_num int, text string"), "d", ["glucose"]).collect()
    assert (tuple(rows[0][c] for c in ("value", "unit", "flag", "ref")) if rows else None) == want


HEADER = "Patient Name: Aarav Mehta\nPatient ID: P-10293\nDOB: 1980-04-12 Sex: Male\nSpecimen Type: Blood\nCollection Date: 2026-01-10 Received Date: 2026-01-11\n"
RESULTS = "Glucose 90 mg/dL 70 - 100\nHemoglobin 14.5 g/dL 13.5 - 17.5\nHematocrit 44.0 % 41 - 50\nWBC 7.5 K/uL 4.5 - 11.0\nPlatelets 250 K/uL 150 - 450\n"
LAYOUTS = {
    "clean": (HEADER + RESULTS, {"patient_id": "P-10293", "glucose": "90", "patient_sex": "Male", "date_of_birth": "1980-04-12", "received_date": "2026-01-11", "specimen_type": "Blood"}),
    "id number": (HEADER.replace("Patient ID: P-10293", "Patient ID Number: P-10293"), {"patient_id": "P-10293"}),
    "mrn": (HEADER.replace("Patient ID: P-10293", "MRN No. 778812"), {"patient_id": "778812"}),
    "blank id": (HEADER.replace("P-10293", ""), {"patient_id": None, "date_of_birth": "1980-04-12"}),
    "physician": ("Physician Name: Dr Rao\n" + HEADER, {"patient_name": "Aarav Mehta"}),
    "name ends its line": (HEADER.replace("Aarav Mehta", "Aarav Mehta\nComplete Blood Count"), {"patient_name": "Aarav Mehta"}),
    "name before a label": ("Patient: Mehta, Aarav, DOB 01/02/1980\n", {"patient_name": "Mehta, Aarav", "date_of_birth": "01/02/1980"}),
    "range only": (RESULTS.replace("14.5 g/dL 13.5 - 17.5", "13.5 - 17.5 g/dL"), {"hemoglobin": None, "hematocrit": "44.0"}),
    "other analytes": ("Mean Cell Hemoglobin 24.0 pg 27 - 33\nEstimated Average Glucose 140 mg/dL\nHemoglobin A1c 5.5 %\n" + RESULTS, {"hemoglobin": "14.5", "glucose": "90"}),
    "one line": ((HEADER + RESULTS).replace("\n", " "), {"patient_name": "Aarav Mehta", "platelet_count": "250", "white_blood_cell_count": "7.5", "collection_date": "2026-01-10"}),
    "empty": ("", {"glucose": None}),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(spark, layout):
    text, want = LAYOUTS[layout]
    got = {r.field_name: r.value for r in E.extract_fields(spark.createDataFrame([(1, 1, text)], "d int, page_num int, text string"), "d").collect()}
    assert {k: got.get(k) for k in want} == want


@pytest.mark.parametrize(("line", "field", "want"), [
    ("Glucose 12.0 3.9 - 5.6 mmol/L", "glucose", ("12.0", "mmol/L", None, "3.9 - 5.6")), ("Glucose 90 70 - 100", "glucose", ("90", None, None, "70 - 100")),
    ("Glucose 5.5 mmol/1", "glucose", ("5.5", "mmol/1", None, None)), ("Glucose, fasting: 182H mg/dL (70 - 100)", "glucose", ("182", "mg/dL", "H", "70 - 100")),
    ("Hct 0.42 L/L", "hematocrit", ("0.42", "L/L", None, None)), ("WBC 7.5 x10^3/µL low", "white_blood_cell_count", ("7.5", "x10^3/µL", "LOW", None)),
    ("Platelets 250,000 /uL >= 150,000", "platelet_count", ("250,000", "/uL", None, ">= 150,000")), ("Platelet Count 250 109/L", "platelet_count", ("250", "109/L", None, None)),
    ("Glucose 12.5.3 mg/dL", "glucose", None), ("Glucose 90 High Sensitivity", "glucose", ("90", None, "HIGH", None)),
])
def test_cells_of_all_shapes(spark, line, field, want):
    rows = E.extract_results(spark.createDataFrame([(1, 1, line)], "d int, page_num int, text string"), "d", [field]).collect()
    assert (tuple(rows[0][c] for c in ("value", "unit", "flag", "ref")) if rows else None) == want


def test_boxes_of_a_value(spark):
    pages = spark.createDataFrame([(1, 1, "Patient Name: Jane Roe\nGlucose: 92 mg/dL 70 - 100")], "d int, page_num int, text string")
    words = E.words_of(pages, "d").withColumns({"confidence": F.lit(90.0) + F.col("nth"), "box": F.array(F.col("nth") * 0.1, F.col("line_no") * 0.03, F.lit(0.08), F.lit(0.02))})
    got = {r.field_name: (r.confidence, [round(x, 6) for x in r.box]) for r in E.field_boxes(E.extract_fields(pages, "d"), words, "d").collect()}
    assert got == {"patient_name": (92.5, [0.2, 0.0, 0.18, 0.02]), "glucose": (91.5, [0.1, 0.03, 0.18, 0.02])}


def test_rows_anchor_on_their_first_word(spark):
    words = [("b", 0.5, 0.101, 0.1, 0.02), ("a", 0.1, 0.10, 0.1, 0.02), ("d", 0.5, 0.14, 0.1, 0.02), ("c", 0.1, 0.141, 0.1, 0.02)]
    df = spark.createDataFrame([(words,)], "w array<struct<text:string,x:double,y:double,w:double,h:double>>")
    assert df.select(L.page_text(F.col("w"))).first()[0] == "a b\nc d"


def test_export_refuses_what_is_over_the_limit(spark):
    with pytest.raises(ValueError, match="more than 3"):
        R.guarded_export(spark.range(4), 3)
    assert R.guarded_export(spark.range(3), 3).count() == 3


@pytest.mark.parametrize(("value", "page", "field", "want"), [
    ("9.5 K", "wbc\t9.5\n K/uL", "white_blood_cell_count", False), ("9.5", "WBC count: 9.5K/uL", "white_blood_cell_count", True), ("95", "Glucose " + "x " * 11 + "95", "glucose", True),
    ("95", "Glucose " + "x " * 12 + "95", "glucose", False), ("Ana  Lo-pez", "Name: ANA -- lo pez.", "patient_name", True), ("na lo", "ana lo", "patient_name", False),
    ("ab" * 150, "x " + "ab " * 150 + "y", "patient_name", True), ("ab" * 150, "ab " * 149 + "a bc", "patient_name", False), ("92", "---", "glucose", False), (None, "x", "glucose", True),
])
def test_values_among_words(spark, value, page, field, want):
    df = spark.createDataFrame([(value, page, field)], "v string, p string, f string")
    assert df.select(X.printed_on_page(F.col("v"), F.col("p"), F.col("f"))).first()[0] is want


def test_a_page_check_is_one_pattern(spark):
    """A check costs one pass of its page, not several functions per word, over 120 million words here."""
    rows = spark.range(4000).select(F.concat(F.lit("17."), F.col("id") % 10).alias("v")).select("v", F.concat(F.lit("wbc "), F.repeat(F.lit("q "), F.lit(30_000)), F.lit("wbc "), F.replace("v", F.lit("."), F.lit(""))).alias("w"))
    began = time.monotonic()
    assert rows.filter(X.stands_among(F.col("v"), F.col("w"), F.lit("white_blood_cell_count"))).count() == 4000
    assert time.monotonic() - began < 30


@pytest.mark.parametrize(("text", "order", "want"), [
    ("3/4/2020", "DMY", dt.date(2020, 4, 3)), ("3-4-2020", "MDY", dt.date(2020, 3, 4)), ("5 Mar 2020", "MDY", dt.date(2020, 3, 5)), ("March 5, 2020", "DMY", dt.date(2020, 3, 5)),
    ("5.3.2020", "MDY", dt.date(2020, 3, 5)), ("x/4/2020", "MDY", None), ("2020", "MDY", None), (None, "MDY", None),
])
def test_only_likely_formats_are_tried(spark, text, order, want):
    assert one(spark, text, lambda c: D.parse_date(c, F.lit(order))) == want
