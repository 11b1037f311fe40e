"""Fields from page text by a rule table: labels, words that rule a label out, and what may follow it on its line.

Each line is cut once per field at the field's labels. What follows a label is a candidate. It is cut into tokens (numbers,
words, blanks, single signs), and a cursor goes over them: a number, then flag, unit, printed range and unit again, each
optional and recognized by the kinds of its tokens. Dates are known by the row of kinds that their tokens make. The first
acceptable candidate of the first page that has one wins. Lines are rows, so a page of any length is spread over tasks by Spark;
only what follows a label reaches Python, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labframe import schema

# Labels, units and words as they stand on reports.
LABELS = {
    "patient_name": ["patient name", "patient:", "name:"],
    "date_of_birth": ["dob", "d.o.b.", "d.o.b", "date of birth", "birth date"],
    "patient_id": ["patient id", "patient identifier", "mrn", "medical record", "pt id", "pt. id"],
    "patient_sex": ["sex", "gender"],
    "specimen_type": ["specimen", "specimen type", "sample", "sample type"],
    "collection_date": ["collection date", "date collected", "collected", "collected on", "draw date"],
    "received_date": ["received date", "date received", "received", "received on"],
    "glucose": ["glucose", "glu"],
    "hemoglobin": ["hemoglobin", "haemoglobin", "hgb", "hb"],
    "hematocrit": ["hematocrit", "haematocrit", "hct"],
    "white_blood_cell_count": ["white blood cell", "white blood cells", "white blood cell count", "wbc", "wbc count", "leukocyte", "leukocytes"],
    "platelet_count": ["platelet", "platelets", "platelet count", "platelets count", "plt"],
}
NOT_AFTER = {
    "glucose": ["average"],
    "hemoglobin": ["cell", "corpuscular", "glycated", "glycosylated"],
    "patient_name": [
        "physician", "doctor", "dr", "dr.", "provider", "ordering", "referring", "referred", "consultant", "attending", "lab",
        "laboratory", "facility", "hospital", "clinic", "test", "collector", "guardian", "father", "mother", "father's", "mother's",
        "parent", "insurance", "employer", "company", "contact", "kin", "technician", "tech", "verified", "reported", "approved",
        "signed", "user", "account", "practice", "client", "sample", "specimen", "site", "location", "department", "ward", "panel", "report",
    ],
}
NOT_BEFORE = {"hemoglobin": ["a1c"]}
MAY_FOLLOW = {"glucose": ["fasting", "random", "serum", "plasma"]}
#: Units as they look without blanks, carets and case, with u for the micro sign.
COUNT_UNITS = ["x103/ul", "x109/ul", "x103/l", "x109/l", "103/ul", "109/ul", "103/l", "109/l"]
#: Printed in one piece only.
SHORT_COUNT_UNITS = ["k/ul", "thou/ul", "cells/ul", "/ul", "/mm3"]
UNITS = {
    "glucose": ["mg/dl", "mmol/l"], "hemoglobin": ["g/dl", "g/l", "mmol/l"], "hematocrit": ["%", "l/l"], "white_blood_cell_count": COUNT_UNITS, "platelet_count": COUNT_UNITS,
}
#: Of these, units of any other form are kept too, so that an unknown one is seen.
ANY_UNIT = ["glucose", "hemoglobin"]
FLAGS = ["HH", "LL", "HIGH", "LOW", "H", "L"]
SEXES = ["male", "female", "m", "f"]
SPECIMENS = ["whole blood", "blood", "urine", "saliva", "serum", "plasma"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: A name ends before these.
AFTER_NAME = [
    "dob", "d.o.b", "date of birth", "birth date", "patient", "mrn", "medical", "sex", "gender", "age", "glucose", "hemoglobin",
    "haemoglobin", "hgb", "hematocrit", "haematocrit", "hct", "white", "wbc", "platelet", "platelets", "plt", "specimen", "sample",
    "collection", "collected", "received", "accession", "ordering", "physician", "doctor", "report",
]

JOINS = ["-", "–", "to"]
BOUNDS = ["<", ">", "≤", "≥"]
#: Kinds of the tokens of a date: n a day or month in digits, y a year, m a month's name, other signs themselves.
DATES = ["y-n-n", "y/n/n", "n/n/y", "n-n-y", "n.n.y", "n-m-y", "n m y", "n-m y", "n m-y", "n-m.-y", "n m. y", "n-m. y", "n m.-y", "m n y", "m n, y", "m. n y", "m. n, y"]

OPEN, CLOSE = "\u0001", "\u0002"
#: Tokens: digits with single points or commas between them, letters, blanks, any other sign.
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|\s+|.")
#: For dates, signs stand by themselves.
PLAIN_TOKEN = re.compile(r"\d+|[^\W\d_]+|\s+|.")
#: The most tokens that a unit or a date is made of.
LONGEST = 12


def _any(words: list[str]) -> str:
    """A pattern for any of the phrases, the longest first. Blanks in them are optional, other signs stand for themselves."""
    def one(phrase: str) -> str:
        return r"\s*".join("".join(c if c.isalnum() else f"[{c}]" for c in w) for w in phrase.replace(":", " :").split())

    return "|".join(one(w) for w in sorted(words, key=len, reverse=True))


def _label_pattern(field: str) -> str:
    """Labels are words of their own; a number may be glued to the label of glucose."""
    end = "(?![a-z_])" if field == "glucose" else r"(?!\w)"
    ends_in_sign = [w for w in LABELS[field] if not w[-1].isalnum()]
    words = [w for w in LABELS[field] if w[-1].isalnum()]
    return rf"(?iu)(?<!\w)(?:{_any(ends_in_sign)}|(?:{_any(words)}){end})" if ends_in_sign else rf"(?iu)(?<!\w)(?:{_any(words)}){end}"


NEXT_LABEL = re.compile(rf"\s+(?:{_any(AFTER_NAME)})(?!\w)", re.IGNORECASE)


def lines_of(pages: DataFrame, by: str) -> DataFrame:
    """by, page_num, line_no (from 0), line: blanks of all kinds become spaces, so positions stay as they are."""
    rows = pages.select(by, "page_num", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace("line", r"[\s\u0001\u0002  -  　]", " "))


def candidates(pages: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """by, page_num, line_no, nth, field_name, before (text before the label), tail (what follows it), start (of the tail)."""
    marked = [
        F.struct(F.lit(f).alias("field_name"), F.split(F.regexp_replace("line", f"({_label_pattern(f)})", f"{OPEN}$1{CLOSE}"), CLOSE).alias("parts"))
        for f in fields
    ]
    found = lines_of(pages, by).select(by, "page_num", "line_no", F.explode(F.filter(F.array(*marked), lambda m: F.size(m["parts"]) > 1)).alias("m"))
    parts = F.col("m.parts")
    each = found.select(by, "page_num", "line_no", "m.field_name", parts.alias("parts"), F.posexplode(parts).alias("nth", "part")).filter("nth > 0")
    lengths = F.aggregate(F.slice("parts", F.lit(1), F.col("nth")), F.lit(0), lambda n, p: n + F.length(p) - 1)
    before = F.split(F.get("parts", F.col("nth") - 1), OPEN)[0]
    return each.select(by, "page_num", "line_no", "nth", "field_name", before.alias("before"), F.split("part", OPEN)[0].alias("tail"), lengths.alias("start"))


def _guarded(rows: DataFrame) -> DataFrame:
    """Without candidates whose label stands beside a word that makes it another thing's label."""
    last = F.rtrim(F.regexp_extract(F.lower("before"), r"(\S+)\s*$", 1))
    last = F.regexp_replace(last, ":+$", "")
    ok = F.lit(True)
    for field, words in NOT_AFTER.items():
        ok = ok & ~((F.col("field_name") == field) & last.isin(words))
    for field, words in NOT_BEFORE.items():
        ok = ok & ~((F.col("field_name") == field) & F.col("tail").rlike(rf"(?i)^\s*(?:{_any(words)})"))
    return rows.filter(ok)


class Cursor:
    """Reads the tokens of a text from left to right. Every reader gives what it took, or nothing and stays where it is."""

    def __init__(self, text: str, token: re.Pattern):
        self.tokens, self.at = token.findall(text), 0

    def __getitem__(self, i: int) -> str:
        return self.tokens[self.at + i] if self.at + i < len(self.tokens) else ""

    def blanks(self, i: int = 0) -> int:
        """Tokens to the first one from there that is no blank."""
        return i + (self[i] != "" and self[i].isspace())

    def place(self) -> int:
        """How many characters lie before the cursor."""
        return sum(map(len, self.tokens[: self.at]))

    def take(self, size) -> str:
        """Steps over a blank and as many tokens as ``size`` says of what is there; goes back if it says none."""
        before = self.at
        self.at += self.blanks()
        n = size(self)
        text = "".join(self.tokens[self.at : self.at + n])
        self.at = self.at + n if n else before
        return text

    def apart(self, n: int) -> bool:
        """Whether no letter, digit or slash goes on behind n tokens."""
        return not self[n] or not (self[n][0].isalnum() or self[n][0] in "_/")


def is_number(run: str) -> bool:
    """Whether digits with points and commas are one number: by how long the stretches between the signs are."""
    if not run[:1].isdigit():
        return False
    groups = run.split(",")
    if run.count(".") + len(groups) <= 2:
        return True
    lengths = [len(g) for g in (*groups[1:-1], groups[-1].split(".")[0])]
    return len(groups) > 1 and run.count(".") <= 1 and "." not in "".join(groups[:-1]) and len(groups[0]) <= 3 and set(lengths) == {3}


def _word_size(field: str):
    """A comma or blank and one of the words that may follow the field's label."""
    def size(c: Cursor) -> int:
        n = c.blanks(1) if c[0] == "," else 0
        return n + 1 if c[n].lower() in MAY_FOLLOW.get(field, []) and c.apart(n + 1) else 0

    return size


def _number_size(c: Cursor) -> int:
    """A number that doesn't begin a range: where it does, the cell of the result is empty."""
    join = c.blanks(1)
    begins = c[join].lower() in JOINS and c[c.blanks(join + 1)][:1].isdigit()
    return int(is_number(c[0]) and not begins)


def _flag_size(c: Cursor) -> int:
    return int(c[0].upper() in FLAGS and c.apart(1))


def _unit_size(field: str):
    """The most tokens that make a unit of the field or, for some fields, any quotient of two words."""
    def folded(text: str) -> str:
        return text.lower().replace("µ", "u").replace("μ", "u")

    def known(text: str) -> bool:
        tight = "/".join(side.strip() for side in folded(text).split("/"))
        tight = "x" + tight[1:].lstrip() if tight.startswith("x") else tight
        return tight.replace("^", "") in UNITS[field] or (UNITS[field] is COUNT_UNITS and folded(text) in SHORT_COUNT_UNITS)

    def quotient(text: str) -> bool:
        sides = [side.strip() for side in text.split("/")]
        return len(sides) == 2 and sides[0][:1].isalpha() and all(s and all(ch.isalnum() or ch in ".^" for ch in s) for s in sides) and not text[-1].isspace()

    def size(c: Cursor) -> int:
        spans = [(n, "".join(c.tokens[c.at : c.at + n])) for n in range(min(LONGEST, len(c.tokens) - c.at), 0, -1)]
        whole = next((n for n, text in spans if not text[-1].isspace() and known(text) and c.apart(n)), 0)
        return whole or next((n for n, text in spans if field in ANY_UNIT and quotient(text)), 0)

    return size


def _range_size(c: Cursor) -> int:
    """Number, join, number; or a bound and a number."""
    join = c.blanks(1)
    second = c.blanks(join + 1)
    if is_number(c[0]) and c[join].lower() in JOINS and is_number(c[second]):
        return second + 1
    behind = c.blanks(2 if c[0] in "<>" and c[1] == "=" else 1)
    return behind + 1 if c[0] in BOUNDS and is_number(c[behind]) else 0


def _sign(sign: str):
    return lambda c: int(c[0] == sign)


def read_cell(field: str, tail: str) -> tuple | None:
    """value, flag, unit, ref of what follows a label, and where the value and the unit behind it end in the tail."""
    c = Cursor(tail, TOKEN)
    c.take(_word_size(field))
    c.take(_sign(":"))
    value = c.take(_number_size)
    if not value:
        return None
    value_to = c.place()
    flag = c.take(_flag_size)
    unit = c.take(_unit_size(field))
    unit_to = c.place() if unit else value_to
    flag = flag or c.take(_flag_size)
    before = c.at
    c.take(_sign("("))
    ref = c.take(_range_size)
    c.at = c.at if ref else before
    c.take(_sign(")"))
    return value, flag.upper() or None, unit or c.take(_unit_size(field)) or None, ref or None, value_to, unit_to


def _date_size(c: Cursor) -> int:
    """The most tokens whose kinds make a date."""
    def kind(t: str) -> str:
        if t.isdigit():
            return "n" if len(t) <= 2 else "y" if len(t) == 4 else t
        return "m" if t[:3].lower() in MONTHS and t.isalpha() else t

    kinds = [kind(t) for t in c.tokens[c.at : c.at + LONGEST]]
    rows = {n: "".join(kinds[:n]) for n in range(len(kinds), 0, -1)}
    return next((n for n, row in rows.items() if (" ".join(row.split()) if row.startswith("m") else row) in DATES), 0)


def read_date(field: str, tail: str) -> tuple | None:
    """The same for a date; flag, unit and ref stay null."""
    c = Cursor(tail, PLAIN_TOKEN)
    c.take(_sign(":"))
    value = c.take(_date_size)
    return (value, None, None, None, c.place(), c.place()) if value else None


def _one_of(words: list[str]):
    """The longest of some phrases."""
    def size(c: Cursor) -> int:
        spans = [(n, " ".join("".join(c.tokens[c.at : c.at + n]).lower().split())) for n in range(3, 0, -1)]
        return next((n for n, text in spans if text in words and not c[n - 1].isspace() and (c.apart(n) or c[n] == "/")), 0)

    return size


def _id_size(c: Cursor) -> int:
    """Letters, digits and hyphens, a digit among them."""
    n = 0
    while c[n] and (c[n] == "-" and n or (c[n].isascii() and c[n].isalnum())):
        n += 1
    return n if any(t.isdigit() for t in c.tokens[c.at : c.at + n]) else 0


def _id_word_size(c: Cursor) -> int:
    """A word for number behind the label of an id."""
    if c[0] == "#":
        return 1
    word = c[0].lower() in ("number", "no") and (not c[1] or not (c[1][0].isalnum() or c[1][0] == "_"))
    return (1 + (c[0].lower() == "no" and c[1] == ".")) if word else 0


def _name_size(c: Cursor) -> int:
    """Words up to the next label; commas, points, hyphens and apostrophes belong to them."""
    text = "".join(c.tokens[c.at :])
    stop = NEXT_LABEL.search(text, 1)
    name = (text[: stop.start()] if stop else text).rstrip(" ,")
    fine = name and all(w[0].isascii() and w[0].isalpha() and all(ch.isascii() and ch.isalpha() or ch in "'.,-" for ch in w) for w in name.split(" ") if w)
    n = size = 0
    while fine and size < len(name):
        size += len(c[n])
        n += 1
    return n


def read_word(field: str, tail: str) -> tuple | None:
    """The same for the other fields."""
    c = Cursor(tail, PLAIN_TOKEN)
    if field == "patient_id":
        c.take(_id_word_size)
    c.take(_sign(":"))
    if field == "patient_id":
        c.take(_sign("#"))
    value = c.take({"patient_id": _id_size, "patient_name": _name_size, "patient_sex": _one_of(SEXES)}.get(field, _one_of(SPECIMENS)))
    return (value, None, None, None, c.place(), c.place()) if value else None


def read(field: str, tail: str) -> tuple | None:
    return (read_cell if field in UNITS else read_date if field in schema.DATE_FIELDS else read_word)(field, tail)


def _read(rows: DataFrame) -> DataFrame:
    """Candidates whose tail holds a value: value, flag, unit, ref, and where value and unit stand on the line."""
    names = ["value", "flag", "unit", "ref", "value_to", "unit_to"]

    @F.pandas_udf("value string, flag string, unit string, ref string, value_to int, unit_to int")
    def cells(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for fields, tails in batches:
            found = [read(f, t) or (None,) * 6 for f, t in zip(fields, tails, strict=True)]
            yield pd.DataFrame(found, columns=names).astype({"value_to": "Int32", "unit_to": "Int32"})

    taken = rows.withColumn("cell", cells("field_name", "tail")).filter("cell.value is not null")
    return taken.select("*", *[f"cell.{c}" for c in names[:4]]).withColumns({
        "value_start": F.col("start") + F.col("cell.value_to") - F.length("value"), "value_end": F.col("start") + F.col("cell.unit_to")})


def extract_fields(pages: DataFrame, by: str, fields: list[str] | None = None) -> DataFrame:
    """One row per (document, field): value, unit, flag, ref, page_num, line_no, value_start, value_end (positions on the line,
    the unit behind the value included) of the first page that shows the field.

    ``pages`` has ``by``, page_num and text. A null text has no lines. Documents without any field give no row.
    """
    fields = fields or list(LABELS)
    kept = ["value", "unit", "flag", "ref", "page_num", "line_no", "value_start", "value_end"]
    found = _read(_guarded(candidates(pages, by, fields))).select(by, "field_name", "nth", *kept)
    place = F.struct("page_num", "line_no", "nth")
    return found.groupBy(by, "field_name").agg(F.min_by(F.struct(*kept), place).alias("r")).select(by, "field_name", "r.*")


def extract_results(pages: DataFrame, by: str, fields: list[str] | None = None) -> DataFrame:
    """The result fields: value, unit, flag, ref, page_num."""
    return extract_fields(pages, by, fields or schema.NUMERIC_FIELDS).select(by, "field_name", "value", "unit", "flag", "ref", "page_num")


def extract_header(pages: DataFrame, by: str) -> DataFrame:
    """The fields that are no results: value, page_num."""
    return extract_fields(pages, by, [f for f in LABELS if f not in UNITS]).select(by, "field_name", "value", "page_num")


def field_boxes(found: DataFrame, words: DataFrame, by: str) -> DataFrame:
    """Adds confidence (mean, 100 if no word has one) and box (x, y, width, height of the union, inside the page; null without
    boxes) of the words that a value and its unit cover. ``words`` has by, page_num, line_no, w_start, w_end, confidence, box."""
    w = words.withColumnsRenamed({by: "_by", "page_num": "_page", "line_no": "_line", "confidence": "_conf", "box": "_box"})
    on = (F.col(by) == F.col("_by")) & (F.col("page_num") == F.col("_page")) & (F.col("line_no") == F.col("_line"))
    joined = found.join(w, on & (F.col("w_start") < F.col("value_end")) & (F.col("w_end") > F.col("value_start")), "left")
    x, y, right, low = F.min(F.col("_box")[0]), F.min(F.col("_box")[1]), F.max(F.col("_box")[0] + F.col("_box")[2]), F.max(F.col("_box")[1] + F.col("_box")[3])
    box = F.when(x.isNotNull(), F.array(x, y, F.least(right, F.lit(1.0)) - x, F.least(low, F.lit(1.0)) - y))
    agg = joined.groupBy(*found.columns).agg(F.coalesce(F.avg("_conf"), F.lit(100.0)).alias("confidence"), box.alias("box"))
    return agg


def words_of(pages: DataFrame, by: str) -> DataFrame:
    """by, page_num, line_no, w_start, w_end, word, nth: the words of each line and their places on it."""
    rows = lines_of(pages, by)
    ends = F.aggregate(
        F.split("line", " "), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<w_start:int,w_end:int,word:string>>").alias("out")),
        lambda acc, w: F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.when(w == "", acc["out"]).otherwise(F.array_append(
            acc["out"], F.struct(acc["at"].alias("w_start"), (acc["at"] + F.length(w)).alias("w_end"), w.alias("word")))).alias("out")),
        lambda acc: acc["out"],
    )
    return rows.select(by, "page_num", "line_no", F.posexplode(ends).alias("nth", "w")).select(by, "page_num", "line_no", "nth", "w.*")
