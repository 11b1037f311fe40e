"""From page text to a decision: extract, complete, validate in context, check against the page and across fields, decide.

One shuffle by document serves all of it: a document's fields are gathered into one array (a dozen at most), its context is
read from that array, and the window functions that compare fields run on the same partitioning. Pages join on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labframe import schema
from labframe.functions import dates as D
from labframe.functions import numbers as N
from labframe.functions import text as X
from labframe.operators import extract as E
from labframe.operators import validate as V
from labframe.sources import files

FIELD = ["value", "unit", "reference_range", "abnormal_flag", "confidence", "page_num"]
VALIDATED = schema.MANDATORY_FIELDS + schema.OPTIONAL_FIELDS
# What the messages say.
MISSING = "Required field missing"
NOT_FOUND = "Extracted value was not found in the document text"
MISREAD = "The name looks misread by OCR (e.g. a lowercase l for a capital I); check it against the document"
LOW = "Low confidence extraction"
CHECK = "check for a misread digit or decimal point"


def in_context(fields: DataFrame, by: str, order: str = "MDY", docs: DataFrame | None = None) -> DataFrame:
    """``fields`` (by, field_name, FIELD) with a MISSING row for every mandatory field that a document lacks, and date_order, sex
    and age of the document. Of rows that name a field twice, the one that stands first in the order of page and value is the
    context; all are validated. ``docs`` names documents (by) that may have no fields at all."""
    of_docs, kinds = docs, dict(fields.dtypes)
    one = F.struct("field_name", *[c for c in FIELD])
    docs = fields.filter(F.col("field_name").isin(VALIDATED)).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("page_num", "value", one.alias("f")))).alias("fs"))
    docs = docs.withColumn("fs", F.transform("fs", lambda x: x["f"]))
    if of_docs is not None:
        none = F.array().cast(dict(docs.dtypes)["fs"])
        docs = of_docs.select(by).distinct().join(docs, by, "left").withColumn("fs", F.coalesce("fs", none))

    def value(name: str) -> Column:
        return F.get(F.filter("fs", lambda f: f["field_name"] == name), F.lit(0))["value"]

    # Each value is looked up once, into a column of its own.
    docs = docs.withColumns({f"_{name}": value(name) for name in [*sorted(schema.DATE_FIELDS), "patient_sex"]})
    votes = F.array_distinct(F.array_compact(F.array(*[D.order_vote(F.col(f"_{d}")) for d in sorted(schema.DATE_FIELDS)])))
    docs = docs.withColumn("votes", votes).withColumn("date_order", F.when(F.size("votes") == 1, F.get("votes", F.lit(0))).otherwise(F.lit(order)))
    docs = docs.withColumns({"collected": D.parse_date(F.col("_collection_date"), F.col("date_order")), "born": D.parse_date(F.col("_date_of_birth"), F.col("date_order"))})
    docs = docs.withColumns({"sex": X.normalize_sex(F.col("_patient_sex")), "age": D.age_in_years(F.col("born"), F.col("collected"))})
    absent = F.array_except(F.array(*[F.lit(m) for m in schema.MANDATORY_FIELDS]), F.transform("fs", lambda f: f["field_name"]))
    blank = F.transform(absent, lambda name: F.struct(name.alias("field_name"), *[
        (F.lit(0.0) if c == "confidence" else F.lit(None)).cast(kinds[c]).alias(c) for c in FIELD]))
    return docs.select(by, "date_order", "sex", "age", F.explode(F.concat("fs", blank)).alias("f")).select(by, "date_order", "sex", "age", "f.*")


def _numeric_message(state: Column) -> Column:
    """What a reviewer reads about a result that isn't plainly valid."""
    shown, unit = N.format_number(F.col("normalized")), N.canonical_unit(F.col("field_name"))
    low, high = (F.coalesce(F.col(c).cast("double").cast("string"), F.lit("None")) for c in ("lower", "upper"))
    p_lo, p_hi = (c.cast("double").cast("string") for c in N.plausible(F.col("field_name")))
    flag = X.normalize_flag(F.col("abnormal_flag"))
    inside = F.col("direction").isNull()
    abnormal = (
        F.when(flag.isNotNull() & inside, F.concat(F.lit("Value "), shown, F.lit(" "), unit, F.lit(" is flagged "), F.when(flag == "H", "high").otherwise("low"), F.lit(" on the report")))
        .when(F.col("basis") == "report", F.concat(F.lit("Value "), shown, F.lit(" "), unit, F.lit(" is outside the report's reference range ("), F.trim("reference_range"), F.lit(")")))
        .otherwise(F.concat(F.lit("Value "), shown, F.lit(" is outside the "), F.col("basis"), F.lit(" reference range ("), low, F.lit(" - "), high, F.lit(" "), unit, F.lit(")")))
    )
    n = F.col("normalized")
    lo, hi = N.plausible(F.col("field_name"))
    extreme = F.when((n < lo) | (n > hi), F.concat(
        F.lit("Value "), shown, F.lit(" "), unit, F.lit(" is outside any plausible result ("), p_lo, F.lit(" - "), p_hi, F.lit(f"); {CHECK}"),
    )).otherwise(F.concat(F.lit("Value "), shown, F.lit(" is far outside the reference range ("), low, F.lit(" - "), high, F.lit(f"); {CHECK}")))
    no_unit = F.coalesce("unit", F.lit("")) == ""
    return (
        F.when(state == "INVALID_FORMAT", F.concat(F.lit("Invalid numeric format: "), "value")).when(state == "OUTSIDE_REFERENCE_RANGE", abnormal).when(state == "EXTREME_VALUE", extreme)
        .when((state == "UNRECOGNIZED_UNIT") & no_unit, F.concat(F.lit("No unit printed with the result; expected "), unit))
        .when(state == "UNRECOGNIZED_UNIT", F.concat(F.lit("Unrecognized unit '"), "unit", F.lit("'; expected "), unit))
        .when(state == "NO_REFERENCE_RANGE", F.concat(F.lit("Adult reference ranges do not apply (age "), F.col("age").cast("string"), F.lit("); verify against the report's own range")))
    )


def validate_each(rows: DataFrame, today: str | None = None) -> DataFrame:
    """Adds state, messages, normalized_value, normalized, lower, upper, direction, basis, ambiguous. ``rows`` has context."""
    now = F.current_date() if today is None else F.lit(today).cast("date")
    decided = V.decide_numbers(rows)
    field, value, blank = F.col("field_name"), F.col("value"), F.trim(F.coalesce("value", F.lit(""))) == ""
    number, date, sex = field.isin(schema.NUMERIC_FIELDS), field.isin(schema.DATE_FIELDS), field == "patient_sex"
    decided = decided.withColumns({"day": F.when(date, D.parse_date(value, F.col("date_order"))), "as_sex": F.when(sex, X.normalize_sex(value))})
    state = (
        F.when(blank & field.isin(schema.OPTIONAL_FIELDS), "VALID").when(blank, "MISSING").when(date, D.date_state(F.col("day"), now))
        .when(sex & F.col("as_sex").isNull() & ~X.unknown_sex(value), "INVALID_FORMAT").when(number, F.col("state")).otherwise("VALID")
    )
    decided = decided.withColumn("state", state)
    message = (
        F.when(F.col("state") == "MISSING", MISSING).when(date & (F.col("state") == "INVALID_FORMAT"), F.concat(F.lit("Invalid date format: "), value))
        .when(date & (F.col("state") == "IMPLAUSIBLE_VALUE"), F.concat(F.lit("Date is in the future: "), value))
        .when(sex & (F.col("state") == "INVALID_FORMAT"), F.concat(F.lit("Unrecognized sex value: "), value)).when(number, _numeric_message(F.col("state")))
    )
    normal = (
        F.when(blank & field.isin(schema.OPTIONAL_FIELDS), F.lit(None)).when(date, F.date_format("day", "yyyy-MM-dd")).when(sex, F.col("as_sex"))
        .when(number & (F.col("state") != "MISSING"), N.format_number(F.col("normalized"))).otherwise(value)
    )
    out = decided.withColumns({"messages": F.array_compact(F.array(message)), "normalized_value": normal, "ambiguous": date & F.col("day").isNotNull() & D.is_ambiguous(value)})
    return out.drop("day", "as_sex", "raw", "scale", "b_lo", "b_hi")


def check_pages(rows: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """Values that don't stand on their page (on any page, where the page is unknown) become SOURCE_MISMATCH, names that OCR may
    have misread POSSIBLE_MISREAD. A document without text is left alone. ``pages`` has by, page_num, text, ocr_used. Each page is
    cut into words once."""
    read = pages.select(by, F.struct("page_num", X.page_words(F.col("text")).alias("words"), "ocr_used").alias("p"))
    joined = rows.join(read.groupBy(by).agg(F.sort_array(F.collect_list("p")).alias("pages")), by, "left")
    of_page = F.filter("pages", lambda p: p["page_num"] == F.col("page_num"))
    joined = joined.withColumn("of_page", of_page).withColumn("shown", F.when(F.size("of_page") > 0, F.col("of_page")).otherwise(F.col("pages")))
    joined = joined.withColumn("words", F.array_join(F.transform("shown", lambda p: p["words"]), " "))
    found = (F.trim(F.coalesce("words", F.lit(""))) == "") | (F.coalesce("value", F.lit("")) == "") | X.stands_among(F.col("value"), F.col("words"), F.col("field_name"))
    joined = joined.withColumn("found", found)
    absent = (F.col("state") != "MISSING") & ~F.col("found")
    ocr = F.coalesce(F.get("of_page", F.lit(0))["ocr_used"], F.lit(False))
    misread = (F.col("field_name") == "patient_name") & (F.col("state") == "VALID") & ocr & X.name_misread(F.col("value"))
    more = F.when(absent, NOT_FOUND).when(misread, MISREAD)
    joined = joined.withColumn("messages", F.when(more.isNull(), F.col("messages")).otherwise(F.array_append("messages", more)))
    return joined.withColumn("state", F.when(absent, "SOURCE_MISMATCH").when(misread, "POSSIBLE_MISREAD").otherwise(F.col("state"))).drop("pages", "of_page", "shown", "words", "found")


def check_dates(rows: DataFrame, by: str) -> DataFrame:
    """Valid dates that contradict one another become INCONSISTENT_DATES."""
    w = Window.partitionBy(by)

    def day(name: str) -> Column:
        return F.max(F.when((F.col("field_name") == name) & (F.col("state") == "VALID"), F.to_date("normalized_value"))).over(w)

    rows = rows.withColumns({"_born": day("date_of_birth"), "_taken": day("collection_date"), "_got": day("received_date")})
    collection, received = D.date_problem(F.col("_born"), F.col("_taken"), F.col("_got"))
    problem = F.when(F.col("state") == "VALID", F.when(F.col("field_name") == "collection_date", collection).when(F.col("field_name") == "received_date", received))
    rows = rows.withColumn("_problem", problem)
    bad = F.col("_problem").isNotNull()
    rows = rows.withColumns({"messages": F.when(bad, F.array_append("messages", F.col("_problem"))).otherwise(F.col("messages")), "state": F.when(bad, "INCONSISTENT_DATES").otherwise(F.col("state"))})
    return rows.drop("_born", "_taken", "_got", "_problem")


def check_flags(rows: DataFrame, by: str) -> DataFrame:
    """Adds FLAG_MISMATCH with the message that replaces all others."""
    before = rows.withColumn("_was", F.col("state"))
    numbers = F.col("field_name").isin(schema.NUMERIC_FIELDS)
    flagged = V.flag_mismatch(before.withColumn("abnormal_flag", F.when(numbers, F.col("abnormal_flag"))), by)
    words = {"H": "high", "L": "low"}

    def word(c: Column) -> Column:
        return F.when(c == "H", words["H"]).when(c == "L", words["L"]).otherwise("normal")

    ends = F.concat("basis", F.lit(" range "), *[x for c, sep in (("lower", " - "), ("upper", "")) for x in (F.coalesce(F.col(c).cast("double").cast("string"), F.lit("None")), F.lit(sep))])
    text = F.concat(
        F.lit("The report marks this result "), word(X.normalize_flag(F.col("abnormal_flag"))), F.lit(", but the value read ("), "normalized_value", F.lit(") is "),
        word(F.col("direction")), F.lit(" for its range ("), F.when(F.col("basis") == "report", F.trim("reference_range")).otherwise(ends), F.lit(f"); {CHECK}"),
    )
    new = numbers & (F.col("state") == "FLAG_MISMATCH") & (F.col("_was") != "FLAG_MISMATCH")
    state = F.when(numbers, F.col("state")).otherwise(F.col("_was"))
    return flagged.withColumns({"messages": F.when(new, F.array(text)).otherwise(F.col("messages")), "state": state}).drop("_was")


def score(rows: DataFrame, high: float = 0.9, low: float = 0.7) -> DataFrame:
    """Adds conf (0 to 1), category, is_valid; low confidence adds a message."""
    conf = N.field_confidence(F.col("confidence").cast("double"), F.col("state"))
    rows = rows.withColumn("conf", conf).withColumn("category", N.confidence_category(F.col("conf"), high, low)).withColumn("is_valid", F.col("state") == "VALID")
    return rows.withColumn("messages", F.when(F.col("category") == "LOW", F.array_append("messages", F.lit(LOW))).otherwise(F.col("messages")))


def validate(fields: DataFrame, by: str, pages: DataFrame | None = None, today: str | None = None, order: str = "MDY", docs: DataFrame | None = None) -> DataFrame:
    """All field-level steps in their order. ``fields`` has by, field_name and FIELD (confidence from 0 to 100)."""
    rows = validate_each(in_context(fields, by, order, docs), today)
    rows = rows if pages is None else check_pages(rows, pages, by)
    return score(check_flags(check_dates(rows, by), by))


def decide(validated: DataFrame, by: str, auto_accept: float = 0.9, hold_abnormal: bool = False) -> DataFrame:
    """Per document: overall_confidence, decision, validation_status, summary (field: state of all that isn't VALID)."""
    note = F.when(F.col("state") != "VALID", F.concat("field_name", F.lit(": "), "state"))
    decided = V.decide_reports(validated, by, auto_accept, hold_abnormal, [F.array_sort(F.collect_list(note)).alias("summary")])
    return decided.withColumn("validation_status", F.when(F.col("decision") == "AUTO_ACCEPTED", "VALID").otherwise("INVALID"))


def run(pages: DataFrame, by: str, confidence: float = 99.0, today: str | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Extract, validate and decide: the fields and the documents. Documents without text end as all MISSING.

    With a ``folder`` the validated fields are written there, so that what is made of them doesn't make them again.
    """
    found = E.extract_fields(pages, by).withColumnsRenamed({"ref": "reference_range", "flag": "abnormal_flag"}).withColumn("confidence", F.lit(confidence))
    checked = pages if "ocr_used" in pages.columns else pages.withColumn("ocr_used", F.lit(False))
    validated = validate(found.select(by, "field_name", *FIELD), by, checked, today, docs=pages.select(by))
    validated = validated if folder is None else files.stored(validated, folder)
    return validated, decide(validated, by)
