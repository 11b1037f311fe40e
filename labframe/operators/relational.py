"""Catalogue, review overlay, lifecycle, metrics and evaluation as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labframe import schema
from labframe.functions import numbers as N
from labframe.functions.text import csv_cell
from labframe.operators import fold

EXPORT_LIMIT = 10_000


# Catalogue ------------------------------------------------------------------------------------------------------------

def search(docs: DataFrame, term: str, column: str = "filename") -> DataFrame:
    """Literal, case-insensitive substring search: wildcards in the term mean themselves."""
    return docs.filter(F.contains(F.lower(F.col(column)), F.lit(term.lower())))


def search_with_corrections(docs: DataFrame, corrections: DataFrame, term: str) -> DataFrame:
    """Own column or any correction of any version: the matching ids are a flag joined from the left."""
    hits = corrections.filter(F.contains(F.lower("new_value"), F.lit(term.lower()))).select(F.col("field_id").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    return docs.join(hits, "doc_id", "left").filter(F.contains(F.lower("filename"), F.lit(term.lower())) | F.coalesce("hit", F.lit(False))).drop("hit")


def in_time(docs: DataFrame, since: str, until: str) -> DataFrame:
    return docs.filter((F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.col("created_at") < F.lit(until).cast("timestamp")))


def page(docs: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return docs.orderBy(*order).offset((number - 1) * size).limit(size)


def priority() -> list[Column]:
    return [F.col("attention").desc(), F.col("created_at").asc(), F.col("doc_id").asc()]


EXPORT_FIELDS = [
    "patient_name", "patient_id", "date_of_birth", "patient_sex", "specimen_type", "collection_date", "received_date", "glucose", "hemoglobin", "hematocrit",
    "white_blood_cell_count", "platelet_count",
]
EXPORT_BASE = ["document_id", "filename", "status", "uploaded_at", "extractor", "overall_confidence"]


def final_flag() -> Column:
    """H or L of the final value against its range; against what is plausible where it has none."""
    lo, hi = N.plausible(F.col("field_name"))
    open_ = F.col("lower").isNull() & F.col("upper").isNull()
    n = F.col("normalized")
    return F.when(n > F.when(open_, hi).otherwise(F.col("upper")), "H").when(n < F.when(open_, lo).otherwise(F.col("lower")), "L")


def export_items(fields: DataFrame) -> DataFrame:
    """``fields`` of a validated document with ``item``, the nine keys of an exported field: the final value in its canonical
    unit beside what was printed."""
    item = F.struct(
        F.coalesce(F.nullif("normalized_value", F.lit("")), "value").alias("value"), F.coalesce(N.canonical_unit(F.col("field_name")), F.col("unit")).alias("unit"),
        final_flag().alias("flag"), F.col("value").alias("printed_value"), F.col("unit").alias("printed_unit"), F.col("abnormal_flag").alias("printed_flag"),
        "reference_range", F.col("state").alias("validation_state"), F.coalesce("is_corrected", F.lit(False)).alias("corrected"),
    )
    return fields.withColumn("item", item)


def export_wide(items: DataFrame, docs: DataFrame, by: str = "document_id") -> DataFrame:
    """The CSV export: EXPORT_BASE, then value, unit, flag, reference range and state of each of EXPORT_FIELDS; guarded cells.

    ``items`` has ``by``, field_name, page_num and item; of rows that name a field twice the one of the last page counts. The
    pivot values are fixed, so no pass looks for them.
    """
    last = F.max_by("item", F.struct("page_num", "item.value"))
    wide = items.groupBy(by).pivot("field_name", EXPORT_FIELDS).agg(last)
    cells = [
        csv_cell(F.col(name)[key]).alias(name + suffix)
        for name in EXPORT_FIELDS for key, suffix in (("value", ""), ("unit", "_unit"), ("flag", "_flag"), ("reference_range", "_reference_range"), ("validation_state", "_state"))
    ]
    return docs.join(wide, by, "left").select(*[csv_cell(F.col(c)).alias(c) for c in EXPORT_BASE], *cells)


def export_nested(items: DataFrame, by: str = "document_id") -> DataFrame:
    """The JSON export of a document's fields, nine keys each."""
    last = items.groupBy(by, "field_name").agg(F.max_by("item", F.struct("page_num", "item.value")).alias("item"))
    listed = last.filter(F.col("field_name").isin(EXPORT_FIELDS))
    return listed.groupBy(by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "item"))))).alias("fields"))


def guarded_export(docs: DataFrame, limit: int = EXPORT_LIMIT) -> DataFrame:
    """Refuses, rather than truncates, what is over the limit."""
    n = docs.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} documents match; narrow the search")
    return docs


# Duplicates and review overlay ----------------------------------------------------------------------------------------

def duplicates(docs: DataFrame) -> DataFrame:
    """Each document with the earliest one of its content: an aggregate joined back, so a common content isn't one window."""
    first = docs.groupBy("content_hash").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("first_id"), F.count("*").alias("copies"))
    return docs.join(first, "content_hash").select("doc_id", "first_id", "copies")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def current_values(corrections: DataFrame) -> DataFrame:
    """Latest value and latest unit that is not null per corrected field."""
    unit = F.max_by(F.col("new_unit"), F.when(F.col("new_unit").isNotNull(), F.col("seq")))
    return corrections.filter("seq > 0").groupBy("field_id").agg(F.max_by("new_value", "seq").alias("current_value"), unit.alias("current_unit"), F.count("*").alias("n"))


def pending_corrections(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Real changes only (with a reason), the last one of a field wins."""
    last = changes.filter(F.trim("reason") != "").groupBy("field_id").agg(F.max_by("new_value", "seq").alias("new_value"))
    return last.join(current, "field_id", "left").filter(~F.col("new_value").eqNullSafe(F.col("current_value")))


def foreign_corrections(changes: DataFrame, fields: DataFrame) -> DataFrame:
    return changes.join(fields, "field_id", "left_anti")


# Lifecycle ------------------------------------------------------------------------------------------------------------

def stuck_jobs(jobs: DataFrame, as_of: str, stuck_minutes: int = 15, stale_minutes: int = 15, max_recoveries: int = 2, batch: int = 100) -> DataFrame:
    """The oldest stuck jobs and what becomes of them."""
    now = F.lit(as_of).cast("timestamp")
    waiting = F.col("status").isin("QUEUED", "RETRYING") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(stuck_minutes)))
    running = (F.col("status") == "RUNNING") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(stale_minutes)))
    top = jobs.filter(waiting | running).orderBy("updated_at", "job_id").limit(batch)
    tries = F.col("recovery_count") + (F.col("status") == "RUNNING").cast("int")
    return top.select("job_id", F.col("status").alias("was"), tries.cast("long").alias("recovery_count"),
                      F.when(tries > max_recoveries, "FAILED").otherwise("QUEUED").alias("status"))


def retry_schedule(jobs: DataFrame, base_seconds: int = 5, retries: int = 3) -> DataFrame:
    delay = F.lit(base_seconds) * F.pow(F.lit(2), F.col("recovery_count"))
    due = F.when(F.col("recovery_count") < retries, delay.cast("long"))
    return jobs.select("job_id", due.alias("delay_seconds"), F.when(due.isNull(), "FAILED").otherwise("RETRYING").alias("next_status"))


def retained(docs: DataFrame, as_of: str, days: int) -> DataFrame:
    if days <= 0:
        return docs
    old = F.col("created_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return docs.filter(~(F.col("status").isin(schema.RETAINED_FINAL_STATUSES) & old))


def redact(audit: DataFrame, purged: DataFrame) -> DataFrame:
    """Events of purged documents stay, their contents don't."""
    marked = audit.join(purged.select("resource_id", F.lit(True).alias("gone")).distinct(), "resource_id", "left")
    gone = F.coalesce("gone", F.lit(False))
    return marked.select("audit_id", "action", "resource_id", F.when(~gone, F.col("before_state")).alias("before_state"),
                         F.when(gone, '{"redacted":true}').alias("after_state"))


def greedy(events: DataFrame, keys: list[str], window_seconds: int, limit: int, inclusive: bool) -> DataFrame:
    """key, n_events, n_allowed: an event is allowed while fewer than ``limit`` allowed ones lie in the window before it."""
    timed = events.withColumn("_t", F.unix_timestamp("ts"))
    kinds = dict(events.dtypes)
    schema_ = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n_events long", "n_allowed long"])
    return fold.ordered_fold(timed, keys, ["_t"], ["_t"], lambda: fold.Window(window_seconds, limit, inclusive), fold.Window.step, schema_)


def lockouts(events: DataFrame, failures: int = 5, minutes: int = 15) -> DataFrame:
    """user_id, n_locks, n_refused from failed ('error') and successful ('signup') attempts in order."""
    tries = events.filter(F.col("event_type").isin("error", "signup")).withColumns({"_t": F.unix_timestamp("ts"), "_bad": F.col("event_type") == "error"})
    out = f"user_id {dict(events.dtypes)['user_id']}, n_locks long, n_refused long"
    return fold.ordered_fold(tries, ["user_id"], ["_t", "event_id"], ["_t", "_bad"], lambda: fold.Lockout(failures, minutes * 60), fold.Lockout.step, out)


def expired_claims(claims: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    return claims.filter(F.coalesce("updated_at", "created_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))


# Metrics and evaluation -----------------------------------------------------------------------------------------------

def dashboard(docs: DataFrame, today: str) -> DataFrame:
    """All totals in one pass."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in schema.DOCUMENT_STATUSES]
    return docs.agg(F.count("*").alias("n_total"), F.count_if(F.to_date("created_at") == F.lit(today).cast("date")).alias("n_today"), *counts)


def confidence_bucket(conf: Column) -> Column:
    return F.when(conf >= 0.9, ">=90%").when(conf >= 0.7, "70-90%").when(conf >= 0.5, "50-70%").otherwise("<50%")


def zero_filled(docs: DataFrame) -> DataFrame:
    """Counts for every status, zero where there are none."""
    domain = docs.sparkSession.createDataFrame([(s,) for s in schema.DOCUMENT_STATUSES], "status string")
    return domain.join(docs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def box_union(boxes: DataFrame) -> DataFrame:
    """Union rectangle per group in thousandths, right and bottom capped at 1000, and the mean confidence."""
    return boxes.groupBy("label").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), F.least(F.max(F.col("x") + F.col("w")), F.lit(1000)).alias("right"),
        F.least(F.max(F.col("y") + F.col("h")), F.lit(1000)).alias("bottom"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def best_by(rows: DataFrame, key: str) -> DataFrame:
    """Per key the row with the highest confidence, then the earliest page, then the smallest id."""
    return rows.groupBy(key).agg(F.max_by(F.struct("vec_id", "page", "confidence"), F.struct(F.col("confidence"), -F.col("page"), -F.col("vec_id"))).alias("b")).select(key, "b.*")


def outcomes(rows: DataFrame, by: str) -> DataFrame:
    right = F.count_if(F.col("outcome") == "correct")
    return rows.groupBy(by).agg(
        right.alias("n_correct"), F.count_if(F.col("outcome") == "wrong").alias("n_wrong"), F.count_if(F.col("outcome") == "missing").alias("n_missing"),
        F.round(right / F.count("*"), 6).alias("accuracy"),
    )


def list_documents(docs: DataFrame, fields: DataFrame, statuses: list[str] | None = None, term: str | None = None, since: str | None = None, until: str | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """The list's rows: filters, then patient name and id, needs_attention (any field in ATTENTION_STATES), confidence in percent.

    ``fields`` has doc_id, field_id, field_name, value, current_value, state of the current extraction. Filters on the documents
    come before any join; the fields of what is left are aggregated once.
    """
    rows = docs.filter(F.col("status").isin(statuses)) if statuses else docs
    rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else rows
    rows = rows.filter(F.col("created_at") < F.lit(until).cast("timestamp")) if until else rows
    names = F.col("field_name").isin("patient_name", "patient_id")
    of_doc = fields
    hit = F.lit(False)
    if term and term.strip():
        literal = F.lit(term.strip().lower())
        hit = names & F.coalesce(F.contains(F.lower("value"), literal), F.lit(False))
        if corrections is not None:
            found = corrections.filter(F.contains(F.lower("new_value"), literal)).select("field_id", F.lit(True).alias("_hit")).distinct()
            of_doc = of_doc.join(found, "field_id", "left")
            hit = hit | (names & F.coalesce("_hit", F.lit(False)))
    of_doc = of_doc.groupBy("doc_id").agg(
        F.max(F.when(F.col("field_name") == "patient_name", F.col("current_value"))).alias("patient_name"), F.max(F.when(F.col("field_name") == "patient_id", F.col("current_value"))).alias("patient_id"),
        F.coalesce(F.bool_or(F.col("state").isin(schema.ATTENTION_STATES)), F.lit(False)).alias("needs_attention"), F.bool_or(hit).alias("_found"))
    rows = rows.join(of_doc, "doc_id", "left")
    if term and term.strip():
        rows = rows.filter(F.contains(F.lower("filename"), F.lit(term.strip().lower())) | F.coalesce("_found", F.lit(False)))
    return rows.withColumns({"needs_attention": F.coalesce("needs_attention", F.lit(False)), "overall_confidence": F.round(F.col("overall_confidence") * 100, 1)}).drop("_found", "attention")


def after_local_day(until_day: str, zone: str) -> Column:
    """The first moment behind a day in a reader's own time zone: the end of a closed range of days."""
    return F.to_utc_timestamp(F.date_add(F.lit(until_day).cast("date"), 1).cast("timestamp"), zone)


def recent(events: DataFrame, now: str, minutes: int) -> DataFrame:
    """Events of the last minutes, the first moment included."""
    return events.filter(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))


def by_role(users: DataFrame, roles: list[str]) -> DataFrame:
    """Active demo users in the order of the roles, then by name."""
    return users.filter(F.col("active").eqNullSafe(True)).orderBy(F.array_position(F.array(*map(F.lit, roles)), F.col("role")), "name")


def next_target(queue: DataFrame, current_id: int) -> DataFrame:
    """The first document of the review queue other than the one at hand."""
    return page(queue.filter(F.col("doc_id") != current_id), priority(), 1, 1)


def latency_histogram(timings: DataFrame, bounds: list[float]) -> DataFrame:
    """le, n: cumulative counts of seconds up to each bound, the last one without bound."""
    bars = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col("seconds") <= b).alias("n")) for b in bounds]
    counts = timings.agg(F.array(*bars, F.struct(F.lit("inf").alias("le"), F.count("seconds").alias("n"))).alias("bars"))
    return counts.select(F.explode("bars").alias("b")).select("b.*")


def gates(correct: DataFrame, accepted_right: DataFrame, fields: float = 0.97, precision: float = 1.0, share: float = 0.5) -> DataFrame:
    """gate, value, passed. ``correct``: outcome per field. ``accepted_right``: accepted and all_correct per document."""
    a = correct.agg((F.count_if(F.col("outcome") == "correct") / F.count("*")).alias("value")).select(F.lit("fields").alias("gate"), "value")
    b = accepted_right.agg((F.count_if(F.col("accepted") & F.col("all_correct")) / F.count_if("accepted")).alias("precision"), (F.count_if("accepted") / F.count("*")).alias("share"))
    both = a.unionByName(b.unpivot([], ["precision", "share"], "gate", "value"))
    least = F.when(F.col("gate") == "fields", fields).when(F.col("gate") == "precision", precision).otherwise(share)
    return both.select("gate", F.round("value", 6).alias("value"), (F.coalesce("value", F.lit(0.0)) >= least).alias("passed"))


def case_outcomes(got: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """by, field_name, outcome: correct, wrong or missing. Results within tolerance are correct."""
    joined = truth.join(got.select(by, "field_name", F.col("normalized_value").alias("got")), [by, "field_name"], "left")
    blank = F.coalesce(F.trim("got"), F.lit("")) == ""
    return joined.select(by, "field_name", F.when(blank, "missing").when(N.tolerance_match(F.col("got"), F.col("truth")), "correct").otherwise("wrong").alias("outcome"))


def report_lines(outcomes_: DataFrame, accepted_right: DataFrame, traits: list[str]) -> DataFrame:
    """n, line: the report of an evaluation as text. ``outcomes_``: field_name, outcome and traits; ``accepted_right`` as in gates.

    One line per field and trait value, so it is small whatever was evaluated.
    """
    def percent(share: Column, digits: int = 1) -> Column:
        return F.concat(F.format_number(F.round(share * 100, digits), digits), F.lit("%"))

    right = F.count_if(F.col("outcome") == "correct") / F.count("*")
    docs = accepted_right.agg(F.count("*").alias("n"), F.avg(F.col("all_correct").cast("int")).alias("right"), F.avg(F.col("accepted").cast("int")).alias("share"),
                              F.avg(F.when(F.col("accepted"), F.col("all_correct").cast("int"))).alias("precision"))
    precision = F.when(F.col("precision").isNotNull(), F.concat(F.lit(", of which fully correct: "), percent(F.col("precision")))).otherwise("")
    head = docs.select(F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.concat(F.lit("Documents: "), "n").alias("line")), F.struct(F.lit(3).alias("n"), F.concat(F.lit("Documents fully correct: "), percent(F.col("right"))).alias("line")),
        F.struct(F.lit(4).alias("n"), F.concat(F.lit("Auto-accepted: "), percent(F.col("share")), F.lit(" of documents"), precision).alias("line")))).alias("x")).select("x.*")
    whole = outcomes_.agg(F.concat(F.lit("Field accuracy: "), percent(right)).alias("line")).select(F.lit(2).alias("n"), "line")
    cell = [F.count_if(F.col("outcome") == o).cast("string") for o in ("wrong", "missing")]
    table = outcomes_.groupBy("field_name").agg(F.concat(F.lit("| "), "field_name", F.lit(" | "), percent(right, 0), F.lit(" | "), cell[0], F.lit(" | "), cell[1], F.lit(" |")).alias("line"))
    found = head.unionByName(whole).unionByName(table.select(F.lit(5).alias("n"), "line"))
    for i, trait in enumerate(traits):
        by = outcomes_.groupBy(trait).agg(F.concat(F.lit(f"By {trait}: "), F.col(trait).cast("string"), F.lit(" "), percent(right)).alias("line"))
        found = found.unionByName(by.select(F.lit(6 + i).alias("n"), "line"))
    return found
