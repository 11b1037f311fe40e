"""The registered queries of the lab-report engine and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe import schema
from labframe.functions import dates as D
from labframe.functions import numbers as N
from labframe.functions import text as X
from labframe.operators import relational as R
from labframe.operators import validate as V
from labframe.plans.fixtures import duck, view
from labframe.registry import DECIDED as _DECIDED
from labframe.registry import QUERIES, SQL, query
from labframe.streaming import ordered as O
from labframe.streaming import streams as T

AS_OF = "2024-01-31"


# The numeric decision in SQL, on the derived fields ---------------------------------------------------------------------

def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return V.decide_numbers(view(spark, sf, "rpt_fields"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return V.score(V.flag_mismatch(_decided(spark, sf)))


@query(_DECIDED + "SELECT event_id, state, normalized::DOUBLE AS normalized, lower::DOUBLE AS lower, upper::DOUBLE AS upper, direction, basis FROM decided")
def q_num_decision(spark, sf):
    return _decided(spark, sf).select("event_id", "state", *[F.col(c).cast("double").alias(c) for c in ("normalized", "lower", "upper")], "direction", "basis")


@query(_DECIDED + "SELECT field_name, state, count(*) AS n FROM decided GROUP BY ALL")
def q_num_state_counts(spark, sf):
    return _decided(spark, sf).groupBy("field_name", "state").agg(F.count("*").alias("n"))


@query(_DECIDED + "SELECT event_id, state, conf, category, state = 'VALID' AS is_valid FROM cat")
def q_confidence_decision(spark, sf):
    return _scored(spark, sf).select("event_id", "state", "conf", "category", "is_valid")


_REPORT = """SELECT report_id, round(avg(conf), 6) AS overall_confidence,
  CASE WHEN bool_and(state IN ({fine}) AND category = 'HIGH') AND avg(conf) >= 0.9 THEN 'AUTO_ACCEPTED' ELSE 'REVIEW_REQUIRED' END AS decision FROM cat GROUP BY report_id"""


@query(_DECIDED + _REPORT.format(fine="'VALID', 'OUTSIDE_REFERENCE_RANGE'"))
def q_overall_by_report(spark, sf):
    return V.decide_reports(_scored(spark, sf))


@query(_DECIDED + _REPORT.format(fine="'VALID'"))
def q_policy_abnormal_hold(spark, sf):
    return V.decide_reports(_scored(spark, sf), hold_abnormal=True)


@query(_DECIDED + "SELECT report_id, field_name, abnormal_flag, direction FROM flagged WHERE state = 'FLAG_MISMATCH'")
def q_flag_mismatch(spark, sf):
    return V.flag_mismatch(_decided(spark, sf)).filter("state = 'FLAG_MISMATCH'").select("report_id", "field_name", "abnormal_flag", "direction")


@query(duck("rpt_fields") + f"""
SELECT r.report_id, m.field_name FROM (SELECT DISTINCT report_id FROM rpt_fields) r CROSS JOIN (SELECT unnest({schema.MANDATORY_FIELDS}) AS field_name) m
WHERE NOT EXISTS (SELECT 1 FROM rpt_fields f WHERE f.report_id = r.report_id AND f.field_name = m.field_name AND f.value IS NOT NULL)""")
def q_missing_fields(spark, sf):
    fields = view(spark, sf, "rpt_fields").withColumn("field_name", F.when(F.col("value").isNotNull(), F.col("field_name")))
    return V.add_missing(fields, schema.MANDATORY_FIELDS)


@query(_DECIDED + r"SELECT event_id, raw::DOUBLE AS raw, scale::DOUBLE AS scale, regexp_replace(normalized::DECIMAL(18,3)::VARCHAR, '\.?0+$', '') AS shown FROM n3")
def q_unit_convert(spark, sf):
    d = _decided(spark, sf)
    return d.select("event_id", F.col("raw").cast("double").alias("raw"), F.col("scale").cast("double").alias("scale"), N.format_number(F.col("normalized")).alias("shown"))


@query(duck("rpt_fields") + r"""SELECT event_id, regexp_extract(reference_range, '^([0-9.]+)', 1)::DOUBLE AS lower, regexp_extract(reference_range, '([0-9.]+)$', 1)::DOUBLE AS upper
FROM rpt_fields WHERE reference_range IS NOT NULL""")
def q_printed_range_parse(spark, sf):
    r = N.printed_range(F.col("reference_range"))
    return view(spark, sf, "rpt_fields").filter("reference_range is not null").select("event_id", r["lower"].cast("double").alias("lower"), r["upper"].cast("double").alias("upper"))


@query(_DECIDED + "SELECT event_id, value, raw::DOUBLE AS parsed FROM n1")
def q_numeric_parse(spark, sf):
    return view(spark, sf, "rpt_fields").select("event_id", "value", N.parse_number(F.col("value")).cast("double").alias("parsed"))


# Dates ------------------------------------------------------------------------------------------------------------------

@query(duck("rpt_dates") + """SELECT o_orderkey, printed, CAST(CASE o_orderkey % 6 WHEN 1 THEN collected
  WHEN 2 THEN CASE WHEN day(collected) <= 12 THEN make_date(year(collected), day(collected), month(collected)) ELSE collected END ELSE collected END AS VARCHAR) AS parsed FROM rpt_dates""")
def q_date_parse(spark, sf):
    return view(spark, sf, "rpt_dates").select("o_orderkey", "printed", F.date_format(D.parse_date(F.col("printed"), F.lit("MDY")), "yyyy-MM-dd").alias("parsed"))


@query(duck("rpt_dates") + """SELECT o_orderkey, o_orderkey % 6 IN (1, 2) AND day(collected) <= 12 AND day(collected) <> month(collected) AS ambiguous FROM rpt_dates""")
def q_ambiguous_date(spark, sf):
    return view(spark, sf, "rpt_dates").select("o_orderkey", D.is_ambiguous(F.col("printed")).alias("ambiguous"))


@query(duck("rpt_dates") + """, v AS (SELECT o_custkey, CASE WHEN day(collected) > 12 THEN CASE o_orderkey % 6 WHEN 1 THEN 'MDY' WHEN 2 THEN 'DMY' END END AS vote FROM rpt_dates)
SELECT o_custkey, CASE WHEN count(DISTINCT vote) = 1 THEN min(vote) ELSE 'MDY' END AS date_order FROM v GROUP BY o_custkey""")
def q_date_order_vote(spark, sf):
    return view(spark, sf, "rpt_dates").groupBy("o_custkey").agg(D.document_order(D.order_vote(F.col("printed"))).alias("date_order"))


@query(duck("rpt_dates") + """SELECT o_orderkey, CASE WHEN a >= 0 THEN a END AS age FROM (
  SELECT o_orderkey, CAST(year(collected) - year(dob) - CASE WHEN month(collected) * 100 + day(collected) < month(dob) * 100 + day(dob) THEN 1 ELSE 0 END AS INT) AS a FROM rpt_dates)""")
def q_age(spark, sf):
    return view(spark, sf, "rpt_dates").select("o_orderkey", D.age_in_years(F.col("dob"), F.col("collected")).alias("age"))


@query(duck("rpt_dates") + """SELECT o_orderkey, CASE WHEN collected < dob THEN 'Collection date is before date of birth' END AS collection_problem,
  CASE WHEN received < collected THEN 'Received date is before collection date' WHEN received < dob THEN 'Received date is before date of birth' END AS received_problem FROM rpt_dates""")
def q_date_consistency(spark, sf):
    c, r = D.date_problem(F.col("dob"), F.col("collected"), F.col("received"))
    return view(spark, sf, "rpt_dates").select("o_orderkey", c.alias("collection_problem"), r.alias("received_problem"))


@query(duck("rpt_dates") + f"SELECT CASE WHEN collected > DATE '1995-01-01' THEN 'IMPLAUSIBLE_VALUE' ELSE 'VALID' END AS state, count(*) AS n FROM rpt_dates GROUP BY 1")
def q_date_state(spark, sf):
    return view(spark, sf, "rpt_dates").groupBy(D.date_state(F.col("collected"), F.lit("1995-01-01").cast("date")).alias("state")).agg(F.count("*").alias("n"))


# Extraction from text -----------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, regexp_matches(c_name, '[0-9]') AS misread, upper(regexp_replace(lower(c_name), '[^0-9a-z]+', '', 'g')) AS squashed FROM customer")
def q_name_misread(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", X.name_misread(F.col("c_name")).alias("misread"), F.upper(X.squash(F.col("c_name"))).alias("squashed"))


# Catalogue ------------------------------------------------------------------------------------------------------------------

_CAT = duck("doc_catalog")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "doc_catalog")


@query(_CAT + "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content_hash ORDER BY created_at, doc_id) AS first_id, count(*) OVER (PARTITION BY content_hash) AS copies FROM doc_catalog")
def q_dup_documents(spark, sf):
    return R.duplicates(_docs(spark, sf))


@query(_CAT + "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY content_hash) AS first_id FROM doc_catalog) WHERE doc_id <> first_id")
def q_dup_refusals(spark, sf):
    return R.duplicates(_docs(spark, sf)).filter("doc_id <> first_id").select("doc_id", "first_id")


@query(_CAT + "SELECT doc_id, filename, created_at FROM doc_catalog ORDER BY created_at DESC, doc_id LIMIT 20 OFFSET 20")
def q_list_newest(spark, sf):
    return R.page(_docs(spark, sf), [F.col("created_at").desc(), F.col("doc_id")], 2, 20).select("doc_id", "filename", "created_at")


@query(_CAT + "SELECT doc_id, filename, created_at FROM doc_catalog ORDER BY created_at, doc_id LIMIT 20")
def q_list_oldest(spark, sf):
    return R.page(_docs(spark, sf), [F.col("created_at"), F.col("doc_id")], 1, 20).select("doc_id", "filename", "created_at")


@query(_CAT + "SELECT doc_id, attention, created_at FROM doc_catalog WHERE status = 'REVIEW_REQUIRED' ORDER BY attention DESC, created_at, doc_id LIMIT 25")
def q_list_priority(spark, sf):
    return R.page(_docs(spark, sf).filter("status = 'REVIEW_REQUIRED'"), R.priority(), 1, 25).select("doc_id", "attention", "created_at")


@query(_CAT + "SELECT status, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM doc_catalog GROUP BY status")
def q_page_total(spark, sf):
    return _docs(spark, sf).groupBy("status").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("pages"))


@query(_CAT + "SELECT doc_id, filename FROM doc_catalog WHERE contains(lower(filename), 'c1_1')")
def q_search_literal(spark, sf):
    return R.search(_docs(spark, sf), "C1_1").select("doc_id", "filename")


@query(duck("doc_catalog", "corrections") + "SELECT doc_id, filename FROM doc_catalog d WHERE contains(lower(filename), 'src3_') OR EXISTS (SELECT 1 FROM corrections c WHERE c.field_id = d.doc_id AND contains(lower(new_value), 'the'))")
def q_search_or_exists(spark, sf):
    return R.search_with_corrections(_docs(spark, sf), view(spark, sf, "corrections"), "the") .select("doc_id", "filename").unionByName(
        R.search(_docs(spark, sf), "src3_").select("doc_id", "filename")).distinct()


@query(_CAT + "SELECT doc_id, status, created_at FROM doc_catalog WHERE status IN ('REVIEW_REQUIRED', 'FAILED') AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-10'")
def q_status_in_time_range(spark, sf):
    return R.in_time(_docs(spark, sf).filter(F.col("status").isin("REVIEW_REQUIRED", "FAILED")), "2024-01-03", "2024-01-10").select("doc_id", "status", "created_at")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n = 1")
def q_latest_extraction(spark, sf):
    return R.latest(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", ["turn", "role"]).select("conv_id", "turn", "role")


@query(duck("corrections") + "SELECT field_id, arg_max(new_value, seq) AS current_value, count(*) AS n FROM corrections WHERE seq > 0 GROUP BY field_id")
def q_current_value(spark, sf):
    return R.current_values(view(spark, sf, "corrections")).select("field_id", "current_value", "n")


@query(duck("corrections") + "SELECT field_id, arg_max(new_unit, seq) FILTER (new_unit IS NOT NULL) AS current_unit FROM corrections WHERE seq > 0 GROUP BY field_id")
def q_current_unit(spark, sf):
    return R.current_values(view(spark, sf, "corrections")).select("field_id", "current_unit")


@query(duck("corrections") + "SELECT p.field_id, p.v AS new_value FROM (SELECT field_id, arg_max(new_value, seq) AS v FROM corrections WHERE reason = 'user' GROUP BY field_id) p LEFT JOIN (SELECT field_id, arg_max(new_value, seq) AS c FROM corrections WHERE seq > 0 GROUP BY field_id) q USING (field_id) WHERE p.v IS DISTINCT FROM q.c")
def q_pending_corrections(spark, sf):
    c = view(spark, sf, "corrections")
    return R.pending_corrections(c.filter("reason = 'user'"), R.current_values(c)).select("field_id", "new_value")


@query(duck("corrections", "doc_catalog") + "SELECT field_id, seq FROM corrections WHERE field_id NOT IN (SELECT doc_id FROM doc_catalog WHERE doc_id % 3 = 0)")
def q_foreign_corrections(spark, sf):
    own = _docs(spark, sf).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("field_id"))
    return R.foreign_corrections(view(spark, sf, "corrections"), own).select("field_id", "seq")


_SHOWN = r"coalesce(regexp_replace(normalized::DECIMAL(18,3)::VARCHAR, '\.?0+$', ''), value)"
_UNIT = "CASE field_name WHEN 'glucose' THEN 'mg/dL' WHEN 'hemoglobin' THEN 'g/dL' WHEN 'hematocrit' THEN '%' ELSE 'x10^3/uL' END"


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+@\t\r]') OR (starts_with(t, '-') AND try_cast(t AS DOUBLE) IS NULL) THEN '''' || t ELSE t END AS cell
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '-1' WHEN 3 THEN '@' WHEN 4 THEN '+' ELSE '' END || CASE WHEN doc_id % 6 = 2 THEN '' ELSE lang END AS t FROM documents)""")
def q_export_cells(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "concat(case doc_id % 6 when 0 then '=' when 1 then '-' when 2 then '-1' when 3 then '@' when 4 then '+' else '' end, case when doc_id % 6 = 2 then '' else lang end) as t")
    return d.select("doc_id", X.csv_cell(F.col("t")).alias("cell"))


# Metrics ----------------------------------------------------------------------------------------------------------------------

@query(_CAT + "SELECT count(*) AS n_total, count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-05') AS n_today, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in schema.DOCUMENT_STATUSES) + " FROM doc_catalog")
def q_dashboard(spark, sf):
    return R.dashboard(_docs(spark, sf), "2024-01-05")


@query(_CAT + "SELECT status, coalesce(doc_type, 'Unknown') AS doc_type, count(*) AS n FROM doc_catalog GROUP BY ALL")
def q_status_dist(spark, sf):
    return _docs(spark, sf).groupBy("status", F.coalesce("doc_type", F.lit("Unknown")).alias("doc_type")).agg(F.count("*").alias("n"))


@query(_CAT + "SELECT CASE WHEN overall_confidence >= 0.9 THEN '>=90%' WHEN overall_confidence >= 0.7 THEN '70-90%' WHEN overall_confidence >= 0.5 THEN '50-70%' ELSE '<50%' END AS bucket, count(*) AS n FROM doc_catalog GROUP BY 1")
def q_conf_buckets(spark, sf):
    return _docs(spark, sf).groupBy(R.confidence_bucket(F.col("overall_confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query(duck("doc_catalog", "corrections") + """, f AS (SELECT count(*) AS done, count(*) FILTER (EXISTS (SELECT 1 FROM corrections c WHERE c.field_id = d.doc_id AND c.seq > 0)) AS corrected
FROM doc_catalog d WHERE status = 'HUMAN_APPROVED') SELECT done, corrected, CASE WHEN done > 0 THEN round(corrected / done, 6) ELSE 0.0 END AS rate FROM f""")
def q_correction_rate(spark, sf):
    corrected = view(spark, sf, "corrections").filter("seq > 0").select(F.col("field_id").alias("doc_id"), F.lit(1).alias("hit")).distinct()
    done = _docs(spark, sf).filter("status = 'HUMAN_APPROVED'").join(corrected, "doc_id", "left").agg(F.count("*").alias("done"), F.count("hit").alias("corrected"))
    return done.select("done", "corrected", F.when(F.col("done") > 0, F.round(F.col("corrected") / F.col("done"), 6)).otherwise(0.0).alias("rate"))


@query(_CAT + f", s AS (SELECT unnest({schema.DOCUMENT_STATUSES}) AS status) SELECT s.status, count(d.doc_id) AS n FROM s LEFT JOIN (SELECT * FROM doc_catalog WHERE doc_id % 8 < 6) d USING (status) GROUP BY 1")
def q_gauges_zero_filled(spark, sf):
    return R.zero_filled(_docs(spark, sf).filter("doc_id % 8 < 6"))


@query(_CAT + f"SELECT CAST(coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(min(created_at)), 0) AS BIGINT) AS oldest_seconds FROM doc_catalog WHERE status = 'REVIEW_REQUIRED'")
def q_oldest_pending(spark, sf):
    age = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.min("created_at"))
    return _docs(spark, sf).filter("status = 'REVIEW_REQUIRED'").agg(F.coalesce(age, F.lit(0)).alias("oldest_seconds"))


@query(duck("audit") + "SELECT audit_id, action, user_id, created_at FROM audit ORDER BY created_at DESC, audit_id DESC LIMIT 50 OFFSET 50")
def q_audit_page(spark, sf):
    return R.page(view(spark, sf, "audit"), [F.col("created_at").desc(), F.col("audit_id").desc()], 2, 50).select("audit_id", "action", "user_id", "created_at")


@query(duck("audit") + "SELECT audit_id, action, created_at FROM audit WHERE json_extract_string(before_state, '$.k') = '7'")
def q_audit_doc_history(spark, sf):
    return view(spark, sf, "audit").filter(F.get_json_object("before_state", "$.k") == "7").select("audit_id", "action", "created_at")


@query("SELECT event_type, count(*) FILTER (json_type(props) = 'OBJECT') AS n_objects FROM events GROUP BY event_type")
def q_json_object_count(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy("event_type").agg(F.count_if(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT")).alias("n_objects"))


@query(duck("jobs") + f"""SELECT job_id, was, recovery_count, CASE WHEN recovery_count > 2 THEN 'FAILED' ELSE 'QUEUED' END AS status FROM (
  SELECT job_id, status AS was, recovery_count + CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END AS recovery_count FROM jobs
  WHERE status IN ('QUEUED', 'RETRYING', 'RUNNING') AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE ORDER BY updated_at, job_id LIMIT 100)""")
def q_stuck_sweep(spark, sf):
    return R.stuck_jobs(view(spark, sf, "jobs"), AS_OF)


@query(duck("jobs") + "SELECT job_id, CASE WHEN recovery_count < 3 THEN CAST(5 * pow(2, recovery_count) AS BIGINT) END AS delay_seconds, CASE WHEN recovery_count < 3 THEN 'RETRYING' ELSE 'FAILED' END AS next_status FROM jobs WHERE status = 'RETRYING'")
def q_retry_schedule(spark, sf):
    return R.retry_schedule(view(spark, sf, "jobs").filter("status = 'RETRYING'"))


@query(_CAT + f"SELECT doc_id, status FROM doc_catalog WHERE NOT (status IN ('AUTO_ACCEPTED', 'HUMAN_APPROVED', 'HUMAN_REJECTED', 'FAILED') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY)")
def q_retention_survivors(spark, sf):
    return R.retained(_docs(spark, sf), AS_OF, 20).select("doc_id", "status")


@query(duck("audit") + """SELECT audit_id, action, resource_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE before_state END AS before_state, CASE WHEN user_id % 5 = 0 THEN '{"redacted":true}' END AS after_state FROM audit""")
def q_redacted_audit(spark, sf):
    audit = view(spark, sf, "audit")
    return R.redact(audit, audit.filter("user_id % 5 = 0").select("resource_id"))


_GREEDY = """WITH RECURSIVE e AS (SELECT {key} AS k, epoch(date_trunc('second', ts))::BIGINT AS t, row_number() OVER (PARTITION BY {key} ORDER BY epoch(date_trunc('second', ts)), event_id) AS i FROM events {where}),
r AS (
  SELECT k, i, [t] AS last, 1::BIGINT AS n FROM e WHERE i = 1
  UNION ALL
  SELECT e.k, e.i, CASE WHEN len(list_filter(r.last, lambda x: x {op} e.t - {window})) >= {limit} THEN r.last ELSE list_append(r.last, e.t) END,
         CASE WHEN len(list_filter(r.last, lambda x: x {op} e.t - {window})) >= {limit} THEN r.n ELSE r.n + 1 END
  FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1
)
SELECT k AS user_id, max(i) AS n_events, max(n) AS n_allowed FROM r GROUP BY k"""


@query(_GREEDY.format(key="user_id", where="WHERE event_type = 'view'", op=">=", window=86400, limit=1))
def q_view_throttle(spark, sf):
    views = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'view'")
    return R.greedy(views, ["user_id"], 86400, 1, inclusive=True)


@query(_GREEDY.format(key="user_id", where="", op=">", window=86400, limit=2))
def q_rate_limit(spark, sf):
    return R.greedy(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], 86400, 2, inclusive=False)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS t, event_type = 'error' AS bad,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS i FROM events WHERE event_type IN ('error', 'signup')),
r AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS fails, 0::BIGINT AS until, 0::BIGINT AS locks, 0::BIGINT AS refused FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, CASE WHEN e.t < r.until THEN r.fails WHEN NOT e.bad OR r.fails + 1 >= 3 THEN 0 ELSE r.fails + 1 END,
    CASE WHEN e.t < r.until THEN r.until WHEN e.bad AND r.fails + 1 >= 3 THEN e.t + 86400 ELSE 0 END,
    r.locks + CASE WHEN e.t >= r.until AND e.bad AND r.fails + 1 >= 3 THEN 1 ELSE 0 END, r.refused + CASE WHEN e.t < r.until THEN 1 ELSE 0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
)
SELECT user_id, max(locks) AS n_locks, max(refused) AS n_refused FROM r GROUP BY user_id""")
def q_lockout(spark, sf):
    return R.lockouts(spark.read.parquet(f"{sf}/events.parquet"), failures=3, minutes=1440)


@query(duck("jobs") + f"SELECT job_id, updated_at FROM jobs WHERE status = 'RUNNING' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE")
def q_claim_expiry(spark, sf):
    claims = view(spark, sf, "jobs").filter("status = 'RUNNING'").withColumn("created_at", F.col("updated_at"))
    return R.expired_claims(claims, AS_OF).select("job_id", "updated_at")


@query(duck("boxes") + 'SELECT label, min(x) AS "left", min(y) AS top, least(max(x + w), 1000) AS "right", least(max(y + h), 1000) AS bottom, round(avg(confidence), 6) AS confidence FROM boxes GROUP BY label')
def q_bbox_union(spark, sf):
    return R.box_union(view(spark, sf, "boxes"))


@query(duck("boxes") + "SELECT label, vec_id, page, confidence FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, page, vec_id) AS n FROM boxes) WHERE n = 1")
def q_best_by_page(spark, sf):
    return R.best_by(view(spark, sf, "boxes"), "label")


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def q_nested_documents(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    nested = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "lines")).alias("orders"))
    c = spark.read.parquet(f"{sf}/customer.parquet").join(nested, F.col("o_custkey") == F.col("c_custkey"), "left")
    n_lines = F.aggregate("orders", F.lit(0), lambda a, o: a + F.coalesce(F.size(o["lines"]), F.lit(0)))
    return c.select("c_custkey", F.coalesce(F.size(F.col("orders")), F.lit(0)).cast("long").alias("n_orders"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"))


# Evaluation --------------------------------------------------------------------------------------------------------------------

@query(duck("eval_rows") + "SELECT lang, outcome, count(*) AS n FROM eval_rows GROUP BY ALL")
def q_eval_outcomes(spark, sf):
    return view(spark, sf, "eval_rows").groupBy("lang", "outcome").agg(F.count("*").alias("n"))


@query(duck("eval_rows") + "SELECT count(*) FILTER (accepted) AS n_accepted, round(count(*) FILTER (accepted AND outcome = 'correct') / nullif(count(*) FILTER (accepted), 0), 6) AS precision_accepted, round(avg(CAST(accepted AS INT)), 6) AS share_accepted FROM eval_rows")
def q_eval_precision(spark, sf):
    accepted = F.count_if("accepted")
    return view(spark, sf, "eval_rows").agg(
        accepted.alias("n_accepted"), F.round(F.try_divide(F.count_if(F.col("accepted") & (F.col("outcome") == "correct")), accepted), 6).alias("precision_accepted"),
        F.round(F.avg(F.col("accepted").cast("int")), 6).alias("share_accepted"))


@query(duck("eval_rows") + "SELECT source, count(*) FILTER (outcome = 'correct') AS n_correct, count(*) FILTER (outcome = 'wrong') AS n_wrong, count(*) FILTER (outcome = 'missing') AS n_missing, round(count(*) FILTER (outcome = 'correct') / count(*), 6) AS accuracy FROM eval_rows GROUP BY source")
def q_eval_by_trait(spark, sf):
    return R.outcomes(view(spark, sf, "eval_rows"), "source")


# Layout, sources and streams -----------------------------------------------------------------------------------------------------

@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def q_stream_first_uploads(spark, sf):
    return T.first_uploads(spark, sf)


@query(_GREEDY.format(key="user_id", where="WHERE event_type = 'view'", op=">=", window=86400, limit=1).replace("max(i) AS n_events, ", ""))
def q_stream_view_throttle(spark, sf):
    folder = T.folder(spark, "views")
    views = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'view'").select("user_id", F.unix_timestamp("ts").alias("t"), "event_id")
    late = "21600 seconds"
    stream = O.allowed_stream(O.arrivals(views, "t", "event_id", f"{folder}/in", 21600, 5), ["user_id"], "event_id", 86400, 1, True, late)
    with O.rocks_state(spark, spark.sparkContext.defaultParallelism):
        stored = O.write_once(stream, folder)
    return stored.filter("event_id IS NOT NULL").groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def q_stream_daily_counts(spark, sf):
    return T.daily_counts(spark, sf)


from labframe import queries_flow  # noqa: E402, F401  registers its queries
