"""Jobs, purges, settings and accounts: what each event may change, as joins and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Who may do what.
MAY = {
    "view": ["ADMIN", "OPERATOR", "REVIEWER", "VIEWER"], "upload": ["ADMIN", "OPERATOR"], "export": ["ADMIN", "OPERATOR"], "reprocess": ["ADMIN", "OPERATOR"],
    "review": ["ADMIN", "REVIEWER"], "delete": ["ADMIN"], "users": ["ADMIN"], "settings": ["ADMIN"], "analytics": ["ADMIN"],
}
PERMANENT = ["DocumentError", "PermanentProviderError", "SchemaError"]


def stale(as_of: str, minutes: int) -> Column:
    return F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))


def pick_up(jobs: DataFrame, as_of: str, stale_minutes: int = 15) -> DataFrame:
    """``jobs`` with ``picked`` and the state that a worker leaves: waiting jobs and running ones that went stale are taken."""
    picked = F.col("status").isin("QUEUED", "RETRYING") | ((F.col("status") == "RUNNING") & stale(as_of, stale_minutes))
    return jobs.withColumn("picked", picked).withColumns({
        "status": F.when(F.col("picked"), "RUNNING").otherwise(F.col("status")),
        "updated_at": F.when(F.col("picked"), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at")),
    })


def kept_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results of jobs that still run; those of a job that another run finished or failed meanwhile are dropped, as are second
    results of one job: the earliest attempt's stay."""
    running = jobs.filter("status = 'RUNNING'").select("job_id")
    first = results.groupBy("job_id").agg(F.min("attempt").alias("attempt"))
    return results.join(first, ["job_id", "attempt"], "left_semi").join(running, "job_id", "left_semi")


def with_fallback(primary: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """Successes of the primary extractor, and the fallback's rows for all its failures, with their provenance.

    ``primary`` has ``by``, error (null: success) and its columns; ``fallback`` the same columns without error.
    """
    fine = primary.filter("error IS NULL").drop("error").withColumns({"extractor": F.lit("primary"), "fallback_reason": F.lit(None).cast("string")})
    lost = primary.filter("error IS NOT NULL").groupBy(by).agg(F.min("error").alias("fallback_reason"))
    return fine.unionByName(fallback.withColumn("extractor", F.lit("rule_based")).join(lost, by))


def retries(failures: DataFrame, base_seconds: int = 5, most: int = 3) -> DataFrame:
    """job_id, next_status, delay_seconds. ``failures``: job_id, attempt (from 0), error_type. Permanent errors fail at once."""
    again = (F.col("attempt") < most) & ~F.coalesce(F.col("error_type").isin(PERMANENT), F.lit(False))
    delay = F.when(again, (F.lit(base_seconds) * F.pow(F.lit(2), F.col("attempt"))).cast("long"))
    return failures.select("job_id", F.when(again, "RETRYING").otherwise("FAILED").alias("next_status"), delay.alias("delay_seconds"))


def reprocess(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, outcome, status: only failed documents are queued again. Unknown documents are not found."""
    joined = requests.join(docs.select("doc_id", "status"), "doc_id", "left")
    failed = F.col("status") == "FAILED"
    outcome = F.when(F.col("status").isNull(), "not found").when(failed, "queued").otherwise("refused")
    return joined.select("doc_id", outcome.alias("outcome"), F.when(failed, "UPLOADED").otherwise(F.col("status")).alias("status"))


def accept_uploads(uploads: DataFrame) -> DataFrame:
    """doc_id, first_id, accepted. An upload whose content stands in an earlier one is refused unless it allows duplicates.

    The earliest upload of a content is an aggregate joined back, so a content that everybody sends is no single task.
    """
    first = uploads.groupBy("content_hash").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("first_id"))
    joined = uploads.join(first, "content_hash")
    return joined.select("doc_id", "first_id", ((F.col("doc_id") == F.col("first_id")) | F.col("allow_duplicate")).alias("accepted"))


def purge(tables: dict[str, DataFrame], doomed: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The tables without the documents in ``doomed`` (document_id, reason) and all that hangs on them; the audit log stays, but
    its contents about them are redacted, and a DOCUMENT_DELETED event is added for each.

    ``tables``: documents, extractions, fields, corrections, reviews, jobs, audit (resource_type, resource_id, before_state,
    after_state, action, created_at).
    """
    ids = doomed.select("document_id").distinct()
    gone_extractions = tables["extractions"].join(ids, "document_id", "left_semi").select("extraction_id")
    gone_fields = tables["fields"].join(gone_extractions, "extraction_id", "left_semi").select("field_id")
    out = {name: tables[name].join(ids, "document_id", "left_anti") for name in ("documents", "extractions", "reviews", "jobs")}
    out["fields"] = tables["fields"].join(gone_extractions, "extraction_id", "left_anti")
    out["corrections"] = tables["corrections"].join(gone_fields, "field_id", "left_anti")
    named = ids.select(F.lit("document").alias("resource_type"), F.col("document_id").cast("string").alias("resource_id")).unionByName(
        gone_fields.select(F.lit("extracted_field").alias("resource_type"), F.col("field_id").cast("string").alias("resource_id")))
    audit = tables["audit"].join(named.withColumn("gone", F.lit(True)), ["resource_type", "resource_id"], "left")
    gone = F.coalesce("gone", F.lit(False))
    audit = audit.withColumns({"before_state": F.when(~gone, F.col("before_state")), "after_state": F.when(gone, '{"redacted":true}').otherwise(F.col("after_state"))}).drop("gone")
    events = doomed.dropDuplicates(["document_id"]).select(
        F.lit("DOCUMENT_DELETED").alias("action"), F.lit("document").alias("resource_type"), F.col("document_id").cast("string").alias("resource_id"),
        F.to_json(F.struct("reason")).alias("after_state"), F.lit(as_of).cast("timestamp").alias("created_at"))
    out["audit"] = audit.unionByName(events, allowMissingColumns=True)
    return out


def settings_after(current: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value: the last change of each key that is a share from 0 to 1, else what was there. ``changes``: key, value, seq."""
    good = changes.filter((F.col("value") >= 0) & (F.col("value") <= 1)).groupBy("key").agg(F.max_by("value", "seq").alias("new"))
    return current.join(good, "key", "full_outer").select("key", F.coalesce("new", "value").alias("value"))


def account_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """user_id, outcome. ``changes``: user_id, actor_id, new_role, new_active. The actor must be an active admin and may not take
    away their own role or account, so an admin remains."""
    actor = users.select(F.col("user_id").alias("actor_id"), ((F.col("role") == "ADMIN") & F.col("active")).alias("actor_ok"))
    own = F.col("user_id") == F.col("actor_id")
    lowers = (F.col("new_role") != "ADMIN") | ~F.col("new_active")
    outcome = F.when(~F.coalesce("actor_ok", F.lit(False)), "forbidden").when(own & lowers, "refused").otherwise("changed")
    return changes.join(actor, "actor_id", "left").select("user_id", outcome.alias("outcome"))


def allowed(role: Column, action: str) -> Column:
    return F.coalesce(role.isin(MAY[action]), F.lit(False))


def visible_audit(audit: DataFrame, role: str, resource_id: str | None = None) -> DataFrame:
    """The whole log for admins, one document's log for any role; else nothing."""
    if resource_id is not None:
        return audit.filter(F.col("resource_id") == resource_id)
    return audit if role == "ADMIN" else audit.limit(0)


def consented(docs: DataFrame, provider: str, consent: bool) -> DataFrame:
    """Documents may go to an external provider only with consent."""
    return docs if provider == "rule_based" or consent else docs.limit(0)


def replace_rows(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The target with the given rows in the place of those that bear their keys."""
    return target.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def append_audit(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with the events that it doesn't hold yet, so a batch that is written again adds nothing."""
    return log.unionByName(events.dropDuplicates(["audit_id"]).join(log.select("audit_id"), "audit_id", "left_anti").select(*log.columns))
