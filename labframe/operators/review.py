"""Reviews: leases, corrections, re-validation of the final values, what blocks an approval, and what it leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labframe import schema
from labframe.operators import fold
from labframe.operators import pipeline as P
from labframe.operators import relational as R

CLAIM_MINUTES = 60


def lease_log(requests: DataFrame, minutes: int = CLAIM_MINUTES, status: str = "REVIEW_REQUIRED") -> DataFrame:
    """What each request comes to. ``requests`` has document_id, t (seconds), seq, user_id, admin, action (claim, heartbeat,
    release, approve, reject), reason. Result: document_id, seq, outcome, holder, status (both afterwards)."""
    class State(fold.Lease):
        def done(self):
            return None

    def step(s: State, t: int, seq: int, user, admin: bool, action: str, reason):
        return [(seq, s.answer(t, user, admin, action, reason), s.holder, s.status)]

    kind = dict(requests.dtypes)
    out = f"document_id {kind['document_id']}, seq {kind['seq']}, outcome string, holder {kind['user_id']}, status string"
    columns = ["t", "seq", "user_id", "admin", "action", "reason"]
    return fold.ordered_fold(requests, ["document_id"], ["t", "seq"], columns, lambda: State(status, minutes), step, out)


def real_changes(changes: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrections that change something, and those among them that are refused for want of a reason.

    ``changes``: field_id, seq, new_value, new_unit, reason. ``fields``: field_id, current_value, current_unit. Changes of one
    field are compared with what the one before left. A blank unit leaves the unit as it is.
    """
    unit = F.nullif(F.trim("new_unit"), F.lit(""))
    joined = changes.withColumn("new_unit", unit).join(fields, "field_id")
    by_seq = Window.partitionBy("field_id").orderBy("seq")
    value_before = F.when(F.row_number().over(by_seq) == 1, F.col("current_value")).otherwise(F.lag("new_value").over(by_seq))
    earlier = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    unit_before = F.coalesce(F.last("new_unit", ignorenulls=True).over(earlier), F.col("current_unit"))
    joined = joined.withColumns({"previous_value": value_before, "previous_unit": unit_before})
    unit_changed = F.col("new_unit").isNotNull() & ~F.col("new_unit").eqNullSafe(F.col("previous_unit"))
    real = joined.filter(~F.col("new_value").eqNullSafe(F.col("previous_value")) | unit_changed)
    real = real.withColumns({"new_unit": F.when(unit_changed, F.col("new_unit")), "previous_unit": F.when(unit_changed, F.col("previous_unit"))})
    named = F.trim(F.coalesce("reason", F.lit(""))) != ""
    kept = ["field_id", "seq", "previous_value", "new_value", "previous_unit", "new_unit", "reason"]
    return real.filter(named).select(*kept), real.filter(~named).select(*kept)


def final_values(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """``fields`` (field_id, value, unit and more) with value and unit as the changes leave them, and ``corrected``."""
    last = changes.groupBy("field_id").agg(
        F.max_by("new_value", "seq").alias("_value"), F.max_by("new_unit", F.when(F.col("new_unit").isNotNull(), F.col("seq"))).alias("_unit"), F.lit(True).alias("_hit"))
    joined = fields.join(last, "field_id", "left").withColumn("corrected", F.coalesce("_hit", F.lit(False)))
    return joined.withColumns({"value": F.when(F.col("corrected"), F.col("_value")).otherwise(F.col("value")), "unit": F.coalesce("_unit", "unit")}).drop("_value", "_unit", "_hit")


def revalidate(fields: DataFrame, changes: DataFrame, by: str, today: str | None = None) -> DataFrame:
    """The fields with their final values, validated anew: state, messages, ``was`` (the state before) and ``corrected``.

    ``fields``: by, field_id, field_name, FIELD, state, messages. What was found by looking at the page stands where the value
    is unchanged and nothing worse is found now.
    """
    now = final_values(fields.withColumnsRenamed({"state": "was", "messages": "messages_before"}), changes)
    keyed = now.select(by, "field_id", "field_name", "was", "messages_before", "corrected", F.struct(*P.FIELD).alias("f"))
    checked = P.check_dates(P.validate_each(P.in_context(now.select(by, "field_name", *P.FIELD), by), today), by)
    fresh = checked.select(by, "field_name", F.struct(*P.FIELD).alias("f"), "state", "messages", "normalized_value").dropDuplicates([by, "field_name", "f"])
    joined = keyed.join(fresh, (keyed[by] == fresh[by]) & (keyed["field_name"] == fresh["field_name"]) & keyed["f"].eqNullSafe(fresh["f"])).drop(fresh[by], fresh["field_name"], fresh["f"])
    stands = ~F.col("corrected") & F.col("state").isin("VALID", "OUTSIDE_REFERENCE_RANGE") & F.col("was").isin(schema.PAGE_CHECK_STATES)
    joined = joined.withColumns({"messages": F.when(stands, F.col("messages_before")).otherwise(F.col("messages")), "state": F.when(stands, F.col("was")).otherwise(F.col("state"))})
    return joined.select(by, "field_id", "field_name", "f.value", "f.unit", "state", "messages", "normalized_value", "was", "corrected")


def issue_kind() -> Column:
    """blocking: must be corrected; unseen: a warning that the reviewer hasn't seen; warning: seen before; null: none."""
    new = F.col("corrected") | ~F.col("state").eqNullSafe(F.col("was"))
    return F.when(F.col("state").isin(schema.BLOCKING_STATES), "blocking").when((F.col("state") != "VALID") & new, "unseen").when(F.col("state") != "VALID", "warning")


def approvals(validated: DataFrame, by: str, confirmed: DataFrame | None = None) -> DataFrame:
    """Per document: n_blocking, n_unseen, n_warnings, outcome. ``confirmed`` names the documents whose warnings were confirmed."""
    kind = issue_kind()
    agg = validated.groupBy(by).agg(F.count_if(kind == "blocking").alias("n_blocking"), F.count_if(kind == "unseen").alias("n_unseen"), F.count_if(kind.isin("unseen", "warning")).alias("n_warnings"))
    agg = agg.withColumn("ok", F.lit(False)) if confirmed is None else agg.join(confirmed.select(by, F.lit(True).alias("ok")).distinct(), by, "left")
    outcome = F.when(F.col("n_blocking") > 0, "UNRESOLVED_VALIDATION_ISSUES").when((F.col("n_unseen") > 0) & ~F.coalesce("ok", F.lit(False)), "UNCONFIRMED_WARNINGS").otherwise("HUMAN_APPROVED")
    return agg.select(by, "n_blocking", "n_unseen", "n_warnings", outcome.alias("outcome"))


def outcome_rows(changes: DataFrame, validated: DataFrame, approved: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """What an approval writes: one audit row per correction (FIELD_CORRECTED), and the new states of the fields."""
    fields = validated.join(approved.filter("outcome = 'HUMAN_APPROVED'").select(by), by, "left_semi")
    own = changes.join(fields.select("field_id", by, "field_name"), "field_id")
    before = F.to_json(F.struct(F.col("previous_value").alias("value"), F.col(by).alias("document_id"), "field_name"))
    after = F.to_json(F.struct(F.col("new_value").alias("value"), "reason", F.col("new_unit").alias("unit")))
    audit = own.select(F.lit("FIELD_CORRECTED").alias("action"), F.col("field_id").cast("string").alias("resource_id"), "seq", before.alias("before_state"), after.alias("after_state"))
    return audit, fields.select(by, "field_id", "field_name", "value", "unit", "normalized_value", "state", "messages", (F.col("state") == "VALID").alias("is_valid"))
