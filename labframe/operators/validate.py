"""Validation of result fields and the decision per report. One shuffle by report serves all cross-field steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labframe import schema
from labframe.functions import numbers as N
from labframe.functions.text import normalize_flag


def decide_numbers(fields: DataFrame) -> DataFrame:
    """Adds state, normalized (decimal), lower, upper, direction, basis. The order of the ``when`` branches is the rule."""
    field = F.col("field_name")
    df = fields.withColumns({"raw": N.parse_number(F.col("value")), "unit_norm": N.normalize_unit(F.col("unit"))})
    df = df.withColumn("factor", F.when(F.col("unit_norm").isNotNull(), N.unit_factor(field, F.col("unit_norm"))))
    no_unit = F.col("unit_norm").isNull()
    raw_count = no_unit & field.isin(N.COUNTS) & (F.col("raw") >= N.RAW_COUNT)
    df = df.withColumn("scale", F.when(raw_count, F.lit("0.001").cast(N.DEC)).when(no_unit, F.lit(1).cast(N.DEC)).otherwise(F.col("factor")))
    df = df.withColumn("normalized", F.round(F.col("raw") * F.coalesce("scale", F.lit(1).cast(N.DEC)), 6).cast(N.DEC))
    lo, hi = N.plausible(field)
    printed = N.printed_range(F.col("reference_range"))
    blo, bhi = N.builtin_range(field, F.col("sex"), F.col("age"))
    df = df.withColumns({"printed": printed, "p_lo": lo, "p_hi": hi, "b_lo": blo, "b_hi": bhi})
    from_report = F.col("printed").isNotNull()
    scaled = {k: F.round(F.col(f"printed.{k}") * F.col("scale"), 3).cast(N.DEC) for k in ("lower", "upper")}
    df = df.withColumns({
        "lower": F.when(from_report, scaled["lower"]).otherwise(F.col("b_lo")), "upper": F.when(from_report, scaled["upper"]).otherwise(F.col("b_hi")),
        "basis": F.when(from_report, "report").when(F.col("b_lo").isNotNull(), "adult"),
    })
    n, lower, upper = F.col("normalized"), F.col("lower"), F.col("upper")
    direction = F.when(n > upper, "H").when(n < lower, "L")
    far = F.coalesce((upper != 0) & (n > upper * N.FAR_FACTOR), F.lit(False)) | F.coalesce((lower != 0) & (n * N.FAR_FACTOR < lower), F.lit(False))
    state = (
        F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "MISSING")
        .when(F.col("raw").isNull(), "INVALID_FORMAT")
        .when(~no_unit & F.col("factor").isNull(), "UNRECOGNIZED_UNIT")
        .when(no_unit & field.isin(N.UNIT_REQUIRED), "UNRECOGNIZED_UNIT")
        .when((n < F.col("p_lo")) | (n > F.col("p_hi")), "EXTREME_VALUE")
        .when(F.col("basis").isNull(), "NO_REFERENCE_RANGE")
        .when(far, "EXTREME_VALUE")
        .when(direction.isNotNull() | normalize_flag(F.col("abnormal_flag")).isNotNull(), "OUTSIDE_REFERENCE_RANGE")
        .otherwise("VALID")
    )
    out = df.withColumns({"state": state, "direction": direction})
    return out.drop("unit_norm", "factor", "printed", "p_lo", "p_hi", "b_lo", "b_hi")


def flag_mismatch(decided: DataFrame, by: str = "report_id") -> DataFrame:
    """On reports that print any flag, a flag that contradicts the value read makes the field FLAG_MISMATCH."""
    printed = normalize_flag(F.col("abnormal_flag"))
    any_flag = F.max(F.coalesce(F.col("abnormal_flag"), F.lit("")) != "").over(Window.partitionBy(by))
    report = ~printed.eqNullSafe(F.col("direction"))
    builtin = printed.isNotNull() & F.col("direction").isNotNull() & (printed != F.col("direction"))
    wrong = F.when(F.col("basis") == "report", report).otherwise(builtin)
    checked = F.col("state").isin("VALID", "OUTSIDE_REFERENCE_RANGE") & any_flag & F.coalesce(wrong, F.lit(False))
    return decided.withColumn("state", F.when(checked, "FLAG_MISMATCH").otherwise(F.col("state")))


def score(decided: DataFrame) -> DataFrame:
    conf = N.field_confidence(F.col("confidence").cast("double"), F.col("state"))
    return decided.withColumn("conf", conf).withColumn("category", N.confidence_category(F.col("conf"))).withColumn("is_valid", F.col("state") == "VALID")


def add_missing(fields: DataFrame, wanted: list[str], by: str = "report_id") -> DataFrame:
    """Rows (by, field_name) of wanted fields that a report lacks: from one pass over the reports, without a cross join."""
    have = fields.groupBy(by).agg(F.collect_set("field_name").alias("have"))
    absent = F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col("have"))
    return have.select(by, F.explode(absent).alias("field_name"))


def decide_reports(scored: DataFrame, by: str = "report_id", auto_accept: float = 0.9, hold_abnormal: bool = False, more: list[Column] | None = None) -> DataFrame:
    """Per report: overall_confidence, decision, and ``more`` aggregates with names, all in one pass."""
    fine = ["VALID"] if hold_abnormal else ["VALID", "OUTSIDE_REFERENCE_RANGE"]
    ok = F.col("state").isin(fine) & (F.col("category") != "LOW") & (~F.col("field_name").isin(schema.CRITICAL_FIELDS) | (F.col("category") == "HIGH"))
    agg = scored.groupBy(by).agg(F.bool_and(ok).alias("fields_ok"), F.coalesce(F.round(F.avg("conf"), 6), F.lit(0.0)).alias("overall_confidence"), *(more or []))
    accepted = F.col("fields_ok") & (F.col("overall_confidence") >= auto_accept)
    return agg.select(by, "overall_confidence", F.when(accepted, "AUTO_ACCEPTED").otherwise("REVIEW_REQUIRED").alias("decision"), *agg.columns[3:])
