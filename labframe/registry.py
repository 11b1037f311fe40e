"""Where queries are registered, and the SQL of the numeric decision that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labframe.plans.fixtures import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The numeric decision on the derived fields, as CTEs.
DECIDED = duck("rpt_fields") + r""", n1 AS (
  SELECT *, try_cast(nullif(regexp_extract(value, '-?[0-9]+(\.[0-9]+)?'), '') AS DECIMAL(18,6)) AS raw,
    CASE field_name WHEN 'glucose' THEN CASE unit WHEN 'mg/dL' THEN 1 WHEN 'mmol/L' THEN 18.016 END WHEN 'hemoglobin' THEN CASE unit WHEN 'g/dL' THEN 1 WHEN 'g/L' THEN 0.1 END
      WHEN 'hematocrit' THEN CASE unit WHEN '%' THEN 1 WHEN 'L/L' THEN 100 END ELSE CASE unit WHEN 'x10^3/uL' THEN 1 WHEN '/uL' THEN 0.001 END END::DECIMAL(9,6) AS factor,
    CASE field_name WHEN 'glucose' THEN 10 WHEN 'hemoglobin' THEN 2 WHEN 'hematocrit' THEN 5 WHEN 'white_blood_cell_count' THEN 0.01 ELSE 1 END AS p_lo,
    CASE field_name WHEN 'glucose' THEN 2000 WHEN 'hemoglobin' THEN 25 WHEN 'hematocrit' THEN 75 WHEN 'white_blood_cell_count' THEN 1000 ELSE 3000 END AS p_hi,
    CASE WHEN age < 18 THEN NULL ELSE CASE field_name WHEN 'glucose' THEN 70 WHEN 'hemoglobin' THEN CASE sex WHEN 'M' THEN 13.5 ELSE 12 END
      WHEN 'hematocrit' THEN CASE sex WHEN 'M' THEN 41 ELSE 36 END WHEN 'white_blood_cell_count' THEN 4.5 ELSE 150 END END AS b_lo,
    CASE WHEN age < 18 THEN NULL ELSE CASE field_name WHEN 'glucose' THEN 100 WHEN 'hemoglobin' THEN CASE sex WHEN 'F' THEN 15.5 ELSE 17.5 END
      WHEN 'hematocrit' THEN CASE sex WHEN 'F' THEN 44 ELSE 50 END WHEN 'white_blood_cell_count' THEN 11 ELSE 450 END END AS b_hi
  FROM rpt_fields
), n2 AS (
  SELECT *, CASE WHEN unit IS NULL AND field_name IN ('white_blood_cell_count', 'platelet_count') AND raw >= 1000 THEN 0.001 WHEN unit IS NULL THEN 1 ELSE factor END::DECIMAL(9,6) AS scale
  FROM n1
), n3 AS (
  SELECT *, round(raw * coalesce(scale, 1), 6)::DECIMAL(18,6) AS normalized,
    CASE WHEN reference_range IS NULL THEN b_lo ELSE regexp_extract(reference_range, '^([0-9.]+)', 1)::DECIMAL(18,6) * scale END AS lower,
    CASE WHEN reference_range IS NULL THEN b_hi ELSE regexp_extract(reference_range, '([0-9.]+)$', 1)::DECIMAL(18,6) * scale END AS upper,
    CASE WHEN reference_range IS NOT NULL THEN 'report' WHEN b_lo IS NOT NULL THEN 'adult' END AS basis
  FROM n2
), n4 AS (
  SELECT *, CASE WHEN normalized > upper THEN 'H' WHEN normalized < lower THEN 'L' END AS direction FROM n3
), decided AS (
  SELECT *, CASE WHEN value IS NULL THEN 'MISSING' WHEN raw IS NULL THEN 'INVALID_FORMAT' WHEN unit IS NOT NULL AND factor IS NULL THEN 'UNRECOGNIZED_UNIT'
    WHEN unit IS NULL AND field_name IN ('glucose', 'hemoglobin') THEN 'UNRECOGNIZED_UNIT' WHEN normalized < p_lo OR normalized > p_hi THEN 'EXTREME_VALUE'
    WHEN basis IS NULL THEN 'NO_REFERENCE_RANGE' WHEN normalized > 4 * upper OR normalized * 4 < lower THEN 'EXTREME_VALUE'
    WHEN direction IS NOT NULL OR abnormal_flag IS NOT NULL THEN 'OUTSIDE_REFERENCE_RANGE' ELSE 'VALID' END AS state
  FROM n4
), flagged AS (
  SELECT * EXCLUDE (state), CASE WHEN state IN ('VALID', 'OUTSIDE_REFERENCE_RANGE') AND bool_or(abnormal_flag IS NOT NULL) OVER (PARTITION BY report_id)
    AND CASE WHEN basis = 'report' THEN abnormal_flag IS DISTINCT FROM direction ELSE coalesce(abnormal_flag <> direction, false) END THEN 'FLAG_MISMATCH' ELSE state END AS state
  FROM decided
), scored AS (
  SELECT *, round(confidence / 100.0 * CASE WHEN state IN ('MISSING', 'INVALID_FORMAT') THEN 0.5 ELSE 1 END, 4)::DOUBLE AS conf FROM flagged
), cat AS (
  SELECT *, CASE WHEN conf >= 0.9 THEN 'HIGH' WHEN conf >= 0.7 THEN 'REVIEW_RECOMMENDED' ELSE 'LOW' END AS category FROM scored
)
"""
