"""Numbers, units, printed ranges and the constants they are checked against, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, ranges, limits and factors that results must agree on.
CANONICAL_UNIT = {
    "glucose": "mg/dL", "hemoglobin": "g/dL", "hematocrit": "%", "white_blood_cell_count": "x10^3/uL", "platelet_count": "x10^3/uL",
}
RANGES = {
    ("glucose", "any"): (70.0, 100.0), ("hemoglobin", "M"): (13.5, 17.5), ("hemoglobin", "F"): (12.0, 15.5), ("hemoglobin", "any"): (12.0, 17.5),
    ("hematocrit", "M"): (41.0, 50.0), ("hematocrit", "F"): (36.0, 44.0), ("hematocrit", "any"): (36.0, 50.0),
    ("white_blood_cell_count", "any"): (4.5, 11.0), ("platelet_count", "any"): (150.0, 450.0),
}
PLAUSIBLE = {
    "glucose": (10.0, 2000.0), "hemoglobin": (2.0, 25.0), "hematocrit": (5.0, 75.0), "white_blood_cell_count": (0.01, 1000.0), "platelet_count": (1.0, 3000.0),
}
COUNT_FACTORS = {
    "x10^3/ul": "1", "10^3/ul": "1", "k/ul": "1", "thou/ul": "1", "x10^9/l": "1", "10^9/l": "1",
    "/ul": "0.001", "cells/ul": "0.001", "/mm3": "0.001", "cells/mm3": "0.001",
}
FACTORS = {
    "glucose": {"mg/dl": "1", "mmol/l": "18.016"},
    "hemoglobin": {"g/dl": "1", "gm/dl": "1", "g/l": "0.1", "gm/l": "0.1", "mmol/l": "1.611"},
    "hematocrit": {"%": "1", "l/l": "100"},
    "white_blood_cell_count": COUNT_FACTORS, "platelet_count": COUNT_FACTORS,
}
UNIT_REQUIRED = ["glucose", "hemoglobin"]
COUNTS = ["white_blood_cell_count", "platelet_count"]
ADULT_AGE, RAW_COUNT, FAR_FACTOR = 18, 1000, 4

DEC = "decimal(18,6)"
#: A run of digits with its points and commas; what it means is decided by its form.
RUN = r"-?\d[\d.,]*"


def to_decimal(run: Column) -> Column:
    """A run of digits as a decimal: commas between groups of three go, a lone comma before one or two digits is a decimal point,
    and of a run of no known form the leading whole or decimal number counts."""
    t = F.rtrim(run, F.lit(".,"))
    grouped, decimal_comma = t.rlike(r"^-?\d{1,3}(,\d{3})+([.]\d+)?$"), t.rlike(r"^-?\d+,\d{1,2}$")
    plain = F.when(grouped, F.replace(t, F.lit(","), F.lit(""))).when(decimal_comma, F.replace(t, F.lit(","), F.lit(".")))
    return plain.otherwise(F.regexp_extract(t, r"^-?\d+([.]\d+)?", 0)).try_cast(DEC)


def parse_number(text: Column) -> Column:
    """The first number anywhere in a text, as a decimal; null if there is none."""
    return to_decimal(F.nullif(F.regexp_extract(text, RUN, 0), F.lit("")))


def normalize_unit(unit: Column) -> Column:
    u = F.translate(F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit("")), "µμ×*", "uux^")
    return F.nullif(F.replace(F.replace(u, F.lit("cumm"), F.lit("mm3")), F.lit("mm^3"), F.lit("mm3")), F.lit(""))


def format_number(value: Column) -> Column:
    """Three decimals at most, none for whole numbers."""
    return F.regexp_replace(F.round(value, 3).cast("decimal(18,3)").cast("string"), r"\.?0+$", "")


def printed_range(text: Column) -> Column:
    """struct<lower, upper> of a printed range; null where it can't be read or its ends are swapped. One end may be open."""
    both, one = rf"({RUN})\s*(?:-|–|(?i:to))\s*({RUN})", rf"([<>≤≥])=?\s*({RUN})"
    lo, hi, bound = (to_decimal(F.nullif(F.regexp_extract(text, p, g), F.lit(""))) for p, g in ((both, 1), (both, 2), (one, 2)))
    sign, pair, none = F.regexp_extract(text, one, 1), text.rlike(both), F.lit(None).cast(DEC)
    return (
        F.when(pair & (lo <= hi), F.struct(lo.alias("lower"), hi.alias("upper")))
        .when(~pair & sign.isin("<", "≤"), F.struct(none.alias("lower"), bound.alias("upper")))
        .when(~pair & sign.isin(">", "≥"), F.struct(bound.alias("lower"), none.alias("upper")))
    )


def _lookup(table: dict, key: Column, kind: str = DEC) -> Column:
    """A constant map, folded once; a chain of ``when`` would be copied into every expression that uses it."""
    pairs = [F.lit(x) if i % 2 == 0 else F.lit(x).cast(kind) for kv in table.items() for i, x in enumerate(kv)]
    return F.try_element_at(F.create_map(*pairs), key)


def _by_field(field: Column, values: dict, kind: str = DEC) -> Column:
    return _lookup(values, field, kind)


def unit_factor(field: Column, unit: Column) -> Column:
    """What takes a value in a normalized unit to the field's canonical unit; null for a unit the field doesn't know."""
    return _lookup({f"{name} {u}": factor for name, table in FACTORS.items() for u, factor in table.items()}, F.concat_ws(" ", field, unit))


def canonical_unit(field: Column) -> Column:
    return _by_field(field, CANONICAL_UNIT, "string")


def plausible(field: Column) -> tuple[Column, Column]:
    return _by_field(field, {k: v[0] for k, v in PLAUSIBLE.items()}), _by_field(field, {k: v[1] for k, v in PLAUSIBLE.items()})


def builtin_range(field: Column, sex: Column, age: Column) -> tuple[Column, Column]:
    """Adult range by sex, else for any sex; null for children. An unknown age counts as adult."""
    ends = []
    for end in (0, 1):
        table = {f"{f} {s}": r[end] for (f, s), r in RANGES.items()}
        found = F.coalesce(_lookup(table, F.concat_ws(" ", field, F.coalesce(sex, F.lit("any")))), _lookup(table, F.concat_ws(" ", field, F.lit("any"))))
        ends.append(F.when(~F.coalesce(age < ADULT_AGE, F.lit(False)), found))
    return ends[0], ends[1]


def field_confidence(percent: Column, state: Column) -> Column:
    """0-100 to 0-1, halved for unusable states and once more for a source mismatch."""
    bad = F.when(state.isin("MISSING", "INVALID_FORMAT", "IMPLAUSIBLE_VALUE"), 0.5).otherwise(1.0)
    lost = F.when(state == "SOURCE_MISMATCH", 0.5).otherwise(1.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(percent, F.lit(0.0)) / 100 * bad * lost)), 4)


def confidence_category(conf: Column, high: float = 0.9, low: float = 0.7) -> Column:
    return F.when(conf >= high, "HIGH").when(conf >= low, "REVIEW_RECOMMENDED").otherwise("LOW")


def scale_confidence(conf: Column) -> Column:
    return F.when(conf <= 1, F.round(conf * 100, 1)).otherwise(conf)


def tolerance_match(got: Column, want: Column) -> Column:
    """Numbers within one percent or 0.051 of each other, other texts equal without case and edge spaces."""
    g, w = parse_number(got).cast("double"), parse_number(want).cast("double")
    numeric = got.try_cast("double").isNotNull() & want.try_cast("double").isNotNull()
    return F.when(numeric, F.abs(g - w) <= F.greatest(F.abs(w) * 0.01, F.lit(0.051))).otherwise(F.lower(F.trim(got)) == F.lower(F.trim(want)))


def thresholds_problem(auto_accept: Column, high: Column, low: Column) -> Column:
    """What is wrong with a set of thresholds, or null."""
    none = auto_accept.isNull() | high.isNull() | low.isNull()
    order, share = (low > 0) & (low <= high) & (high <= 1), (auto_accept >= 0.5) & (auto_accept <= 1)
    return F.when(none, "Thresholds must be numbers").when(~order, "Require 0 < low_confidence <= review_recommended <= 1").when(~share, "auto_accept must be between 0.5 and 1.0")
