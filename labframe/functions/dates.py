"""Dates as printed on reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH_NAMES = ["d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d-MMMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy"]


def _first(text: Column, formats: list[str]) -> Column:
    """The first format that fits. A text that lacks the sign of a format is not tried: each trial that fails raises an exception
    inside, which costs far more than a look at the text."""
    signs = [next((c for c in "-/.," if c in f), " ") for f in formats]
    return F.coalesce(*[F.when(text.contains(c), F.try_to_timestamp(text, F.lit(f))) for c, f in zip(signs, formats, strict=True)])


def parse_date(text: Column, order: Column) -> Column:
    """A date from the known formats; for numeric day and month the document's order (DMY or MDY) is tried first. Only texts with
    letters are tried with a month's name, and with nothing else. ``text`` should be a column of its own: it is looked at often."""
    t = F.trim(text)
    day_first, month_first = ["d/M/yyyy", "d-M-yyyy"], ["M/d/yyyy", "M-d-yyyy"]
    numeric = F.when(order == "DMY", _first(t, [*day_first, *month_first])).otherwise(_first(t, [*month_first, *day_first]))
    digits = F.coalesce(_first(t, ["yyyy-M-d", "yyyy/M/d"]), numeric, _first(t, ["d.M.yyyy"]))
    return F.when(t.rlike(r"\p{L}"), _first(t, _MONTH_NAMES)).otherwise(digits).cast("date")


def _numeric_parts(text: Column) -> tuple[Column, Column]:
    pattern = r"^\s*(\d{1,2})[/-](\d{1,2})[/-]\d{4}\s*$"
    return tuple(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).cast("int") for g in (1, 2))


def is_ambiguous(text: Column) -> Column:
    a, b = _numeric_parts(text)
    return F.coalesce((a <= 12) & (b <= 12) & (a != b), F.lit(False))


def order_vote(text: Column) -> Column:
    """DMY or MDY if one of the two numbers can only be a day, else null."""
    a, b = _numeric_parts(text)
    return F.when((a > 12) & (b <= 12), "DMY").when((b > 12) & (a <= 12), "MDY")


def document_order(votes: Column, default: str = "MDY") -> Column:
    """Aggregate: the order that all votes of a document agree on, else the default."""
    seen = F.collect_set(votes)
    return F.when(F.size(seen) == 1, seen[0]).otherwise(F.lit(default))


def date_state(parsed: Column, today: Column) -> Column:
    return F.when(parsed.isNull(), "INVALID_FORMAT").when(parsed > today, "IMPLAUSIBLE_VALUE").otherwise("VALID")


def age_in_years(born: Column, on: Column) -> Column:
    """Whole years by comparing month and day; null before birth."""
    before = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(born) * 100 + F.dayofmonth(born))
    age = F.year(on) - F.year(born) - before.cast("int")
    return F.when(age >= 0, age)


def date_problem(born: Column, collected: Column, received: Column) -> tuple[Column, Column]:
    """Messages for collection_date and received_date; of two problems of the latter, the second stands."""
    c = F.when(collected < born, "Collection date is before date of birth")
    r = F.when(received < collected, "Received date is before collection date").when(received < born, "Received date is before date of birth")
    return c, r
