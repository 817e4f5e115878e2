"""Scalar functions of the panel vocabulary, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rating scale, best first, with its numbers.
RATINGS = ["AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C", "D"]
TRUE_WORDS = ["true", "t", "yes", "y", "1"]


def rating_number(rating: Column) -> Column:
    """21 for AAA down to 0 for D; null for anything else, blanks and letter case aside."""
    table = F.create_map(*[x for k, r in enumerate(RATINGS) for x in (F.lit(r), F.lit(len(RATINGS) - 1 - k))])
    return F.element_at(table, F.upper(F.trim(rating)))


def flag(value: Column) -> Column:
    """Any spelling of a boolean as one; null where nothing is said."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isNotNull(), F.coalesce(text.isin(*TRUE_WORDS) | (text.try_cast("double") > 0), F.lit(False)))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def days_30_360(start: Column, end: Column) -> Column:
    d1, d2 = F.least(F.day(start), F.lit(30)), F.day(end)
    d2 = F.when((d2 == 31) & (d1 == 30), 30).otherwise(d2)
    return 360 * (F.year(end) - F.year(start)) + 30 * (F.month(end) - F.month(start)) + d2 - d1


def ladder(value: Column, edges: list[float], labels: list[str], missing: str = "UNKNOWN") -> Column:
    """Left-closed buckets: the first label whose edge is above the value, the last one beyond all edges."""
    out = F.when(value.isNull(), missing)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def cut(value: Column, edges: list[float], labels: list[str], missing: str = "NA") -> Column:
    """Right-closed buckets between neighbouring edges; outside of all: ``missing``."""
    out = F.when(value.isNull() | (value <= edges[0]), missing)
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(value <= edge, label)
    return out.otherwise(missing)


def date_of(value: Column) -> Column:
    """Dates written as yyyyMMdd, as ISO text or as epoch milliseconds; null where it is none or before 2000."""
    text = F.trim(value.cast("string"))
    found = F.coalesce(
        F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")),
        F.when(text.rlike("^[0-9]{12,14}$"), F.to_date(F.timestamp_millis(text.try_cast("long")))),
        F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")),
    )
    return F.when(found >= F.lit("2000-01-01").cast("date"), found)
