"""Special functions, interpolation, business days, unit rules and small tables, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import rating_number

# Coefficients of the rational approximation to the normal quantile (relative error 1.15e-9).
CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL = 0.02425


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """The normal quantile; null outside of (0, 1)."""
    q = p - 0.5
    near = q * _horner(q * q, CENTRE_TOP) / _horner(q * q, CENTRE_BOTTOM)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    tail = lambda s: _horner(s, TAIL_TOP) / _horner(s, TAIL_BOTTOM)
    return F.when((p > 0) & (p < TAIL), tail(low)).when((p >= TAIL) & (p <= 1 - TAIL), near).when((p > 1 - TAIL) & (p < 1), -tail(high))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, clip: float = 1e-6) -> Column:
    held = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(held / (1 - held))


def softmax(scores: Column) -> Column:
    """An array's softmax, the greatest score taken off first."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def interpolate(x: Column, grid: Column, values: Column) -> Column:
    """Piecewise linear through (grid, values), arrays in rising order of the grid; its end values beyond both ends."""
    above = F.size(F.filter(grid, lambda g: g <= x))
    left, right = F.get(grid, above - 1), F.get(grid, above)
    low, high = F.get(values, above - 1), F.get(values, above)
    return F.when(x.isNull(), None).when(above == 0, F.get(values, F.lit(0))).when(above >= F.size(grid), F.get(values, F.size(grid) - 1)).otherwise(low + (high - low) * (x - left) / (right - left))


def business_day_number(day: Column) -> Column:
    """Weekdays since Monday 1970-01-05, counted to and with ``day``; Saturdays and Sundays have Friday's number."""
    since = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return (F.floor(since / 7) * 5 + F.least(F.pmod(since, F.lit(7)), F.lit(4))).cast("int")


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays from ``start`` (inclusive) to ``end`` (exclusive), negative if they are the other way round."""
    before = lambda d: F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.pmod(F.datediff(d, F.lit("1970-01-05").cast("date")), F.lit(7)), F.lit(5))
    return (before(end) - before(start)).cast("int")


def add_business_days(day: Column, n: int) -> Column:
    """The weekday ``n`` after ``day``; weekends count as the Friday before."""
    number = business_day_number(day) + n
    return F.date_add(F.lit("1970-01-05").cast("date"), (F.floor(number / 5) * 7 + F.pmod(number, F.lit(5))).cast("int"))


def rating_with_fallback(final: Column, composite: Column) -> Column:
    """The first rating of the scale, upper case; NR without one."""
    known = lambda r: F.when(rating_number(r).isNotNull(), F.upper(F.trim(r)))
    return F.coalesce(known(final), known(composite), F.lit("NR"))


def token_group(key: Column) -> Column:
    """First token of keys that begin with cpn3, the first two of others."""
    return F.when(key.startswith("cpn3"), F.substring_index(key, "_", 1)).otherwise(F.substring_index(key, "_", 2))


def yield_from_price(own_yield: Column, price: Column, other_price: Column, dv01: Column) -> Column:
    """The yield at another price, along the tangent: y + (price - other) / dv01 / 100; null where the slope is none."""
    return own_yield + (price - other_price) / F.nullif(dv01, F.lit(0.0)) / 100


def tenor_bucket(years: Column) -> Column:
    """Whole-year tenors up to 5, then spans of 5 up to 30; right-closed."""
    out = F.when(years.isNull() | (years < 0), "NA")
    for edge in (1, 2, 3, 5, 10, 15, 20, 25, 30):
        out = out.when(years <= edge, f"{edge}Y")
    return out.otherwise("30Y+")


def price_units(value: Column, typical: Column) -> Column:
    """Yields as percent: a column whose typical size is under 1 is taken for decimals."""
    return F.when(typical < 1, value * 100).otherwise(value)
