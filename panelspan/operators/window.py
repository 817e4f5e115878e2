"""Ordered and cross-sectional window operators. Every ordered window takes a total order from its caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``, which is given latest first (``desc_nulls_last``)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def pct_rank(value: str, by: list[str]) -> Column:
    """Average-tie percent rank among the non-null values of a group; null for nulls."""
    group, same = Window.partitionBy(*by), Window.partitionBy(*by, value)
    rank = F.rank().over(group.orderBy(F.col(value).asc_nulls_last()))
    return F.when(F.col(value).isNotNull(), (rank + (F.count("*").over(same) - 1) / 2) / F.count(value).over(group))


def average_rank(value: str, by: list[str]) -> Column:
    """Average-tie rank from 1."""
    group, same = Window.partitionBy(*by), Window.partitionBy(*by, value)
    return F.rank().over(group.orderBy(value)) + (F.count("*").over(same) - 1) / 2


def qcut_rank(order: list[Column], by: list[str], k: int) -> Column:
    """Bucket 0..k-1 of the row's rank in ``order``: quantile edges of the ranks, right-closed, the first bucket closed."""
    rn, n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)), F.count("*").over(Window.partitionBy(*by))
    return F.when(n == 1, F.lit(0)).otherwise(F.greatest(F.ceil((rn - 1) * k / F.nullif(n - 1, F.lit(0))) - 1, F.lit(0))).cast("int")


def decile_floor(value: str, by: list[str], k: int = 10) -> Column:
    """floor((average rank - 1) / n * k), at most k - 1."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.least(F.floor((average_rank(value, by) - 1) / n * k), F.lit(k - 1)).cast("int")


def rolling(aggregate, value: str, by: list[str], order: list[str], first: int, last: int, min_periods: int) -> Column:
    """``aggregate`` over rows first..last of the ordered group, null where fewer than ``min_periods`` values are there."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(first, last)
    return F.when(F.count(value).over(frame) >= min_periods, aggregate(value).over(frame))


def run_length(changed: Column, by: list[str], order: list[str]) -> Column:
    """Rows since ``changed`` last held, 0 at such a row; the group's first row starts a run."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return run


def fill(value: str, by: list[str], order: list[str], backward: bool = False) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    if backward:
        return F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def decayed(df: DataFrame, by: list[str], at: str, value: str, halflife: float, name: str, before: bool = False, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of the values up to each row, each halved for every ``halflife`` of ``at`` (a number) that has passed;
    ``before`` leaves the row itself out.

    Values are scaled up from the beginning of their block of 400 half-lives, so running sums do; of earlier blocks
    only the last one still counts in double precision. A key's rows are read in order, never gathered.
    """
    span = 400 * halflife
    block = F.floor(F.col(at) / span)
    scaled = df.withColumns({"_b": block, "_x": F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * F.pow(F.lit(2.0), (F.col(at) - block * span) / halflife)})
    w = Window.partitionBy(*by, "_b").orderBy(at, *(order or [])).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    run = F.coalesce(F.sum("_x").over(w), F.lit(0.0))
    totals = scaled.groupBy(*by, (F.col("_b") + 1).alias("_b")).agg(F.sum("_x").alias("_carry"))
    out = scaled.withColumn("_run", run).join(totals, [*by, "_b"], "left")
    since = (F.col(at) - F.col("_b") * span) / halflife
    value = (F.col("_run") + F.coalesce("_carry", F.lit(0.0)) * 2.0**-400) * F.pow(F.lit(2.0), -since)
    return out.withColumn(name, value).select(*df.columns, name)


def decayed_sums(df: DataFrame, key: str, day: str, value: str, halflife: float) -> DataFrame:
    """(key, day, decayed): the sum of a key's values up to each day, halved for every ``halflife`` days. One row a (key, day) is expected."""
    numbered = df.select(key, day, value, F.datediff(day, F.lit("1970-01-01").cast("date")).alias("_at"))
    return decayed(numbered, [key], "_at", value, halflife, "decayed").select(key, day, "decayed")


def remembered(df: DataFrame, by: list[str], order: list[str], value: str, halflife: float, name: str) -> DataFrame:
    """``df`` with ``name``: the mean of a key's earlier values, halved in weight with every ``halflife`` rows; null on its first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    counted = df.withColumns({"_k": F.row_number().over(w), "_one": F.lit(1.0)})
    both = decayed(decayed(counted, by, "_k", value, halflife, "_sum", before=True), by, "_k", "_one", halflife, "_weight", before=True)
    return both.withColumn(name, F.when(F.col("_k") > 1, F.col("_sum") / F.col("_weight"))).select(*df.columns, name)
