"""Measures of forecasts and portfolios: correlations by date, regressions from moments, turnover, clustered t values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .window import average_rank


def rank_ic(df: DataFrame, date: str, x: str, y: str, min_n: int) -> DataFrame:
    """(date, n, ic): Spearman correlation over rows with both, where n is large enough and both vary."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_rx": average_rank(x, [date]), "_ry": average_rank(y, [date])})
    day = both.groupBy(date).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("ic"), F.var_pop("_rx").alias("_vx"), F.var_pop("_ry").alias("_vy"))
    return day.where((F.col("n") >= min_n) & (F.col("_vx") > 0) & (F.col("_vy") > 0)).select(date, "n", "ic")


def t_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean and t = sqrt(n) mean / sd (sample)."""
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.sqrt(F.count(value)) * F.avg(value) / F.nullif(F.stddev_samp(value), F.lit(0.0))).alias("t"))


def gram(df: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    """Sums of cross products by group: n, zz_i_j (i <= j), zr_i and rr."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"zz_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *sums, *[F.sum(F.col(a) * F.col(y)).alias(f"zr_{i}") for i, a in enumerate(x)], F.sum(F.col(y) * F.col(y)).alias("rr"))


def turnover(weights: DataFrame, date: str, name: str, weight: str) -> DataFrame:
    """(date, turnover): half the sum of |w - w on the date before| over names on either date."""
    dates = weights.select(date).distinct().withColumn("_next", F.lead(date).over(Window.orderBy(date)))
    before = weights.join(F.broadcast(dates), date).where("_next is not null").select(F.col("_next").alias(date), name, F.col(weight).alias("_before"))
    both = weights.select(date, name, weight).join(before, [date, name], "full")
    return both.groupBy(date).agg((F.sum(F.abs(F.coalesce(weight, F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))) / 2).alias("turnover"))


def newey_west(series: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """One row: n, mean and t with Bartlett weights on ``lags`` autocovariances. ``series`` is short: one row a period."""
    w = Window.orderBy(order)
    m = series.select(order, (F.col(value) - F.avg(value).over(Window.partitionBy())).alias("u"), F.col(value).alias("v"))
    m = m.select("u", "v", *[F.lag("u", k).over(w).alias(f"u{k}") for k in range(1, lags + 1)])
    terms = [F.avg(F.col("u") * F.col("u"))] + [F.lit(2 * (1 - k / (lags + 1))) * F.sum(F.col("u") * F.col(f"u{k}")) / F.count("*") for k in range(1, lags + 1)]
    total: Column = terms[0]
    for t in terms[1:]:
        total = total + t
    return m.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.avg("v") / F.sqrt(total / F.count("*"))).alias("t"))


def pooled_correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, pearson and spearman over all rows with both. Ranks come from counts of the different values, in ranges, so that
    no task sees all rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for c in ("x", "y"):
        both = both.join(global_ranks(both, c), c)
    return both.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("r_x", "r_y").alias("spearman"))


def global_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, r_value): the average rank of each different value over all rows; ranges of values are counted first, then ranked apart."""
    counts = df.groupBy(value).agg(F.count("*").alias("k"))
    parted = counts.repartitionByRange(F.col(value)).withColumn("p", F.spark_partition_id())
    before = parted.groupBy("p").agg(F.sum("k").alias("s")).select("p", (F.sum("s").over(Window.orderBy("p")) - F.col("s")).alias("before"))
    upto = F.sum("k").over(Window.partitionBy("p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return parted.join(F.broadcast(before), "p").select(value, (F.col("before") + upto - (F.col("k") - 1) / 2).alias(f"r_{value}"))


def concentration(weights: DataFrame, by: list[str], name: str, weight: str) -> DataFrame:
    """(by, hhi, top5, breadth, gross, net, long_names, short_names) of signed weights."""
    size = F.abs(F.col(weight))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(size.desc(), name))
    gross, square = F.sum(size), F.sum(F.col(weight) * F.col(weight))
    return weights.withColumn("_k", rank).groupBy(*by).agg(
        (square / F.nullif(gross * gross, F.lit(0.0))).alias("hhi"), (F.sum(F.when(F.col("_k") <= 5, size)) / F.nullif(gross, F.lit(0.0))).alias("top5"), (gross * gross / F.nullif(square, F.lit(0.0))).alias("breadth"),
        gross.alias("gross"), F.sum(weight).alias("net"), F.count(F.when(F.col(weight) > 0, 1)).alias("long_names"), F.count(F.when(F.col(weight) < 0, 1)).alias("short_names"),
    )


def r2_family(df: DataFrame, name: str, date: str, y: str, fitted: str, least: int) -> DataFrame:
    """One row: total R2, the median over names with ``least`` rows, the mean over dates, and the sum of errors by that of sizes."""
    e = (F.col(y) - F.col(fitted)) ** 2
    r2 = 1 - F.sum(e) / F.nullif(F.sum(F.col(y) ** 2), F.lit(0.0))
    names = df.groupBy(name).agg(r2.alias("r"), F.count("*").alias("n")).where(F.col("n") >= least).agg(F.median("r").alias("median_name"))
    dates = df.groupBy(date).agg(r2.alias("r")).agg(F.avg("r").alias("mean_date"))
    total = df.agg(r2.alias("total"), (F.sum(F.abs(F.col(y) - F.col(fitted))) / F.sum(F.abs(y))).alias("pricing_error"))
    return total.join(names).join(dates)


def net_sharpe(daily: DataFrame, gain: str, turnover: str, cost: float, days: int = 252) -> DataFrame:
    """One row: days, sharpe, net_sharpe after ``cost`` a unit of turnover, and break_even, the cost that eats all."""
    net = F.col(gain) - cost * F.col(turnover)
    yearly = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * days**0.5
    return daily.agg(F.count("*").alias("days"), yearly(F.col(gain)).alias("sharpe"), yearly(net).alias("net_sharpe"), (F.avg(gain) / F.nullif(F.avg(turnover), F.lit(0.0))).alias("break_even"))


def gain_by_slice(df: DataFrame, by: str, old: Column, new: Column) -> DataFrame:
    """(by, n, mae_old, mae_new, rmse_new, gain, t) of absolute errors, with a row over all slices; t is of the mean saving."""
    saved = old - new
    t = F.avg(saved) / F.nullif(F.stddev_samp(saved), F.lit(0.0)) * F.sqrt(F.count("*"))
    return df.rollup(by).agg(F.count("*").alias("n"), F.avg(old).alias("mae_old"), F.avg(new).alias("mae_new"), F.sqrt(F.avg(new * new)).alias("rmse_new"), (1 - F.avg(new) / F.nullif(F.avg(old), F.lit(0.0))).alias("gain"), t.alias("t"))
