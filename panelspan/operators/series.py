"""Measures of one short series (a row a day or week), computed inside one aggregated row; and dense calendars of long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _bartlett(u: Column, lags: Column) -> Column:
    """u'u and twice its lagged products, weighed down to nothing at the lag after the last."""
    n = F.size(u)
    return F.aggregate(F.sequence(F.lit(0), lags), F.lit(0.0), lambda s, k: s + F.when(k == 0, 1.0).otherwise(2 * (1 - k / (lags + 1))) * _product(F.slice(u, F.lit(1), n - k), F.slice(u, k + 1, n - k)))


def default_lags(n: Column) -> Column:
    return F.least(F.floor(4 * F.pow(n / 100, 2 / 9)), n - 1).cast("int")


def newey_west(series: DataFrame, order: str, value: str) -> DataFrame:
    """One row: n, lags = floor(4 (n / 100) ** (2 / 9)), mean and t. ``series`` has one row a period."""
    rows = series.where(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("rows"), F.avg(value).alias("mean"), F.count(value).cast("int").alias("n"))
    rows = rows.where("n > 1").withColumn("u", F.expr(f"transform(rows, r -> r.{value} - mean)")).withColumn("lags", default_lags(F.col("n")))
    return rows.select(F.col("n").cast("long").alias("n"), "lags", "mean", (F.col("mean") / F.sqrt(F.nullif(_bartlett(F.col("u"), F.col("lags")), F.lit(0.0)) / F.col("n") / F.col("n"))).alias("t"))


def clustered_t(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row: n, clusters, mean and t = mean n / sqrt(v) of rows that are dependent within a cluster (a week) and over neighbouring ones."""
    mean = df.where(F.col(value).isNotNull()).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    rows = sums.agg(F.array_sort(F.collect_list(F.struct(cluster, "s", "k"))).alias("rows")).join(F.broadcast(mean))
    rows = rows.withColumn("u", F.expr("transform(rows, r -> r.s - r.k * mean)")).withColumn("clusters", F.size("u")).where("clusters > 1").withColumn("lags", default_lags(F.col("clusters")))
    return rows.select("n", F.col("clusters").cast("long").alias("clusters"), "mean", (F.col("mean") * F.col("n") / F.sqrt(F.nullif(_bartlett(F.col("u"), F.col("lags")), F.lit(0.0)))).alias("t"))


def block_bootstrap_t(series: DataFrame, order: str, value: str, block: int = 5, draws: int = 500, seed: int = 7) -> DataFrame:
    """One row: n, mean and t = mean / deviation of the means of ``draws`` series put together from moving blocks.

    Where a block begins is a hash of (seed, draw, block), so that any engine draws the same ones. Prefix sums give a block's sum.
    """
    rows = series.where(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("rows"), F.avg(value).alias("mean"), F.count(value).cast("int").alias("n")).where(F.col("n") >= block)
    sums = F.expr(f"aggregate(rows, array(cast(0 as double)), (a, r) -> concat(a, array(element_at(a, -1) + r.{value})))")
    each = rows.select("n", "mean", sums.alias("sums"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    start = lambda b: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("draw"), b)), 1, 8), 16, 10).cast("long"), (F.col("n") - block + 1).cast("long")).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), blocks), F.lit(0.0), lambda s, b: s + F.get("sums", start(b) + block) - F.get("sums", start(b)))
    drawn = each.select("n", "mean", (total / (blocks * block)).alias("m"))
    return drawn.groupBy("n", "mean").agg(F.stddev_pop("m").alias("sd")).select(F.col("n").cast("long").alias("n"), "mean", (F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))).alias("t"))


def dense_windows(df: DataFrame, key: str, date: str, value: str, back: int) -> DataFrame:
    """(key, date, have, total): over the last ``back`` dates of all keys together, gaps counted as positions, how many values a key
    has and their sum. Positions are a small table; the frame is a range over them, so that no gap is filled with rows."""
    calendar = df.select(date).where(F.col(date).isNotNull()).distinct().withColumn("_pos", F.row_number().over(Window.orderBy(date)))
    frame = Window.partitionBy(key).orderBy("_pos").rangeBetween(-(back - 1), 0)
    return df.join(F.broadcast(calendar), date).select(key, date, F.count(value).over(frame).alias("have"), F.sum(value).over(frame).alias("total"))


def rolling_covariance(wide: DataFrame, order: str, columns: list[str], window: int) -> DataFrame:
    """(order, i, j, n, cov): sample covariance of the last ``window`` rows up to and with each; ``wide`` has one row a date."""
    frame = Window.orderBy(order).rowsBetween(-(window - 1), 0)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cov = [F.covar_samp(a, b).over(frame).alias(f"{a}|{b}") for a, b in pairs]
    each = wide.select(order, F.count("*").over(frame).alias("n"), *cov)
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs]))
    return each.select(order, "n", stacked.alias("c")).select(order, "c.i", "c.j", "n", "c.cov").where(F.col("n") == window)


def histogram_median(df: DataFrame, by: list[str], value: str, width: float = 1.0, reach: float = 300.0, least: int = 3) -> DataFrame:
    """(by, n, level): the lower median of values within +-reach, as the middle of its bin; groups of fewer than ``least`` are left out.

    Counted by bin first, so that a group of any size comes down to its bins before they are put in order.
    """
    near = df.where(F.abs(F.col(value)) <= reach)
    bins = near.groupBy(*by, F.floor(F.col(value) / width).alias("_bin")).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by)
    run = bins.withColumns({"_c": F.sum("_k").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_k").over(w)})
    return run.where(F.col("_c") * 2 >= F.col("n")).groupBy(*by, "n").agg(((F.min("_bin") + 0.5) * width).alias("level")).where(F.col("n") >= least)


def exact_percentile(df: DataFrame, value: str, share: float, bins: int = 1024) -> DataFrame:
    """One row (value): the percentile between neighbouring ranks, as ``percentile`` has it, without a map of all different values.

    Counts by bin find the bins that hold the two ranks; only rows inside them are put in order.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    binned = known.join(F.broadcast(ends)).withColumn("b", F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))).withColumn("b", F.coalesce("b", F.lit(0)))
    counts = binned.groupBy("b").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    counts = counts.withColumn("upto", F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    rank = (F.col("n") - 1) * share
    held = counts.where((F.col("upto") > F.floor(rank)) & (F.col("upto") - F.col("k") <= F.ceil(rank))).select("b", (F.col("upto") - F.col("k")).alias("before"))
    inside = binned.join(F.broadcast(held), "b")
    at = F.min("before").over(Window.partitionBy()) + F.row_number().over(Window.orderBy("v")) - 1
    two = inside.select("v", "n", at.alias("at")).where((F.col("at") == F.floor(rank)) | (F.col("at") == F.ceil(rank)))
    return two.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first("n").alias("n")).select((F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))).alias("value"))
