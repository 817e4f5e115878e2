"""Outlier rules, winsorising and shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mad_flags(df: DataFrame, value: str, by: list[str], k: float, scale: float = 1.4826, floor: float = 1e-6) -> DataFrame:
    """Adds med, mad and extreme: |x - median| > k * mad, or x not finite. ``scale`` 1 gives the unscaled rule."""
    w = Window.partitionBy(*by)
    df = df.withColumn("med", F.median(value).over(w))
    df = df.withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    df = df.withColumn("mad", F.greatest(F.median("_dev").over(w) * scale, F.lit(floor)))
    odd = F.col(value).isNull() | F.isnan(F.col(value)) | (F.abs(value) == float("inf"))
    return df.withColumn("extreme", odd | (F.col("_dev") > k * F.col("mad"))).drop("_dev")


def clip(value: Column, low, high) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def winsorise_at_train_quantiles(df: DataFrame, value: str, train: Column, low: float, high: float) -> DataFrame:
    """Adds clipped: the value held within the quantiles of the training rows."""
    q = df.where(train).agg(F.percentile(value, low).alias("_lo"), F.percentile(value, high).alias("_hi"))
    return df.join(F.broadcast(q)).withColumn("clipped", clip(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def shrunk_means(df: DataFrame, group: str, value: str, k: float) -> DataFrame:
    """(group, n, own, shrunk): group means pulled to the pooled mean by n / (n + k)."""
    pooled = df.agg(F.avg(value).alias("_pool"))
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("own")).join(F.broadcast(pooled))
    w = F.col("n") / (F.col("n") + k)
    return g.withColumn("shrunk", w * F.col("own") + (1 - w) * F.col("_pool")).drop("_pool")


def empirical_bayes(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, own, shrunk): means of groups of two rows and more pulled to the mean of the means by tau2 / (tau2 + se2), where tau2 is
    what the means vary by beyond their own errors."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("own"), (F.var_samp(value) / F.count(value)).alias("_se2")).where("n > 1")
    t = g.agg(F.greatest(F.lit(0.0), F.var_pop("own") - F.avg("_se2")).alias("_tau2"), F.avg("own").alias("_grand"))
    share = F.coalesce(F.col("_tau2") / F.nullif(F.col("_tau2") + F.col("_se2"), F.lit(0.0)), F.lit(0.0))
    return g.join(F.broadcast(t)).withColumn("shrunk", F.col("_grand") + share * (F.col("own") - F.col("_grand"))).select(group, "n", "own", "shrunk")
