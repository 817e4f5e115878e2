"""Regressions of any number of regressors from one aggregation of cross products; each group's small system is solved in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measure import gram


def _systems(rows: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros((len(rows), k, k)), np.zeros((len(rows), k))
    for i in range(k):
        b[:, i] = rows[f"zr_{i}"]
        for j in range(i, k):
            a[:, i, j] = a[:, j, i] = rows[f"zz_{i}_{j}"]
    return a, b


def least_squares(df: DataFrame, by: list[str], x: list[str], y: str, ridge: list[float] | float = 0.0, min_n: int = 0, weight: str | None = None) -> DataFrame:
    """(by, n, beta, se, r2): y on a constant and ``x`` in each group; rows with a null in any of them are left out.

    ``beta`` and ``se`` are arrays, the constant first. Groups of no more rows than coefficients or fewer than ``min_n``, and such
    whose regressors are dependent, don't come back. ``ridge`` is added to the squares of the regressors (never the constant);
    standard errors are those of plain least squares. Only one row a group leaves the aggregation.
    """
    names = ["_one", *x]
    full = df.where(F.col(y).isNotNull())
    for c in x:
        full = full.where(F.col(c).isNotNull())
    root = F.sqrt(F.col(weight)) if weight else F.lit(1.0)
    scaled = full.select(*by, root.alias("_one"), *[(F.col(c).cast("double") * root).alias(c) for c in x], (F.col(y).cast("double") * root).alias("_y"), (F.col(y).cast("double") * root * root).alias("_w"))
    sums = gram(scaled, by, names, "_y").where(F.col("n") >= max(min_n, len(names) + 1))
    k = len(names)
    added = np.diag([0.0, *(ridge if isinstance(ridge, list) else [ridge] * len(x))])
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            a, b = _systems(rows, k)
            a = a + added
            # A regressor that the others make up has a pivot of rounding error only.
            size = np.sqrt(np.maximum(np.einsum("gii->gi", a), 1e-300))
            sound = np.linalg.eigvalsh(a / size[:, :, None] / size[:, None, :])[:, 0] > 1e-10
            rows, a, b = rows[sound], a[sound], b[sound]
            inverse = np.linalg.inv(a)
            beta = np.einsum("gij,gj->gi", inverse, b)
            left = rows["rr"].to_numpy() - 2 * (beta * b).sum(1) + np.einsum("gi,gij,gj->g", beta, a - added, beta)
            free = rows["n"].to_numpy() - k
            se = np.sqrt(np.maximum(left / free, 0)[:, None] * np.einsum("gii->gi", inverse))
            total = rows["rr"].to_numpy() - b[:, 0] ** 2 / a[:, 0, 0]
            with np.errstate(invalid="ignore", divide="ignore"):
                r2 = np.where(total > 0, 1 - left / total, np.nan)
            yield rows[[*by, "n"]].assign(beta=list(beta), se=list(se), r2=r2)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "n"]), "beta array<double>, se array<double>, r2 double"])
    return sums.mapInPandas(run, schema)


def lag_design(df: DataFrame, by: list[str], order: list[str], value: str, lags: int) -> tuple[DataFrame, list[str]]:
    """``df`` with l1 ... l``lags`` of a value, rows without all of them left out; and the names."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    names = [f"l{k}" for k in range(1, lags + 1)]
    out = df.select("*", *[F.lag(value, k).over(w).alias(n) for k, n in enumerate(names, 1)])
    return out.where(F.col(names[-1]).isNotNull()), names


def dummies(df: DataFrame, column: str, levels: list[str]) -> tuple[DataFrame, list[str]]:
    """One column of 0 or 1 for each level but the first; unseen levels are all 0."""
    names = [f"{column}_{k}" for k in range(1, len(levels))]
    return df.withColumns({n: F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for n, v in zip(names, levels[1:], strict=True)}), names


def fama_macbeth(df: DataFrame, date: str, x: list[str], y: str, min_n: int = 30) -> DataFrame:
    """(regressor, dates, mean, t) of the daily coefficients; the deviation counts all dates (no correction), more than two are needed."""
    daily = least_squares(df, [date], x, y, min_n=min_n)
    each = daily.select(date, F.explode(F.arrays_zip(F.lit(["const", *x]).alias("regressor"), F.col("beta").alias("b"))).alias("c")).select("c.regressor", "c.b")
    return each.groupBy("regressor").agg(F.count("*").alias("dates"), F.avg("b").alias("mean"), (F.sqrt(F.count("*")) * F.avg("b") / F.nullif(F.stddev_pop("b"), F.lit(0.0))).alias("t")).where("dates > 2")


def standardised(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less the mean of the training rows, by their deviation; constants become 0. One row of moments is joined."""
    stats = df.where(train).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    out = df.join(F.broadcast(stats))
    return out.withColumns({c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}).drop(*stats.columns)
