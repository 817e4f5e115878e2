"""Choices on grids: the best point of a fill curve, win rules, and levels found by bisection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax_on_curve(requests: DataFrame, curves: DataFrame, key: str, charge: str, width: float) -> DataFrame:
    """``requests`` with best_q, best_p, best_u: the first maximum of (q + width + charge) * p over the key's curve (pos, q, p).

    Solved once for each different (key, charge). Missing keys and null charges give nulls.
    """
    cases = requests.select(key, charge).where(F.col(charge).isNotNull()).distinct()
    u = (F.col("q") + width + F.col(charge)) * F.col("p")
    best = cases.join(curves, key).withColumn("_u", u).groupBy(key, charge).agg(F.max_by(F.struct("q", "p", F.col("_u").alias("u")), F.struct("_u", -F.col("pos"))).alias("_b"))
    return requests.join(best, [key, charge], "left").select(*requests.columns, F.col("_b.q").alias("best_q"), F.col("_b.p").alias("best_p"), F.col("_b.u").alias("best_u"))


def wins(group: Column, distance: Column) -> Column:
    """Lost-but-printed requests (group 3) are won strictly beyond the threshold, others at it; null distances are lost."""
    return F.coalesce(F.when(group == 3, distance > 1e-6).otherwise(distance >= -1e-6), F.lit(False))


def level_to(rows: DataFrame, by: str, distance: str, target: str, reach: float = 40.0, steps: int = 16) -> DataFrame:
    """(by, level): the shift, by bisection within +-reach, at which the share of distance >= shift comes down to ``target``.

    Above the target the search keeps share(low) > target and returns the upper end; below it keeps share(high) >= target
    and returns the lower end. A group's distances are read at once.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        d, goal = np.sort(group[distance].to_numpy(float)), float(group[target].iloc[0])
        share = lambda w: 1 - np.searchsorted(d, w - 1e-6) / len(d)
        rate = share(0.0)
        if rate == goal:
            level = 0.0
        else:
            low, high = (0.0, reach) if rate > goal else (-reach, 0.0)
            for _ in range(steps):
                mid = (low + high) / 2
                if share(mid) > goal if rate > goal else share(mid) < goal:
                    low, high = (mid, high) if rate > goal else (low, mid)
                else:
                    low, high = (low, mid) if rate > goal else (mid, high)
            level = high if rate > goal else low
        return pd.DataFrame({by: [group[by].iloc[0]], "level": [level]})

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, distance, target).where(F.col(distance).isNotNull()).groupBy(by).applyInPandas(solve, f"{by} {kind}, level double")
