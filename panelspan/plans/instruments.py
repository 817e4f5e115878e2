"""The instrument panel: from daily levels of many names to ranked characteristics and a target, in the order that the filters need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import robust
from ..operators import window as W


def rank_normalised(value: str, by: list[str]) -> Column:
    """Average-tie percent rank less a half; nulls become 0."""
    return F.coalesce(W.pct_rank(value, by) - 0.5, F.lit(0.0))


def term_characteristics(df: DataFrame, day: str, maturity: str, call: str, callable_: str, coupon: str, lagged_yield: str) -> DataFrame:
    """Adds priced_to_call (callable, the call ahead, the coupon above yesterday's yield), years to the date priced to, and
    extension, the years from there to maturity, never below 0."""
    to_call = F.coalesce(F.col(callable_) & (F.col(call) > F.col(day)) & (F.col(coupon) > F.col(lagged_yield)), F.lit(False))
    worst = F.when(to_call, F.col(call)).otherwise(F.col(maturity))
    years = lambda a, b: F.datediff(b, a) / 365.25
    return df.withColumns({"priced_to_call": to_call, "years_to_worst": years(F.col(day), worst), "extension": F.greatest(F.lit(0.0), years(worst, F.col(maturity)))})


def liquidity(value: str, ident: str, date: str, back: int = 20, least: int = 5) -> Column:
    """The share of rows with a changed value among the last ``back`` before the row; null for fewer than ``least``."""
    order = Window.partitionBy(ident).orderBy(date)
    # A name's first row has no change; the frame ends a row early, so that the day itself is not used.
    frame = order.rowsBetween(-back, -1)
    return F.when(F.count(value).over(frame) >= least, F.avg(F.col(value)).over(frame))


def instrument_panel(df: DataFrame, ident: str, date: str, level: str, kind: str, ratings: dict[str, int], state: str, *, scale: float = 100.0, most_gap: int = 7, k: float = 6.0, clip: float = 250.0, history: int = 5, date_size: int = 1000) -> DataFrame:
    """(ident, date, target, z_level, z_rating, z_liquidity, z_run, z_size, in_state): one row a name and date.

    In this order: yesterday's level and the gap; rows whose level, today's or yesterday's, is extreme for its date go; gaps of over
    ``most_gap`` days go; rating, state and liquidity; rows without a target go; the target is held within +-``clip``; rows since the level last
    changed; ranks among the rows left, less a half; then names with fewer than ``history`` rows and dates with fewer than ``date_size`` rows go, which
    have counted in the ranks.
    """
    order = Window.partitionBy(ident).orderBy(date)
    p = robust.mad_flags(df, level, [date], k).withColumns({"_lag": F.lag(level).over(order), "_gap": F.datediff(date, F.lag(date).over(order)), "_was": F.lag("extreme").over(order)})
    p = p.withColumn("_moved", (F.col(level) != F.col("_lag")).cast("double"))
    p = p.where(~(F.col("extreme") | F.coalesce("_was", F.lit(False))) & (F.col("_gap") <= most_gap))
    table = F.create_map(*[x for n, v in ratings.items() for x in (F.lit(n), F.lit(v))])
    p = p.withColumns({"_rating": F.element_at(table, F.col(kind)).cast("double"), "in_state": (F.col(kind) == state).cast("double"), "_liquid": liquidity("_moved", ident, date)})
    p = p.where("_lag is not null").withColumn("target", robust.clip(scale * (F.col(level) - F.col("_lag")), F.lit(-clip), F.lit(clip)))
    p = p.withColumn("_run", W.run_length(F.col("_moved") == 1, [ident], [date]))
    since = Window.partitionBy(ident, "_run").orderBy(date)
    p = p.withColumn("_still", F.row_number().over(since) - 1)
    p = p.withColumns({f"z_{n}": rank_normalised(c, [date]) for n, c in (("level", "_lag"), ("rating", "_rating"), ("liquidity", "_liquid"), ("run", "_still"))})
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy(ident))).where(F.col("_n") >= history)
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy(date))).where(F.col("_n") >= date_size)
    return p.select(ident, date, "target", "z_level", "z_rating", "z_liquidity", "z_run", "in_state")
