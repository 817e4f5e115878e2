"""As-of joins: one ordered pass over both sides instead of a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], *, strict: bool = True, forward: bool = False, order: list[str] | None = None, prefix: str = "asof_") -> DataFrame:
    """``left`` with, of the nearest earlier (``forward``: later) right row of its keys, its time and ``values`` under a prefix.

    ``strict`` leaves out equal times. Of right rows with one time the last by ``order`` is taken (forward: the first).
    Left rows without a match have nulls, and so have those with a null key or time; right rows with one match nothing. ``left`` must not repeat in its order of all its columns for equal results twice.
    Both sides are dealt out by the keys once; a key's rows are read in order, not gathered.
    """
    order = order or []
    body = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(c) for c in values])
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    r = right.where(known & F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), body.alias("_r"), F.struct(*order).alias("_o") if order else F.lit(0).alias("_o"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_l"))
    o_type = r.schema["_o"].dataType
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(None).cast(o_type).alias("_o"), F.struct("*").alias("_l"))
    both = r.unionByName(l)
    # Of equal times: strict puts left rows first when looking back (last when looking ahead), inclusive the other way.
    side = F.col("_side") if strict != forward else -F.col("_side")
    w = Window.partitionBy(*keys).orderBy("_t", side, "_o")
    if forward:
        found = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_f", F.when(known & F.col("_t").isNotNull(), found)).where("_side = 0")
    return out.select("_l.*", F.col("_f.t").alias(prefix + right_time), *[F.col(f"_f.{c}").alias(prefix + c) for c in values])


def asof_either(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], order: list[str] | None = None, prefix: str = "asof_") -> DataFrame:
    """The first right row at or after the left time; where there is none, the last one before it."""
    ahead = asof_join(left, right, keys, left_time, right_time, values, strict=False, forward=True, order=order, prefix="_ahead_")
    both = asof_join(ahead, right, keys, left_time, right_time, values, strict=True, order=order, prefix="_back_")
    later = F.col(f"_ahead_{right_time}").isNotNull()
    return both.select(*left.columns, *[F.when(later, F.col(f"_ahead_{c}")).otherwise(F.col(f"_back_{c}")).alias(prefix + c) for c in [right_time, *values]])


def asof_aged(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], least_age: int, most_age: int, prefix: str = "asof_") -> DataFrame:
    """The last right row that is ``least_age`` to ``most_age`` days older than the left date."""
    dated = left.withColumn("_at", F.date_sub(F.col(left_time), least_age))
    found = asof_join(dated, right, keys, "_at", right_time, values, strict=False, prefix=prefix)
    fresh = F.datediff(F.col(left_time), F.col(prefix + right_time)) <= most_age
    return found.select(*left.columns, *[F.when(fresh, F.col(prefix + c)).alias(prefix + c) for c in [right_time, *values]])
