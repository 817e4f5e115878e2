"""One-to-one matching and first-in-first-out lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th left row of a key meets its k-th right row."""
    l = left.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    r = right.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)))
    return l.join(r, [*keys, "_k"]).drop("_k")


def mutual_best(pairs: DataFrame, left_id: str, right_id: str, score: str) -> DataFrame:
    """Pairs in which each side is the other's best: least score, then least partner."""
    l = F.row_number().over(Window.partitionBy(left_id).orderBy(score, right_id))
    r = F.row_number().over(Window.partitionBy(right_id).orderBy(score, left_id))
    return pairs.withColumns({"_a": l, "_b": r}).where("_a = 1 and _b = 1").drop("_a", "_b")


def fifo_lots(trades: DataFrame, entity: str, order: list[str], is_buy: Column, amount: str, ident: str) -> DataFrame:
    """(entity, buy_id, sell_id, par): which sale takes how much of which buy, first in first out.

    Running sums turn the queue into a line: with B and S the amounts bought and sold so far and U the largest excess of S over B
    seen yet (sales that found nothing are dropped), buys end at B and sales at S - U. Between two neighbouring ends lies what one sale
    takes of one buy: those that end next. One ordered pass over the ends finds them; nothing is joined.
    """
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.select(entity, *order, F.col(ident).alias("_id"), is_buy.alias("_buy"), F.col(amount).cast("double").alias("_q")).where("_q > 0 and _buy is not null")
    t = t.withColumn("_B", F.sum(F.when(F.col("_buy"), F.col("_q")).otherwise(0.0)).over(w)).withColumn("_S", F.sum(F.when(F.col("_buy"), 0.0).otherwise(F.col("_q"))).over(w))
    t = t.withColumn("_U", F.greatest(F.lit(0.0), F.max(F.col("_S") - F.col("_B")).over(w)))
    ends = t.select(entity, *order, F.when(F.col("_buy"), F.col("_B")).otherwise(F.col("_S") - F.col("_U")).alias("_at"), F.when(F.col("_buy"), F.col("_id")).alias("_b"), F.when(~F.col("_buy"), F.col("_id")).alias("_s"))
    line = Window.partitionBy(entity).orderBy("_at", *order)
    ahead = line.rowsBetween(0, Window.unboundedFollowing)
    # Of sales that end at one place only the first took something; its row comes first.
    cut = ends.select(entity, F.first("_b", ignorenulls=True).over(ahead).alias("buy_id"), F.first("_s", ignorenulls=True).over(ahead).alias("sell_id"), (F.col("_at") - F.coalesce(F.lag("_at").over(line), F.lit(0.0))).alias("par"))
    return cut.where("par > 0 and buy_id is not null and sell_id is not null")


def tiered_match(left: DataFrame, right: DataFrame, keys: list[str], par: str, day: str, left_id: str, right_id: str, near: float = 0.25) -> DataFrame:
    """(left_id, right_id, tier): one-to-one, in three tiers, each on what those before left over.

    1: the same keys, day and par, the k-th with the k-th. 2: the same keys and day, par within ``near``, each the other's nearest.
    3: the same keys and par, one weekday apart, each the other's nearest. Candidates of tiers 2 and 3 meet under keys and day (or par).
    """
    from ..functions.special import business_day_number

    a = left.select(*keys, F.col(par).alias("_pa"), F.col(day).alias("_da"), F.col(left_id).alias("_left"))
    b = right.select(*keys, F.col(par).alias("_pb"), F.col(day).alias("_db"), F.col(right_id).alias("_right"))
    first = ordinal_match(a.withColumnsRenamed({"_pa": "_p", "_da": "_d"}), b.withColumnsRenamed({"_pb": "_p", "_db": "_d"}), [*keys, "_p", "_d"], ["_left"], ["_right"]).select("_left", "_right", F.lit(1).alias("tier"))
    rest = lambda x, y, done: (x.join(done, "_left", "left_anti"), y.join(done, "_right", "left_anti"))
    a, b = rest(a, b, first)
    met = a.join(b.withColumn("_da", F.col("_db")), [*keys, "_da"]).withColumn("_gap", F.abs(F.col("_pb") / F.col("_pa") - 1)).where(F.col("_gap") <= near)
    second = mutual_best(met, "_left", "_right", "_gap").select("_left", "_right", F.lit(2).alias("tier"))
    a, b = rest(a, b, second)
    step = business_day_number(F.col("_da"))
    sided = a.select("*", F.explode(F.array(step - 1, step + 1)).alias("_n"))
    met = sided.join(b.select(*keys, "_right", F.col("_pb").alias("_pa"), business_day_number(F.col("_db")).alias("_n")), [*keys, "_pa", "_n"]).withColumn("_gap", F.lit(1))
    third = mutual_best(met, "_left", "_right", "_gap").select("_left", "_right", F.lit(3).alias("tier"))
    return first.unionByName(second).unionByName(third).select(F.col("_left").alias(left_id), F.col("_right").alias(right_id), "tier")
