"""How the star-schema tables stand in for panels, tapes, quotes and fills; the same frames as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.window import keep_last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, d, value, event_type): the last event of each user and day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("d"), "value", "event_type")
    return keep_last(e, ["user_id", "d"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc_nulls_last()]).select("user_id", "d", "value", "event_type")


PANEL = "p AS (SELECT user_id, d, value, event_type FROM (SELECT *, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, d, value, side): events as prints; the side is P, S, D by kind, else null."""
    side = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "view", "S").when(F.col("event_type") == "click", "D")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("d"), "value", side.alias("side"))


TAPE = "t AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS d, value, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'view' THEN 'S' WHEN 'click' THEN 'D' END AS side FROM events)"
