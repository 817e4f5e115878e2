"""Shapes of tables: columns wanted, missing values, samples, orders of categories, joins that must not multiply rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reindex(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns asked for, of the types given; those that aren't there are null, others go."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in all of the columns; NaN and infinities are none."""
    kinds = dict(df.dtypes)
    for c in columns:
        known = F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            known = known & ~F.isnan(c) & (F.abs(c) < float("inf"))
        df = df.where(known)
    return df


def excluding(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a rule doesn't hold; those for which it says nothing stay."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def sample(df: DataFrame, ident: str, share: float, seed: int = 7) -> DataFrame:
    """Rows whose hash of (id, seed) is in the least ``share``: the same ones wherever and however often it runs."""
    return df.where(F.substring(F.md5(F.concat_ws("-", F.col(ident).cast("string"), F.lit(str(seed)))), 1, 8) < f"{int(share * 2**32):08x}")


def in_category_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row for each category, those without a row with nulls, and its place."""
    places = df.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {column} string")
    return F.broadcast(places).join(df, column, "left")


def usable_features(df: DataFrame, columns: list[str], train: Column) -> list[str]:
    """Columns with at least two different values in the training rows."""
    found = df.where(train).agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if found[c]]


def single_match(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_right") -> DataFrame:
    """A left join that refuses right sides with two rows of one key, and gives columns of both sides a suffix on the right."""
    checked = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in keys])
    checked = checked.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"several rows of one {', '.join(keys)}"))).otherwise(F.col("_n")))
    # The check has to be read for it to be made.
    return left.join(checked.where("_n = 1").drop("_n"), keys, "left")


def searchsorted(values: DataFrame, value: str, edges: list[float], right: bool = False) -> DataFrame:
    """``values`` with place: how many edges are below the value (``right``: at or below)."""
    below = (lambda e: F.lit(e) <= F.col(value)) if right else (lambda e: F.lit(e) < F.col(value))
    return values.withColumn("place", sum((below(e).cast("int") for e in edges), F.lit(0)))


def lookup(df: DataFrame, key: str, table: dict, name: str, missing=None) -> DataFrame:
    """A column from a small map; keys that it doesn't have get ``missing``."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    found = F.element_at(pairs, F.col(key))
    return df.withColumn(name, found if missing is None else F.coalesce(found, F.lit(missing)))


def last_before(facts: DataFrame, key: str, time: str, cuts: DataFrame, cut: str, values: list[str]) -> DataFrame:
    """A dimension as each cut saw it: the last row before it, or, where there is none yet, the latest of all. ``cuts`` is small."""
    at = facts.join(F.broadcast(cuts)).groupBy(key, cut).agg(
        F.max_by(F.struct(*values), F.when(F.col(time) < F.col(cut), F.struct(time, *values))).alias("seen"),
        F.max_by(F.struct(*values), F.struct(time, *values)).alias("latest"),
    )
    return at.select(key, cut, *[F.when(F.col("seen").isNotNull(), F.col(f"seen.{v}")).otherwise(F.col(f"latest.{v}")).alias(v) for v in values])
