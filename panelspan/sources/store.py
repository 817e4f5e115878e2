"""Partitioned tables with a manifest: scans, dynamic overwrites, completeness, incremental merges."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.window import keep_last

MANIFEST = "pkey string, rows long, window_start date, window_end date, written_at timestamp"


def partitions(start: date, end: date, kind: str = "month") -> list[tuple[str, date, date]]:
    """(key, start, end) of the months or weeks (from Monday) that hold a day from ``start`` to ``end``; ends are exclusive, both clipped.

    Months count from year 0, weeks from Monday 1970-01-05; each number stands for the span up to where the next one begins.
    """
    monday = date(1970, 1, 5)
    if kind == "month":
        number = lambda d: d.year * 12 + d.month - 1
        begin = lambda n: date(n // 12, n % 12 + 1, 1)
        name = lambda n: f"{n // 12:04d}-{n % 12 + 1:02d}"
    else:
        number = lambda d: (d - monday).days // 7
        begin = lambda n: monday + timedelta(days=7 * n)
        name = lambda n: begin(n).strftime("%Y-W%W")
    beyond = end + timedelta(days=1)
    return [(name(n), max(begin(n), start), min(begin(n + 1), beyond)) for n in range(number(start), number(end) + 1)] if start <= end else []


@dataclass(frozen=True)
class PartitionStore:
    """A Parquet table partitioned by ``pkey`` beside a manifest table of what was written when."""

    spark: SparkSession
    path: str

    def write(self, df: DataFrame, windows: list[tuple[str, date, date]]) -> None:
        """Replaces the partitions of the windows by the rows of ``df`` (with pkey), and adds to the manifest a row for each window.

        A window without rows is emptied: its folder goes. The manifest is written last, so that a pull that broke off isn't taken for done.
        Counts are those of ``df``; the rest of the table isn't read.
        """
        named = df.where(F.col("pkey").cast("string").isin([k for k, _, _ in windows]))
        counts = {str(r.pkey): r.n for r in named.groupBy("pkey").agg(F.count("*").alias("n")).collect()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for key, _, _ in windows:
            if key not in counts:
                place = hadoop.Path(f"{self.path}/data/pkey={key}")
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        if counts:
            named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("pkey").parquet(f"{self.path}/data")
        rows = [(k, counts.get(k, 0), a, b) for k, a, b in windows]
        entries = self.spark.createDataFrame(rows, "pkey string, rows long, window_start date, window_end date").withColumn("written_at", F.current_timestamp())
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def manifest(self) -> DataFrame:
        """The latest entry of each partition; none where nothing was written."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except Exception as e:  # a store that was never written to
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)
        return keep_last(rows, ["pkey"], [F.col("written_at").desc_nulls_last()])

    def read(self, columns: list[str] | None = None, where: Column | None = None, keys: list[str] | None = None) -> DataFrame:
        """The table; unknown columns are left out. Columns that only later partitions have are kept."""
        df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/data").withColumn("pkey", F.col("pkey").cast("string"))
        if keys is not None:
            df = df.where(F.col("pkey").isin(keys))
        if where is not None:
            df = df.where(where)
        return df.select(*[c for c in columns if c in df.columns]) if columns else df

    def missing(self, windows: list[tuple[str, date, date]], force: bool = False) -> list[str]:
        """Partitions to pull: those that weren't written after their window's end (all, with ``force``)."""
        done = {r.pkey for r in self.manifest().where(F.to_date("written_at") > F.col("window_end")).select("pkey").collect()}
        return [k for k, _, _ in windows if force or k not in done]


def merge_keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new rows, the last of each key by ``order``; keys that are null go, columns of either stay."""
    both = old.unionByName(new, allowMissingColumns=True).na.drop(subset=keys)
    return keep_last(both, keys, [F.col(c).desc_nulls_last() for c in order])


def closing_marks(marks: DataFrame, ident: str = "ident", date: str = "date", level: str = "level", order: list[str] | None = None, window: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(marks, audit): one mark a (ident, date) within the window (both ends in), the last by ``order``, where nulls lose.

    Levels are percent: a column whose median size over finite values is under 1 is taken for decimals. The audit has one row:
    rows_read, rows_kept, idents and dates.
    """
    if window:
        marks = marks.where(F.col(date).between(*window))
    size = marks.select(F.median(F.when(~F.isnan(level) & (F.abs(level) < float("inf")), F.abs(level))).alias("_size"))
    scaled = marks.join(F.broadcast(size)).withColumn(level, F.when(F.col("_size") < 1, F.col(level) * 100).otherwise(F.col(level))).drop("_size")
    kept = keep_last(scaled, [ident, date], [F.col(c).desc_nulls_last() for c in order or ["source", "published", "sequence"]])
    each = marks.groupBy(ident, date).agg(F.count("*").alias("k"))
    return kept, each.agg(F.sum("k").alias("rows_read"), F.count("*").alias("rows_kept"), F.count_distinct(ident).alias("idents"), F.count_distinct(date).alias("dates"))


def read_curves(lines: DataFrame) -> DataFrame:
    """Snapshots (file, json) -> (file, key, pos, quantile_bp, prob); quantiles are scaled by stdev and mean, in hundredths."""
    kind = "map<string,struct<quantiles:array<double>,stdev:double,mean:double,probabilities:array<double>>>"
    each = lines.select("file", F.explode(F.from_json("json", kind)).alias("key", "c"))
    pairs = each.select("file", "key", "c", F.posexplode(F.arrays_zip(F.col("c.quantiles").alias("q"), F.col("c.probabilities").alias("p"))).alias("pos", "x"))
    return pairs.select("file", "key", "pos", ((F.col("x.q") * F.col("c.stdev") + F.col("c.mean")) * 100).alias("quantile_bp"), F.col("x.p").alias("prob"))


def cached(spark: SparkSession, root: str, name: str, spec: dict, build) -> DataFrame:
    """The table of a stage, built once for each content of ``spec``; a table counts as built when its job was committed."""
    path = f"{root}/{name}-{hashlib.sha1(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        # What a job that broke off left is written over.
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
