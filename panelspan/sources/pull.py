"""Pulls from services: symbols, batches of them side by side, retries, answers kept on disk, a registry of measures."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def retried(call: Callable, attempts: int = 4, pause: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """``call()``, made again after growing pauses when it raises; the last error stands."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            sleep(pause)
            pause *= factor


def symbols(catalogue: DataFrame, column: str, prefix: str, where: Column) -> DataFrame:
    """(symbol): the different names of a catalogue without their prefix."""
    return catalogue.where(where).select(F.regexp_replace(column, f"^{prefix}", "").alias("symbol")).distinct()


def batched(spark: SparkSession, partitions: list[str], names: list[str], size: int, fetch: Callable[[str, list[str]], list[tuple]], schema: str, attempts: int = 4) -> DataFrame:
    """(pkey, batch, the columns of ``schema``): ``fetch(pkey, names of a batch)`` for each partition and batch, a task each, retried.

    A lost task is pulled again by Spark; nothing of it has been written. Partition and batch say where a row is from.
    """
    plan = [(p, k, names[k * size : (k + 1) * size]) for p in partitions for k in range(-(-len(names) // size))]
    todo = spark.createDataFrame(plan, "pkey string, batch long, names array<string>").repartition(max(1, len(plan)), "pkey", "batch")
    columns = [f.split(" ")[0] for f in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for pkey, batch, own in zip(part["pkey"], part["batch"], part["names"], strict=True):
                rows = retried(lambda p=pkey, n=list(own): fetch(p, n), attempts)
                yield pd.DataFrame(rows, columns=columns).assign(pkey=pkey, batch=batch)[["pkey", "batch", *columns]]

    return todo.mapInPandas(run, f"pkey string, batch long, {schema}")


def enriched(requests: DataFrame, key: str, cache: str, answer: Callable[[list], list[str]], block: int = 1000) -> DataFrame:
    """``requests`` with answer, the service's text for each key; only keys that the table at ``cache`` lacks are asked for, and kept there.

    ``answer`` takes a list of keys, so that any client (or a stand-in for tests) can be put in its place.
    """
    spark = requests.sparkSession
    kind = requests.schema[key].dataType.simpleString()
    try:
        known = spark.read.parquet(cache)
    except Exception as e:  # nothing kept yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], f"{key} {kind}, answer string")
    new = requests.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), block):
                own = part[key].iloc[at : at + block].tolist()
                yield pd.DataFrame({key: own, "answer": retried(lambda o=own: answer(o))})

    new.mapInPandas(run, f"{key} {kind}, answer string").write.mode("append").parquet(cache)
    return requests.join(spark.read.parquet(cache), key, "left")


def record(spark: SparkSession, path: str, section: str, **values) -> None:
    """Adds measures to a registry: a row (section, name, value as JSON, written_at) each."""
    rows = [(section, k, json.dumps(v, sort_keys=True, default=str)) for k, v in sorted(values.items())]
    spark.createDataFrame(rows, "section string, name string, value string").withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The latest value of each (section, name)."""
    return spark.read.parquet(path).groupBy("section", "name").agg(F.max_by("value", "written_at").alias("value"))
