"""Sessions and the settings that all queries rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it (a checkout that all machines see,
    or one machine). On a cluster without such a folder, ship the package with ``spark.submit.pyFiles``."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; everything else is left to the cluster."""
    builder = SparkSession.builder.appName("panelspan")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return share_code(builder.config(map=settings | conf).getOrCreate())
