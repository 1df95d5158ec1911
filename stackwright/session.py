"""Session settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "stackwright", cpus: int | str | None = None, **extra: str) -> SparkSession:
    """A local session, or the running one.

    On a cluster the master, memory and shared folders come from spark-submit; only settings that
    change results (time zone) or let Spark re-plan (adaptive execution) are set here.
    """
    builder = SparkSession.builder.appName(app)
    if cpus is not None or "SPARK_REMOTE" not in os.environ and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cpus or '*'}]")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
