"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "steadfast", **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; keyword arguments are settings with _ for the dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(os.cpu_count() if (master or "").startswith("local") else 200),
    }
    for k, v in {**defaults, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
