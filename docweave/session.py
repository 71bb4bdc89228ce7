"""A session with the settings the plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "docweave", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, shuffle partitions from the cores; anything in conf wins."""
    cores = os.cpu_count() or 4
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
