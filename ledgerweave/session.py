"""Session construction with the settings the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "ledgerweave", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, ANSI, AQE, few shuffle partitions.

    On a cluster, build the session outside and pass it to the operators;
    none of them needs anything that is set here except UTC.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("LEDGERWEAVE_SHUFFLE", "8"))
        .config("spark.driver.memory", os.environ.get("LEDGERWEAVE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerweave-"))
    return spark
