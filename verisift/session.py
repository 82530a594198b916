"""A session with the settings the engine expects. Where a master is given already (spark-submit), it and the sizes stay."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession


def get_spark(app: str = "verisift", cores: str | None = None, shuffle: int | None = None, **conf: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    submitted = "master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or "SPARK_ENV_LOADED" in os.environ
    if not submitted and SparkContext._active_spark_context is None:
        here = {
            "spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(shuffle or cores), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="verisift-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="verisift-warehouse-"),
        }
        for key, value in here.items():
            builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
