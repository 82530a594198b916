"""Cutting lineage through the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(_forget)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/verisift-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """`df` marked for broadcast if it has at most so many rows; counted first, so a large one is shuffled as ever."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def staged_loop(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], rounds: int) -> DataFrame:
    """step until done, each round written down and the one before deleted; an error if it is not done after `rounds`."""
    path = None
    for _ in range(rounds):
        if done(df):
            return df
        df, new = written(step(df), "round")
        if path:
            _delete(df.sparkSession, path)
        path = new
    if not done(df):
        raise RuntimeError(f"not done after {rounds} rounds")
    return df
