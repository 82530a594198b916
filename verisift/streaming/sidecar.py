"""The sidecar upsert and event attribution on streams: extensions, the batch operators run on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from .._staging import shared_folder
from ..operators.provenance import upsert_by_tag


def upsert_stream(lines: DataFrame, state_path: str, checkpoint: str, tag: str = "tag") -> StreamingQuery:
    """Each micro-batch replaces its tags' lines in the state. States are versioned folders, the newest complete one
    counts, so a batch that is repeated after a failure gives the same state."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{state_path}/v{number - 1}"
        rows = batch.unionByName(batch.limit(0)) if number == 0 else upsert_by_tag(spark.read.schema(batch.schema).parquet(old), batch, tag)
        rows.write.mode("overwrite").parquet(f"{state_path}/v{number}")

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window with a watermark; the same expression serves a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def checkpoint_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"
