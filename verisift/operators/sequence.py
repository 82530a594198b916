"""Operators that depend on order: lags, running sums, islands, as-of joins, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .._staging import written


def as_of(events: DataFrame, is_anchor: Column, by: str, order: list[str], value: str) -> Column:
    """The value of the last anchor at or before each row, in its partition: a window, no join."""
    return F.last(F.when(is_anchor, F.col(value)), ignorenulls=True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def islands(df: DataFrame, by: str, order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of neighbours: a new one begins where `breaks` holds (it may use `previous_*` lags)."""
    over = W.partitionBy(by).orderBy(*order)
    return df.withColumn("_b", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_b").over(over)).drop("_b")


def running(amount: Column, by: str, order: list[str]) -> Column:
    return F.sum(amount).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def gaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """(by, missing): numbers missing between 0 and the largest, from each row's distance to the one before."""
    before = F.coalesce(F.lag(number).over(W.partitionBy(by).orderBy(number)), F.lit(-1))
    holes = df.select(by, number).distinct().withColumn("p", before).where(F.col(number) - F.col("p") > 1)
    return holes.select(by, F.explode(F.sequence(F.col("p") + 1, F.col(number) - 1)).alias("missing"))


def new_here(values: str, by: str, order: list[str], shown: str) -> Column:
    """Values of a row that neither its own `shown` array nor the one before has."""
    before = F.coalesce(F.lag(shown).over(W.partitionBy(by).orderBy(*order)), F.array().cast("array<string>"))
    return F.array_except(F.array_except(F.col(values), F.col(shown)), before)


def renumbered(df: DataFrame, by: str, order: str, backup: Column, numbered: Column) -> DataFrame:
    """Main rows first, backup rows last; page numbers count only numbered rows and are null elsewhere."""
    placed = df.withColumn("_backup", backup.cast("int"))
    placed = placed.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("_backup", order)))
    count = F.sum(numbered.cast("int")).over(W.partitionBy(by).orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("page", F.when(numbered, count)).drop("_backup")


def numbered(df: DataFrame, by: str, order: list[str], name: str = "n") -> DataFrame:
    """Rows with their number from 0 among those of the same `by`, in this order. Rows are dealt out by ranges and each range is
    counted, so no group passes through one task; the ranges are written down, as their borders are drawn by a sample."""
    at, _ = written(df.orderBy(by, *order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    at = at.withColumn("_range", F.shiftrightunsigned("_at", 33))
    counts = at.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy("_by").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_by", "_of", (before - F.col("_first")).alias("_shift"))
    rows = at.join(starts, (F.col("_range") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")))
    return rows.withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)


def sections(lines: DataFrame, by: str, pos: str, is_head: Column, text: str) -> DataFrame:
    """Each line with the head it stands under: the last one at or before it."""
    return lines.withColumn("head", F.last(F.when(is_head, F.col(text)), ignorenulls=True).over(W.partitionBy(by).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)))
