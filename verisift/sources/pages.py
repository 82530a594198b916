"""Pages of text spans in the order they are read: columns by the gutters between spans, lines, raised and lowered parts.

Spans are rows (page, x0, y0, x1, y1, size, text), y growing downwards. All steps are unions of intervals by one sweep
(gaps and islands in windows): gaps across a page are gutters, gaps down a column part its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# ---- fixed values --------------------------------------------------------------------------------
FULL = 0.6  # of a page's width: what is wider stands over all columns
GUTTER = 12.0  # points
LEAST = 5  # spans that make a column
SMALL = 0.8  # of a line's largest size: what is no larger is raised or lowered
CAPTION = r"(?i)^(?:fig(?:ure)?|table)\.?\s*[0-9]+"
NUMBERED = r"^(?:[0-9]+(?:\.[0-9]+)*|[IVX]+)\.?\s+\S"
# --------------------------------------------------------------------------------------------------


def islands(df: DataFrame, by: list[str], start: str, end: str, gap: Column, name: str) -> DataFrame:
    """Numbers from 0 the unions of intervals [start, end] that lie no further apart than `gap`; equal ones share a number."""
    order = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(start) > reach + gap, F.lit(False)).cast("int")
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("_fresh")


def with_columns(spans: DataFrame, page: str = "page") -> DataFrame:
    """Spans with `col` (-1: over all columns) and `band`, the top of the last such span at or above: bands are read one
    after the other, in each the columns from left to right. A page with fewer than two columns of LEAST spans has one."""
    width = F.max("x1").over(W.partitionBy(page)) - F.min("x0").over(W.partitionBy(page))
    rows = spans.withColumn("full", F.col("x1") - F.col("x0") > width * FULL)
    cut = islands(rows.where("NOT full"), [page], "x0", "x1", F.lit(GUTTER), "col")
    sizes = cut.groupBy(page, "col").count().groupBy(page).agg(F.count_if(F.col("count") >= LEAST).alias("n_columns"))
    cut = cut.join(sizes, page).withColumn("col", F.when(F.col("n_columns") >= 2, F.col("col")).otherwise(0)).drop("n_columns")
    rows = cut.unionByName(rows.where("full").withColumn("col", F.lit(-1).cast(cut.schema["col"].dataType)))
    above = W.partitionBy(page).orderBy("y0").rangeBetween(W.unboundedPreceding, 0)
    return rows.withColumn("band", F.coalesce(F.max(F.when(F.col("full"), F.col("y0"))).over(above), F.lit(float("-inf")))).drop("full")


def read_lines(spans: DataFrame, page: str = "page") -> DataFrame:
    """(page, no, col, text, x0, y0, x1, y1, size): lines in reading order, numbered from 0 on each page.

    Spans whose heights overlap stand on one line, so raised and lowered ones stay with their base: they follow it without
    a space, behind ^ or _ by the side their middle lies on; others are parted by spaces."""
    rows = with_columns(spans, page)
    rows = islands(rows, [page, "band", "col"], "y0", "y1", F.lit(-0.25) * F.col("size"), "line")
    line = [page, "band", "col", "line"]
    part = F.struct("x0", "text", "size", ((F.col("y0") + F.col("y1")) / 2).alias("mid"))
    lines = rows.groupBy(*line).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("size").alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max_by(((F.col("y0") + F.col("y1")) / 2), F.struct("size", -F.col("x0"))).alias("base"))
    sign = lambda p: F.when(p["size"] > F.col("size") * SMALL, F.lit(" ")).when(p["mid"] < F.col("base"), F.lit("^")).otherwise(F.lit("_"))
    text = F.ltrim(F.array_join(F.transform("parts", lambda p: F.concat(sign(p), p["text"])), ""))
    no = F.row_number().over(W.partitionBy(page).orderBy("band", "col", "line")) - 1
    return lines.select(page, no.alias("no"), "col", text.alias("text"), "x0", "y0", "x1", "y1", "size")


def two_columns(lines: DataFrame, width: float, page: str = "page") -> DataFrame:
    """(page, two): whether five lines or more, a third of the page wide, begin in its right half."""
    right = (F.col("x0") > width / 2 - 10) & (F.col("x1") - F.col("x0") > 0.3 * width)
    return lines.groupBy(page).agg((F.count_if(right) >= 5).alias("two"))


def headings(lines: DataFrame, doc: str = "doc", bold: Column | None = None) -> DataFrame:
    """Lines with `heading`: short ones without a sentence's end that are no captions and are larger than the body text (the
    document's commonest size by signs), or bold or numbered in capitals at its size."""
    sizes = lines.groupBy(doc, F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"))
    body = sizes.groupBy(doc).agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))
    text, strong = F.col("text"), F.lit(False) if bold is None else F.coalesce(bold, F.lit(False))
    numbered = text.rlike(NUMBERED)
    letters = F.regexp_replace(F.when(numbered, F.regexp_replace(text, r"^\S+\s+", "")).otherwise(text), "[^A-Za-z]", "")
    capitals = (F.length(letters) >= 4) & (F.upper(letters) == letters)
    shape = (F.length(text) <= 90) & ~text.rlike("[.:,;]$") & ~text.rlike(CAPTION) & text.rlike("[A-Za-z]{3}")
    size = F.col("size")
    large = (size > F.col("body") + 1.2) | (numbered & (strong | capitals) & (size >= F.col("body") - 0.6)) | (strong & capitals & (size >= F.col("body") - 0.2))
    return lines.join(body, doc).withColumn("heading", F.coalesce(shape & large, F.lit(False))).drop("body")
