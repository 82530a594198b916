"""Boxes on pages: overlaps, points in boxes, contrast, axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bundles(rows: DataFrame, by: list[str], key: str, most: int = 256) -> DataFrame:
    """(by.., members): the keys of rows that agree in `by`, in bundles of some `most`, so that no row of the result grows
    with its group."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.join(sizes.hint("merge"), by).withColumn("_part", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / most)))
    return dealt.groupBy(*by, "_part").agg(F.collect_list(key).alias("members")).drop("_part")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, so that what is read off the bundles of one large group does not stay in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def overlap_pairs(boxes: DataFrame, page: str = "page", cell: float = 50.0, percent: int = 25) -> DataFrame:
    """(page, a, b, area): pairs of a page's boxes whose common area is `percent` of the smaller one or more.

    Boxes of one shape at one place are compared once, whatever their number: shapes are dealt to the grid cells they
    touch; a pair of shapes is compared in the one cell that holds the common part's lower left corner, so pairs come once
    and a crowded page is spread over its cells. Pairs of boxes are then read off the bundles of both shapes.
    """
    shape = ["x0", "y0", "x1", "y1"]
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    dealt = boxes.select(page, *shape).distinct().withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy", F.explode(F.sequence(at("y0"), at("y1"))))
    a, b = dealt.alias("a"), dealt.alias("b")
    x0, y0 = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    w, h = F.least("a.x1", "b.x1") - x0, F.least("a.y1", "b.y1") - y0
    smaller = F.expr("least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))")
    same = F.expr(f"a.{page} = b.{page} AND a.gx = b.gx AND a.gy = b.gy AND struct(a.x0, a.y0, a.x1, a.y1) <= struct(b.x0, b.y0, b.x1, b.y1) AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
    hits = a.join(b.hint("merge"), same).where((F.floor(x0 / cell) == F.col("a.gx")) & (F.floor(y0 / cell) == F.col("a.gy")))
    hits = hits.where(w * h * 100 >= smaller * percent).select(F.col(f"a.{page}").alias(page), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in shape], (w * h).alias("area"))
    side = lambda s: bundles(boxes, [page, *shape], "box").select(page, *[F.col(c).alias(f"{s}_{c}") for c in shape], F.col("members").alias(f"_{s}"))
    for s in "ab":
        hits = hits.join(side(s).hint("merge"), [page, *[f"{s}_{c}" for c in shape]])
    one = F.expr(" AND ".join(f"a_{c} = b_{c}" for c in shape))
    pairs = spread(hits).select(page, one.alias("one"), "area", "_b", F.explode("_a").alias("i")).select(page, "one", "area", "i", F.explode("_b").alias("j"))
    # boxes of one shape meet in both orders, others in one
    return pairs.where("i < j OR (i > j AND NOT one)").select(page, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "area")


def luminance(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.when(c / 255.0 <= 0.03928, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * part(r) + 0.7152 * part(g) + 0.0722 * part(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def nearest_above(captions: DataFrame, shapes: DataFrame, page: str = "page") -> DataFrame:
    """(page, caption, top): for each caption the lowest edge of a shape above it on its page: one pass in order of height.

    Rows (page, caption, at) and (page, edge). A caption stands before the shapes whose edge is at its own height; on a page
    without shapes its top is null, on others captions with nothing above are left out.
    """
    none = F.lit(None)
    rows = captions.select(page, "caption", F.col("at").alias("v"), F.lit(0).alias("shape"), none.cast("double").alias("edge"))
    rows = rows.unionByName(shapes.select(page, none.cast(dict(captions.dtypes)["caption"]).alias("caption"), F.col("edge").alias("v"), F.lit(1).alias("shape"), "edge"))
    over = W.partitionBy(page).orderBy("v", "shape").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("top", F.max("edge").over(over)).withColumn("some", F.max("shape").over(W.partitionBy(page)))
    return rows.where("shape = 0 AND (top IS NOT NULL OR some = 0)").groupBy(page, "caption").agg(F.max("top").alias("top"))
