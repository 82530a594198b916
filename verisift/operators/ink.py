"""Ink on pictures: running sums over two axes, the ink of any rectangle by four look-ups, and labels where they cover least."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# ---- fixed values --------------------------------------------------------------------------------
BAND = 0.07  # of a picture's height: what a line of a label takes
CLEAN = 0.015  # a band with no more ink than this is free
ROOM_ABOVE, ROOM_BELOW = 0.08, 0.90
# --------------------------------------------------------------------------------------------------


def summed_area(pixels: DataFrame, dark: Column, image: str = "image") -> DataFrame:
    """(image, x, y, total): dark pixels from the corner up to each pixel, for pixels (image, x, y) of whole grids.

    Sums along each row, then down each column; the two windows deal rows and columns out, not pictures."""
    along = W.partitionBy(image, "y").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(image, "x").orderBy("y").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = pixels.select(image, "x", "y", F.sum(F.coalesce(dark, F.lit(False)).cast("long")).over(along).alias("row"))
    return rows.select(image, "x", "y", F.sum("row").over(down).alias("total"))


def ink_of(rectangles: DataFrame, sums: DataFrame, key: list[str], image: str = "image") -> DataFrame:
    """(key, ink): the share of dark pixels in rectangles (key, image, x0, y0, x1, y1), ends excluded; 0 for empty ones."""
    corner = lambda x, y, sign: F.struct((F.col(x) - 1).cast("long").alias("x"), (F.col(y) - 1).cast("long").alias("y"), F.lit(sign).alias("sign"))
    corners = F.array(corner("x1", "y1", 1), corner("x0", "y1", -1), corner("x1", "y0", -1), corner("x0", "y0", 1))
    area = F.greatest(F.lit(0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0), F.col("y1") - F.col("y0"))
    asked = rectangles.select(*key, image, area.alias("area"), F.explode(corners).alias("c")).select(*key, image, "area", "c.*")
    found = asked.join(sums, [image, "x", "y"], "left").groupBy(*key, "area").agg(F.sum(F.col("sign") * F.coalesce("total", F.lit(0))).alias("dark"))
    return found.select(*key, F.when(F.col("area") > 0, F.col("dark") / F.col("area")).otherwise(0.0).alias("ink"))


def place_labels(boxes: DataFrame, pixels: DataFrame, dark: Column, image: str = "image") -> DataFrame:
    """(image, box, place, ink, covers): where the label of each marked box goes.

    Boxes (image, box, x, y, w, h, label_at) are shares of the picture. A stated place holds. Else above where there is
    room and no ink, then below; else the one of above, below and inside that covers least, of equals the first by name.
    `covers` says that even this place has ink under it."""
    size = pixels.groupBy(image).agg((F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph"))
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    band = lambda name, top, bottom, room: F.struct(F.lit(name).alias("place"), top.alias("top"), bottom.alias("bottom"), room.alias("room"))
    bands = F.array(
        band("above", F.greatest(F.lit(0.0), y - BAND), y, y >= ROOM_ABOVE), band("below", y + h, F.least(F.lit(1.0), y + h + BAND), y + h <= ROOM_BELOW), band("inside", y, F.least(F.lit(1.0), y + BAND), F.lit(True)))
    rows = boxes.join(size, image).select(image, "box", "label_at", x.alias("left"), (x + w).alias("right"), "pw", "ph", F.explode(F.filter(bands, lambda b: b["room"])).alias("b"))
    low = lambda v, n: F.greatest(F.lit(0), F.floor(v * n)).cast("long")
    high = lambda v, n: F.least(n, F.floor(v * n + 0.5)).cast("long")
    rows = rows.select(image, "box", "label_at", F.col("b.place").alias("place"), low(F.col("left"), F.col("pw")).alias("x0"), high(F.col("right"), F.col("pw")).alias("x1"), low(F.col("b.top"), F.col("ph")).alias("y0"), high(F.col("b.bottom"), F.col("ph")).alias("y1"))
    ink = ink_of(rows, summed_area(pixels, dark, image), [image, "box", "label_at", "place"], image)
    free = lambda name: F.bool_or((F.col("place") == name) & (F.col("ink") <= CLEAN))
    chosen = ink.groupBy(image, "box", "label_at").agg(free("above").alias("above"), free("below").alias("below"), F.min(F.struct("ink", "place")).alias("least"), F.map_from_entries(F.collect_list(F.struct("place", "ink"))).alias("inks"))
    place = F.coalesce("label_at", F.when(F.col("above"), F.lit("above")).when(F.col("below"), F.lit("below")).otherwise(F.col("least.place")))
    out = chosen.select(image, "box", "label_at", place.alias("place"), "inks").withColumn("ink", F.try_element_at("inks", F.col("place")))
    return out.select(image, "box", "place", "ink", (F.col("label_at").isNull() & (F.col("ink") > CLEAN)).alias("covers"))


def ink_rectangles(pixels: DataFrame, dark: Column, image: str = "image") -> DataFrame:
    """(image, x0, y0, x1, y1, n): the smallest rectangle that holds all dark pixels, ends excluded."""
    return pixels.where(dark).groupBy(image).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("n"))
