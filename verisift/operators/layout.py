"""What lies where on a page, as joins and sums over rows of boxes, cells, pixels and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cells as C, text as T
from .geometry import bundles, spread


def crossed_boxes(paths: DataFrame, boxes: DataFrame, page: str = "page", steps: int = 20, cell: float = 50.0) -> DataFrame:
    """(page, path, box, n): boxes that a straight path runs through, by so many of its evenly spaced inner points.

    Rows (page, path, x0, y0, x1, y1) and (page, box, x0, y0, x1, y1); a path or box of several rows is their sum. Points and
    boxes meet in the cells of a grid, those of equal paths and of equal boxes once; paths and boxes by name are then read
    off bundles of equal ones.
    """
    ends = ["x0", "y0", "x1", "y1"]
    shaped = lambda df, key, s: df.groupBy(page, key).agg(F.array_sort(F.collect_list(F.struct(*ends))).alias(s))
    a, b = shaped(paths, "path", "p"), shaped(boxes, "box", "b")
    one = lambda df, s: df.select(page, s).distinct().select(page, s, F.explode(s).alias("_s")).select(page, s, "_s.*")
    t = F.col("k") / steps
    points = one(a, "p").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).select(page, "p", (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"))
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    points = points.withColumn("gx", at("x")).withColumn("gy", at("y"))
    dealt = one(b, "b").withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy", F.explode(F.sequence(at("y0"), at("y1"))))
    hits = points.join(dealt.hint("merge"), [page, "gx", "gy"]).where("x > x0 AND x < x1 AND y > y0 AND y < y1")
    hits = hits.groupBy(page, "p", "b").agg(F.count(F.lit(1)).alias("n"))
    hits = hits.join(bundles(a, [page, "p"], "path").hint("merge"), [page, "p"]).withColumnRenamed("members", "_path")
    hits = spread(hits.join(bundles(b, [page, "b"], "box").hint("merge"), [page, "b"]))
    return hits.select(page, "n", "members", F.explode("_path").alias("path")).select(page, "path", F.explode("members").alias("box"), "n")


def on_canvas(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes that are not wholly off the canvas."""
    return boxes.where((F.col("x1") > 0) & (F.col("y1") > 0) & (F.col("x0") < width) & (F.col("y0") < height))


def callouts(targets: DataFrame, labels: DataFrame, key: str = "chart") -> DataFrame:
    """(key, target, pos): what callouts point at: a row's number, or the first row with that label in any case; null: none.

    Rows (key, target) and (key, pos, label).
    """
    name = lambda c: F.lower(F.trim(F.col(c)))
    number = F.regexp_extract("target", r"^\s*([0-9]+)\s*$", 1).try_cast("long")
    rows = labels.groupBy(key).agg(F.max("pos").alias("last"))
    first = labels.groupBy(key, name("label").alias("name")).agg(F.min("pos").alias("at"))
    asked = targets.select(key, "target", number.alias("number"), name("target").alias("name")).join(rows, key, "left").join(first, [key, "name"], "left")
    return asked.select(key, "target", F.when(F.col("number") <= F.col("last"), F.col("number")).otherwise(F.col("at")).alias("pos"))


def table_of(references: DataFrame, tables: DataFrame, key: str = "slide") -> DataFrame:
    """(key, ref, tbl): the table that a chart's reference means: the slide's own (`self`), or that of its left or right
    pane; `self` on a slide with tables in its panes alone is the first of them.

    Rows (key, ref) and (key, pane, tbl), pane null for the slide's own.
    """
    place = F.coalesce("pane", F.lit("self"))
    order = F.when(place == "self", 0).when(place == "left", 1).otherwise(2)
    any_of = tables.groupBy(key).agg(F.min_by("tbl", order).alias("any"))
    own = tables.groupBy(key, place.alias("ref")).agg(F.min("tbl").alias("own"))
    return references.join(own, [key, "ref"], "left").join(any_of, key, "left").select(key, "ref", F.coalesce("own", F.when(F.col("ref") == "self", F.col("any"))).alias("tbl"))


def backup_only(sentences: DataFrame, slides: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key): sentences with numbers of which none is in the main part of a talk and all are in its backup.

    Rows (group, key, values array) and (group, backup boolean, values array).
    """
    where = slides.select(group, "backup", F.explode("values").alias("v")).groupBy(group, "v").agg(F.bool_and("backup").alias("only"))
    each = sentences.where(F.size("values") > 0).select(group, key, F.explode(F.array_distinct("values")).alias("v")).join(where, [group, "v"], "left")
    return each.groupBy(group, key).agg(F.bool_and(F.coalesce("only", F.lit(False))).alias("all")).where("all").select(group, key)


def topic_hits(words: DataFrame, vocabulary: DataFrame, key: str, least: int = 7) -> DataFrame:
    """(key, word): words that the vocabulary has, or, from `least` letters on, that contain or are part of one of its
    long words. Rows (key, word) and (word).

    A part of a word shares its first `least` letters with one of the runs of the whole, so both ways are equi-joins.
    """
    mine, known = words.select(key, "word").distinct(), vocabulary.select("word").distinct()
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (least - 1)), lambda i: F.substring(F.col(c), i, F.lit(least)))
    long = lambda df, c: df.select(*[x for x in df.columns if x != "word"], F.col("word").alias(c)).where(F.length(c) >= least)
    asked, held = long(mine, "w"), long(known, "d")
    whole = held.select("d", F.substring("d", 1, least).alias("g")).join(asked.select(key, "w", F.explode(F.array_distinct(runs("w"))).alias("g")), "g").where(F.contains("w", F.col("d")))
    part = asked.select(key, "w", F.substring("w", 1, least).alias("g")).join(held.select("d", F.explode(F.array_distinct(runs("d"))).alias("g")), "g").where(F.contains("d", F.col("w")))
    hits = mine.join(known, "word", "left_semi").select(key, "word")
    return hits.unionAll(whole.select(key, F.col("w").alias("word"))).unionAll(part.select(key, F.col("w").alias("word"))).distinct()


def wide_tokens(texts: DataFrame, key: str = "box") -> DataFrame:
    """(key, n, widest): words of a text that are wider than its box. Rows (key, text, pt, inches)."""
    words = texts.select(key, "pt", "inches", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w")).withColumn("width", C.text_width(F.col("w"), F.col("pt")))
    return words.where(F.col("width") > F.col("inches")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by("w", F.struct("width", "w")).alias("widest"))


def table_heights(cells: DataFrame, table: str = "tbl", row: str = "r") -> DataFrame:
    """(table, height): rows are as high as their highest cell. Rows (table, row, lines, line_height)."""
    rows = cells.groupBy(table, row).agg(F.max(F.col("lines") * F.col("line_height")).alias("h"))
    return rows.groupBy(table).agg(F.sum("h").alias("height"))


def marked_share(cells: DataFrame, table: str = "tbl", row: str = "r", text: str = "cell") -> DataFrame:
    """(table, n_marked, n_cells, n_blank_rows): marked cells, and rows of which more than half is blank."""
    rows = cells.groupBy(table, row).agg(F.count_if(C.emphasised(F.col(text))).alias("marked"), F.count(F.lit(1)).alias("n"), F.count_if(T.is_blank(F.col(text))).alias("blank"))
    return rows.groupBy(table).agg(F.sum("marked").alias("n_marked"), F.sum("n").alias("n_cells"), F.count_if(F.col("blank") * 2 > F.col("n")).alias("n_blank_rows"))


def paper_colour(pixels: DataFrame, ink: Column, image: str = "image", colour: str = "colour") -> DataFrame:
    """(image, colour, n): the commonest colour that is not the ink's; of equals the least. Counted before ranked."""
    counts = pixels.where(~ink).groupBy(image, colour).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(image).agg(F.max(F.struct("n", (-F.col(colour)).alias("c"))).alias("b")).select(image, (-F.col("b.c")).alias(colour), F.col("b.n").alias("n"))


def photographs(pixels: DataFrame, image: str = "image", colour: str = "colour", top: int = 32, share: float = 0.45, least: int = 8000) -> DataFrame:
    """(image, n_colours, top_share, photo): many colours of which the commonest hold no large share."""
    counts = pixels.groupBy(image, colour).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(image).orderBy(F.desc("n"), colour))
    ranked = counts.withColumn("rank", rank)
    out = ranked.groupBy(image).agg(F.count(F.lit(1)).alias("n_colours"), (F.sum(F.when(F.col("rank") <= top, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_share"))
    return out.withColumn("photo", (F.col("top_share") <= share) & (F.col("n_colours") >= least))


def ink_runs(pixels: DataFrame, dark: Column, by: list[str], order: str) -> DataFrame:
    """(by, share, n_runs): the share of dark pixels in a line, and how many runs of them it has."""
    over = W.partitionBy(*by).orderBy(order)
    rows = pixels.withColumn("dark", dark).withColumn("starts", F.col("dark") & ~F.coalesce(F.lag("dark").over(over), F.lit(False)))
    return rows.groupBy(*by).agg((F.count_if("dark") / F.count(F.lit(1))).alias("share"), F.count_if("starts").alias("n_runs"))


def room(slides: DataFrame, body: float, parts: dict[str, float]) -> Column:
    """The height left for a figure: the body less each part's height times how often the slide has it; not below 0."""
    used = F.lit(0.0)
    for name, height in parts.items():
        used = used + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * height
    return F.greatest(F.lit(0.0), F.lit(body) - used)
