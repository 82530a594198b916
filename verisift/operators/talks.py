"""Checks on whole talks: grids that a claim names, the thesis and its coverage, figures before results, pasted figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cells as C, text as T


def share(of: Column, among: Column) -> Column:
    """The share of distinct words of one array that another has; 0 for none."""
    n = F.size(F.array_distinct(of))
    return F.when(n > 0, F.size(F.array_intersect(of, among)) / n).otherwise(0.0)


def focus(labels: DataFrame, claims: DataFrame, key: str = "slide", floor: float = 0.5) -> DataFrame:
    """(key, label): the box of a slide's diagram whose words the slide's claim names best, half of them at least.

    Rows (key, pos, label) and (key, claim); of equally good boxes the first.
    """
    both = labels.join(claims, key).withColumn("score", share(C.content_words(F.col("label")), C.content_words(F.col("claim"))))
    best = both.groupBy(key).agg(F.max(F.struct("score", (-F.col("pos")).alias("p"), "label")).alias("b"))
    return best.where(F.col("b.score") >= floor).select(key, F.col("b.label").alias("label"))


def named_cells(cells: DataFrame, rows: DataFrame, columns: DataFrame, key: str = "grid") -> DataFrame:
    """(key, pos, row, column): cells of a grid, numbered row by row, whose label repeats their row's or column's name.

    Rows (key, pos, label, n_cols), (key, r, row) and (key, c, column).
    """
    placed = cells.withColumn("r", F.floor(F.col("pos") / F.col("n_cols")).cast("int")).withColumn("c", (F.col("pos") % F.col("n_cols")).cast("int"))
    named = placed.join(rows, [key, "r"], "left").join(columns, [key, "c"], "left").withColumn("w", T.word_run(F.col("label")))
    hit = lambda name: F.coalesce(F.exists(T.word_run(F.col(name)), lambda x: (F.length(x) >= 3) & F.array_contains(F.col("w"), x)), F.lit(False))
    return named.where(hit("row") | hit("column")).select(key, "pos", "row", "column")


def thesis(slides: DataFrame, talk: str = "talk") -> DataFrame:
    """(talk, thesis): what the last standout slide says. Rows (talk, n, kind, text)."""
    return slides.where("kind = 'standout'").groupBy(talk).agg(F.max_by("text", "n").alias("thesis"))


def off_thesis(slides: DataFrame, talk: str = "talk") -> DataFrame:
    """(talk, n): standouts that share no content word with the talk's thesis."""
    both = slides.where("kind = 'standout'").join(thesis(slides, talk), talk)
    return both.where(~F.arrays_overlap(C.content_words(F.col("text")), C.content_words(F.col("thesis")))).select(talk, "n")


def thesis_coverage(slides: DataFrame, talk: str = "talk") -> DataFrame:
    """(talk, n, overlap): other slides by how many of the thesis's words they have, best first."""
    words = C.content_words(F.col("text"))
    both = slides.where("kind <> 'standout'").join(thesis(slides, talk), talk)
    n = F.size(F.array_intersect(words, C.content_words(F.col("thesis"))))
    return both.select(talk, "n", n.alias("overlap")).orderBy(talk, F.desc("overlap"), "n")


def concepts_before_results(slides: DataFrame, cells: DataFrame, talk: str = "talk") -> DataFrame:
    """(talk, first_result, n_figures): the first slide with a table of numbers, and the figures before it.

    A table counts if half of its filled cells, and four at least, are numbers. Rows (talk, n, has_figure), (talk, n, cell).
    """
    number = F.col("cell").rlike(r"^[-+−]?[0-9][0-9.,]*%?$")
    tables = cells.where(~T.is_blank(F.col("cell"))).groupBy(talk, "n").agg(F.count_if(number).alias("k"), F.count(F.lit(1)).alias("all")).where("k >= 4 AND k * 2 >= all")
    first = tables.groupBy(talk).agg(F.min("n").alias("first_result"))
    return slides.join(first, talk).groupBy(talk, "first_result").agg(F.count_if(F.col("has_figure") & (F.col("n") < F.col("first_result"))).alias("n_figures"))


def pasted_figures(figures: DataFrame, drawn: DataFrame, talk: str = "talk") -> DataFrame:
    """(talk, n, file): figures that the talk did not draw itself and that are no photographs.

    Rows (talk, n, file, photo) and (talk, file); names are compared without folder and ending.
    """
    name = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[A-Za-z]+$", "")
    own = drawn.select(talk, name.alias("name")).distinct()
    return figures.where(~F.coalesce("photo", F.lit(False))).withColumn("name", name).join(own, [talk, "name"], "left_anti").select(talk, "n", "file")


def affiliations(authors: DataFrame, institutions: DataFrame, paper: str = "paper") -> DataFrame:
    """(paper, institutions): each paper's institutions in the order in which its authors name them first.

    Rows (paper, pos, marks array) and (paper, mark, name).
    """
    rows = authors.select(paper, "pos", F.posexplode("marks").alias("k", "mark")).join(institutions, [paper, "mark"])
    first = rows.groupBy(paper, "name").agg(F.min(F.struct("pos", "k")).alias("at"))
    return first.groupBy(paper).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("institutions"))


def cited_sections(sections: DataFrame, figures: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, label, sections): which sections refer to a figure. Rows (doc, sec_no, body) and (doc, label)."""
    refs = sections.select(doc, "sec_no", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\\(?:ref|autoref|cref)\{([^}]*)\}"), F.lit(1)))).alias("label"))
    return figures.join(refs, [doc, "label"]).groupBy(doc, "label").agg(F.array_sort(F.collect_set("sec_no")).alias("sections"))


def repeated_labels_run(rows: DataFrame, by: str, order: str, label: str) -> DataFrame:
    """(by, label, start, n): runs of neighbours with one label: consecutive groups of a strip."""
    over = W.partitionBy(by).orderBy(order)
    marked = rows.withColumn("new", F.coalesce(F.lag(label).over(over) != F.col(label), F.lit(True)).cast("int")).withColumn("g", F.sum("new").over(over))
    return marked.groupBy(by, "g", label).agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n")).drop("g")
