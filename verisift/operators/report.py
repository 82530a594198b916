"""Reports over violations, pages and figures: top rows, structure, baselines, feedback, widths, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_rows(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each kind and how many more there are; only those rows leave a task."""
    over = W.partitionBy(by).orderBy(*order)
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_all"))
    top = rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)  # pushed below the window as a group limit
    return top.join(counted, by).withColumn("n_more", F.greatest(F.col("n_all") - n, F.lit(0))).drop("n_all")


def page_structure(runs: DataFrame, deck: str = "deck", text: str = "text") -> DataFrame:
    """(deck, denominator, n_runs, numbers, missing): lone n/m texts; m is the commonest, numbers missing from 1..m."""
    n, m = F.regexp_extract(text, r"^\s*([0-9]{1,3})\s*/\s*([0-9]{1,3})\s*$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*([0-9]{1,3})\s*/\s*([0-9]{1,3})\s*$", 2).try_cast("int")
    found = runs.select(deck, n.alias("n"), m.alias("m")).where("n <= m")
    each = found.groupBy(deck, "m").agg(F.count(F.lit(1)).alias("n_runs"), F.array_sort(F.collect_set("n")).alias("numbers"))
    best = each.groupBy(deck).agg(F.max(F.struct("n_runs", (-F.col("m")).alias("k"), "m", "numbers")).alias("b"))
    return best.select(deck, F.col("b.m").alias("denominator"), F.col("b.n_runs").alias("n_runs"), F.size("b.numbers").alias("n_numbers"), F.array_except(F.sequence(F.lit(1), F.col("b.m")), F.col("b.numbers")).alias("missing"))


def accepted_denominator(structure: DataFrame, slides: DataFrame, deck: str = "deck") -> DataFrame:
    """Denominators that stand on half of all but two slides."""
    n = slides.groupBy(deck).agg(F.count(F.lit(1)).alias("n_slides"))
    return structure.join(n, deck).where(F.col("n_runs") * 2 >= F.greatest(F.lit(1), F.col("n_slides") - 2))


def ban_kinds(lines: DataFrame, line: str = "line") -> DataFrame:
    """(kind, n): plain words, marked patterns, and patterns that nobody marked as such."""
    text = F.trim(F.regexp_replace(line, r"\s+#.*$", ""))
    kind = F.when(text.startswith("re:"), "marked").when(text.rlike(r"[\\\[\](){}^$*+?|]"), "bare").otherwise("word")
    return lines.where((text != "") & ~text.startswith("#")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def baseline_diff(profile: DataFrame, baseline: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """(name, value, expected, flagged): one-sided, by the baseline's direction (`low` or `high` is bad)."""
    both = profile.join(baseline, "name")
    worse = F.when(F.col("bad") == "low", F.col("expected") - F.col("value")).otherwise(F.col("value") - F.col("expected"))
    return both.select("name", "value", "expected", (worse > tolerance).alias("flagged"))


def feedback(state: DataFrame, now: DataFrame, key: str = "slide", step: float = 1.0) -> DataFrame:
    """(key, reserve, last, bound): reserves after a pass. An overflow adds to its slide's reserve; a slide whose
    overflow fell by less than half of what was added is bound by its text and gets no more."""
    old, new = state.alias("o"), now.alias("n")
    rows = new.join(old, key, "full")
    gained = F.col("o.last") - F.col("n.over")
    bound = F.coalesce("o.bound", F.lit(False)) | (F.col("o.last").isNotNull() & F.col("n.over").isNotNull() & (gained < F.col("o.reserve") * 0.5))
    rows = rows.withColumn("b", bound)
    return rows.select(key, (F.coalesce("o.reserve", F.lit(0.0)) + F.when(F.col("n.over").isNotNull() & ~F.col("b"), F.col("n.over") * step).otherwise(0.0)).alias("reserve"), F.coalesce("n.over", "o.last").alias("last"), F.col("b").alias("bound"))


def column_widths(cells: DataFrame, total: float, table: str = "tbl", column: str = "c", text: str = "cell") -> DataFrame:
    """(table, column, width): each column's longest cell, but its longest word at least, scaled to the total."""
    word = F.array_max(F.transform(F.split(text, " "), lambda w: F.length(w)))
    need = cells.groupBy(table, column).agg(F.max(F.length(text)).alias("cell"), F.max(word).alias("word"))
    share = F.greatest(F.col("cell"), F.col("word"), F.lit(1)).cast("double")
    return need.select(table, column, (share * total / F.sum(share).over(W.partitionBy(table))).alias("width"))


def warnings_rolled_up(warnings: DataFrame, printed: DataFrame | None = None) -> DataFrame:
    """(figure, floor, n, least_pt, sample): small-text warnings by figure and floor, three smallest texts, printed ones left out.

    Rows (figure, floor, pt, text).
    """
    rows = warnings.dropDuplicates()
    if printed is not None:
        rows = rows.join(printed, ["figure", "floor", "text"], "left_anti")
    over = W.partitionBy("figure", "floor").orderBy("pt", "text")
    top = rows.withColumn("k", F.row_number().over(over))
    return top.groupBy("figure", "floor").agg(F.count(F.lit(1)).alias("n"), F.min("pt").alias("least_pt"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("pt", "text")))), lambda x: x["text"]).alias("sample"))


def common_size(texts: DataFrame, group: str, fits: str = "pt", floor: float = 7.0) -> DataFrame:
    """The largest size on a half-point grid at which every sibling fits, not below the floor."""
    return texts.groupBy(group).agg(F.greatest(F.floor(F.min(fits) * 2) / 2, F.lit(floor)).alias("pt"))


def binding_side(texts: DataFrame, figure: str = "figure", bound: str = "bound") -> DataFrame:
    """w or h: which side binds most of a figure's small texts; w where they tie."""
    return texts.groupBy(figure).agg(F.when(F.count_if(F.col(bound) == "w") >= F.count_if(F.col(bound) == "h"), "w").otherwise("h").alias("side"))


def colour_key_missing(uses: DataFrame, keys: DataFrame, deck: str = "deck") -> DataFrame:
    """(deck, colour, first): marks whose first use has no key on that slide, before it or on the next.

    Rows (deck, n, colour) of uses and of keys.
    """
    first = uses.groupBy(deck, "colour").agg(F.min("n").alias("first"))
    told = keys.groupBy(deck, "colour").agg(F.min("n").alias("told"))
    return first.join(told, [deck, "colour"], "left").where("told IS NULL OR told > first + 1").select(deck, "colour", "first")


def never_drawn(labels: DataFrame, figures: DataFrame, deck: str = "deck", least: int = 3) -> DataFrame:
    """(deck, n_labels, first): decks with three labels or more on two slides each, and no figure up to the first."""
    each = labels.groupBy(deck, "label").agg(F.count_distinct("n").alias("k"), F.min("n").alias("at")).where("k >= 2")
    decks = each.groupBy(deck).agg(F.count(F.lit(1)).alias("n_labels"), F.min("at").alias("first")).where(F.col("n_labels") >= least)
    drawn = figures.groupBy(deck).agg(F.min("n").alias("drawn"))
    return decks.join(drawn, deck, "left").where("drawn IS NULL OR drawn > first").select(deck, "n_labels", "first")
