"""Aggregates with conditions: contradictions, recurrences, densities, medians, columns, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values. For a group's distinct values with counts see upper_median_of."""
    return F.element_at(F.sort_array(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def upper_median_of(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, upper_median) without collecting a group: counts of distinct values, then a running sum over those."""
    from pyspark.sql import Window as W

    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.partitionBy(by).orderBy(value))
    marked = counts.withColumn("upto", run).withColumn("total", F.sum("n").over(W.partitionBy(by)))
    return marked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(by).agg(F.min(value).alias("upper_median"))


def contradictions(rows: DataFrame, label: str, value: str, place: str) -> DataFrame:
    """Labels with more than one value in more than one place."""
    return rows.groupBy(label).agg(F.count_distinct(value).alias("n_values"), F.count_distinct(place).alias("n_places")).where("n_values > 1 AND n_places > 1")


def recurring(rows: DataFrame, label: str, place: str, least: int = 2) -> DataFrame:
    """Labels in `least` places or more, with the first of them."""
    return rows.groupBy(label).agg(F.count_distinct(place).alias("n_places"), F.min(place).alias("first_place")).where(F.col("n_places") >= least)


def mode(rows: DataFrame, by: list[str], value: str, at_least: Column | None = None) -> DataFrame:
    """The most frequent value of each group; of equals the smallest. Pre-aggregated, so a hot group stays small."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    best = best.select(*by, F.col("b.v").alias(value), (-F.col("b.k")).alias("n"), "total")
    return best.where(at_least) if at_least is not None else best


def numeric_columns(cells: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, align): right where more than half of the non-blank cells are numbers."""
    number = F.col(text).rlike(r"^[-+−]?[0-9][0-9.,]*%?$")
    return cells.where(F.trim(text) != "").groupBy(*by).agg(F.count_if(number).alias("n_numeric"), F.count(F.lit(1)).alias("n_cells")).withColumn("align", F.when(F.col("n_numeric") * 2 > F.col("n_cells"), "right").otherwise("left"))


def merged_heads(cells: DataFrame, by: list[str], head: str) -> DataFrame:
    """Columns whose cells repeat a few heads: 4 rows, 2 heads that occur twice or more, 60 % of the rows under them."""
    heads = cells.groupBy(*by, head).agg(F.count(F.lit(1)).alias("n"))
    sums = heads.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") >= 2).alias("n_heads"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("n_covered"))
    return sums.where("n_rows >= 4 AND n_heads >= 2 AND n_covered * 100 >= n_rows * 60")


def widths(cells: DataFrame, table: str, column: str, text: str) -> DataFrame:
    """A table's width in characters: the sum over columns of the longest cell."""
    return cells.groupBy(table, column).agg(F.max(F.length(text)).alias("w")).groupBy(table).agg(F.sum("w").alias("n_chars"))


def density(rows: DataFrame, by: str, flags: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """Counts of flagged rows and sums by group; ratios are left to the reader, so nothing depends on rounding."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.sum(c).alias(n) for n, c in totals.items()])


def supported(rows: DataFrame, by: str, value: str, place: str, percent: int = 30, least: int = 2) -> DataFrame:
    """Values on max(least, percent) of a group's places."""
    places = rows.groupBy(by).agg(F.count_distinct(place).alias("n_all"))
    each = rows.groupBy(by, value).agg(F.count_distinct(place).alias("n_places"))
    return each.join(places, by).where((F.col("n_places") >= least) & (F.col("n_places") * 100 >= F.col("n_all") * percent)).select(by, value, "n_places")


def roll_up(violations: list[tuple[str, DataFrame]]) -> DataFrame:
    """(section, n): violations by section and their total (section null)."""
    out = None
    for name, df in violations:
        rows = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n")
        out = rows if out is None else out.unionAll(rows)
    return out.rollup("section").agg(F.sum("n").alias("n"))
