"""Slide specs, sidecars and logs as tables: explicit schemas, violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .trees import json_texts

TABLE = T.StructType([T.StructField("align", T.StringType()), T.StructField("header", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("note", T.StringType())])
SLIDE = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("title", T.StringType()), T.StructField("bullets", T.ArrayType(T.StringType())), T.StructField("lead", T.StringType()),
        T.StructField("big", T.StringType()), T.StructField("table", TABLE), T.StructField("figure", T.StructType([T.StructField("path", T.StringType()), T.StructField("caption", T.StringType())])),
        T.StructField("left", T.StringType()), T.StructField("right", T.StringType()), T.StructField("note", T.StringType()), T.StructField("cue", T.StringType()),
        T.StructField("say", T.ArrayType(T.StringType())), T.StructField("pause", T.DoubleType()), T.StructField("backup", T.BooleanType()),
    ]
)
#: Keys that a kind draws; any other key that is filled is a violation.
DRAWN = {"title": ["title", "note"], "content": ["title", "bullets", "lead", "note"], "standout": ["title", "big", "note"], "figure": ["title", "figure", "lead", "note"], "table": ["title", "table", "lead", "note"], "columns": ["title", "left", "right", "note"]}
SPOKEN = ["say", "pause", "backup", "cue", "kind"]


def parse(specs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, n, slide) of JSON or YAML slide lists, or of the slides of a mapping; a text that has none gives one row with a
    null slide. Keys that SLIDE does not name are not read here: `trees.violations` finds them, at any depth."""
    specs = json_texts(specs, key, text).withColumn("whole", F.ltrim("json").startswith("{")).select(key, F.when(F.col("whole"), F.get_json_object("json", "$.slides")).otherwise(F.col("json")).alias(text))
    lists = F.when(F.ltrim(F.col(text)).startswith("["), F.from_json(text, T.ArrayType(SLIDE)))
    rows = specs.select(key, F.posexplode_outer(lists).alias("n", "slide"))
    return rows.select(key, "n", normal(F.col("slide")).alias("slide"))


def normal(s: Column) -> Column:
    """Lists are never null, a pause is a number, backup a boolean, and a kind is inferred where none is given."""
    empty = F.array().cast("array<string>")
    kind = F.coalesce(s["kind"], F.when(s["table"].isNotNull(), "table").when(s["figure"].isNotNull(), "figure").when(s["left"].isNotNull() | s["right"].isNotNull(), "columns").when(s["big"].isNotNull(), "standout").otherwise("content"))
    out = s.withField("kind", kind).withField("bullets", F.coalesce(s["bullets"], empty)).withField("say", F.coalesce(s["say"], empty))
    return F.when(s.isNotNull(), out.withField("pause", F.coalesce(s["pause"], F.lit(0.0))).withField("backup", F.coalesce(s["backup"], F.lit(False))))


def violations(slides: DataFrame, key: str = "path") -> DataFrame:
    """(key, n, section, detail): unknown kinds, keys the kind does not draw, ragged rows, swallowed escapes."""
    s = F.col("slide")
    filled = {c: F.size(s[c]) > 0 if c in ("bullets", "say") else s[c].isNotNull() for c in SLIDE.names if c not in SPOKEN}
    undrawn = F.filter(F.array(*[F.when(f & ~F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for k, v in DRAWN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), s["kind"]), c), F.lit(True)), F.lit(c)) for c, f in filled.items()]), lambda x: x.isNotNull())
    width = F.size(s["table"]["header"])
    ragged = F.filter(F.transform(F.coalesce(s["table"]["rows"], F.array().cast("array<array<string>>")), lambda r: F.when(F.size(r) != width, F.concat_ws("|", r))), lambda x: x.isNotNull())
    leaves = F.concat(F.array(*[F.coalesce(s[c], F.lit("")) for c in ("title", "lead", "big", "left", "right", "note")]), s["bullets"], s["say"])
    escapes = F.filter(leaves, lambda x: x.rlike(r"[\x00-\x08\x0b-\x1f]"))
    under = lambda name: lambda x: F.struct(F.lit(name).alias("section"), x.alias("detail"))
    found = F.concat(
        F.when(s.isNull(), F.array(F.struct(F.lit("syntax").alias("section"), F.lit("not a slide list").alias("detail")))).otherwise(F.array().cast("array<struct<section:string,detail:string>>")),
        *[
            F.coalesce(F.transform(a, under(n)), F.array().cast("array<struct<section:string,detail:string>>"))
            for n, a in (("unknown kind", F.when(~s["kind"].isin(*DRAWN), F.array(s["kind"]))), ("not drawn", undrawn), ("ragged", ragged), ("escape", escapes))
        ],
    )
    return slides.select(key, "n", F.explode(found).alias("v")).select(key, "n", "v.*")


def audit_rows(slides: DataFrame, key: str = "path") -> DataFrame:
    """A wide row a slide: text on screen, text said, element counts, page number (backup slides last, without one)."""
    s = F.col("slide")
    cells = F.flatten(F.concat(F.array(F.coalesce(s["table"]["header"], F.array().cast("array<string>"))), F.coalesce(s["table"]["rows"], F.array().cast("array<array<string>>"))))
    screen = F.filter(F.concat(F.array(s["title"], s["lead"], s["big"], s["left"], s["right"], s["figure"]["caption"]), s["bullets"], cells), lambda x: x.isNotNull() & (x != ""))
    rows = slides.where(s.isNotNull()).select(key, "n", s["kind"].alias("kind"), s["backup"].alias("backup"), F.array_join(screen, "\n").alias("screen"), F.array_join(s["say"], "\n").alias("say"), s["pause"].alias("pause"), F.size(s["bullets"]).alias("n_bullets"), F.size(cells).alias("n_cells"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("backup", "n")))
    numbered = ~F.col("backup") & ~F.col("kind").isin("title", "standout")
    return rows.withColumn("page", F.when(numbered, F.sum(numbered.cast("int")).over(W.partitionBy(key).orderBy("place"))))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(tag, row, col, value) of a tab-separated sidecar; comment lines are left out, field lines have an empty col."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.trim("value") != "")
    f = F.split("value", "\t")
    return lines.select(*[F.coalesce(F.get(f, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(("tag", "row", "col", "value"))])


def write_sidecar(existing: DataFrame, new: DataFrame, path: str) -> None:
    """Replace by tag, sorted, one file with a header comment. Written beside and read nowhere, so it repeats safely."""
    from ..operators.provenance import upsert_by_tag

    rows = upsert_by_tag(existing, new)
    lines = rows.select(F.concat_ws("\t", "tag", "row", "col", "value").alias("value")).distinct()
    header = existing.sparkSession.createDataFrame([("# tag\trow\tcol\tvalue",)], "value string")
    ordered = header.withColumn("k", F.lit(0)).unionAll(lines.withColumn("k", F.lit(1))).orderBy("k", "value").select("value")
    ordered.coalesce(1).write.mode("overwrite").text(path)


def read_figure_text(spark: SparkSession, path: str) -> DataFrame:
    """(png, w, h, fingerprint, pt, text) of a text-size file; lines whose numbers do not parse are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(f[0].alias("png"), *[F.get(f, F.lit(i)).try_cast("double").alias(c) for i, c in ((1, "w"), (2, "h"))], F.get(f, F.lit(3)).alias("fingerprint"), F.get(f, F.lit(4)).try_cast("double").alias("pt"), F.get(f, F.lit(5)).alias("text"))
    return rows.where(F.col("w").isNotNull() & F.col("h").isNotNull() & F.col("pt").isNotNull())


def overfull(log: DataFrame, key: str = "path", floor: float = 6.0) -> DataFrame:
    """(key, page, pt) of a build log's overflow events: each belongs to the page after the last one shipped before it.

    Rows (key, pos, kind, v): kind `page` with its number, kind `over` with points. Overflows up to `floor` are left out.
    """
    over = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    shipped = F.coalesce(F.max(F.when(F.col("kind") == "page", F.col("v"))).over(over), F.lit(0.0))
    rows = log.withColumn("page", (shipped + 1).cast("int")).where((F.col("kind") == "over") & (F.col("v") > floor))
    return rows.groupBy(key, "page").agg(F.max("v").alias("pt"))
