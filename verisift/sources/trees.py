"""Slide specs of any shape as trees of nodes: a strict walk over JSON and YAML, with rows instead of objects.

`nodes` turns specs into one row a value, with its path, so that checks at any depth are filters, joins and aggregates:
keys that nothing reads, keys that a kind does not draw, tables and charts in panes and panels, marks, words in figures.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .._staging import written
from ..functions import cells as C

# ---- fixed values: the keys of each kind of object, what stands below them, and what is drawn ---------------------
KEYS = {
    "meta": "title subtitle author institute presenter venue date thesis paper lang wpm acronyms coined_ok aspect figdir engine pptx_font pptx_mono cjk_font base_pt colorblind".split(),
    "slide": "kind title lead formula bullets steps big gap lines flow figure chart diagram table block left right foot fine note say ko cue pause ask backup n".split(),
    "pane": "width parts size steps head text bullets figure chart diagram table block".split(),
    "figure": "path lead picture crop highlight share caption max_height width height shows grid".split(),
    "highlight": "x y w h label mark label_at".split(),
    "grid": "images cols rows mark caption max_height gap".split(),
    "table": "header rows align size note".split(),
    "big": "value label note mark text kind".split(),
    "chart": "from kind log xlabel title note takeaway verdict share_rows panels table col_notes row_label col_label ylabel callout values caption max_height".split(),
    "panel": "title from table".split(),
    "diagram": "kind nodes edges edge_names boxes rows cols title note takeaway legend axis separate gap caption max_height".split(),
    "pipeline row": "label sub stages out caption loop skip frame".split(),
    "frame": "label note mark".split(),
    "stage": "label inner glyph sub group count mark feed width".split(),
    "strip row": "label sub cells note bars groups group_label outer axis mark_at rnote left right gap legend span mark".split(),
}
#: (kind of object, key) -> kind of the objects below it, also in a list
BELOW = {
    ("spec", "meta"): "meta", ("spec", "slides"): "slide", ("slide", "left"): "pane", ("slide", "right"): "pane", ("pane", "parts"): "pane",
    ("slide", "figure"): "figure", ("pane", "figure"): "figure", ("figure", "highlight"): "highlight", ("figure", "grid"): "grid",
    ("slide", "table"): "table", ("pane", "table"): "table", ("chart", "table"): "table", ("panel", "table"): "table", ("slide", "big"): "big",
    ("slide", "chart"): "chart", ("pane", "chart"): "chart", ("chart", "panels"): "panel", ("slide", "diagram"): "diagram", ("pane", "diagram"): "diagram",
    ("pipeline", "rows"): "pipeline row", ("strip", "rows"): "strip row", ("pipeline row", "frame"): "frame", ("pipeline row", "stages"): "stage",
}
ALWAYS = "kind n note say ko cue pause backup ask".split()
DRAWN = {
    "title": "title".split(),
    "content": "title bullets foot fine block lead formula".split(),
    "standout": "big gap flow bullets table lead lines".split(),
    "figure": "title figure chart diagram bullets foot fine block lead formula".split(),
    "table": "title table bullets foot fine block lead formula".split(),
    "columns": "title left right foot fine block lead formula figure chart diagram".split(),
}
CHART_DRAWN = {
    "tiles": "from kind table caption max_height takeaway title note verdict share_rows panels col_notes row_label col_label".split(),
    "heat": "from kind table caption max_height takeaway title note".split(),
    "bars": "from kind table caption max_height takeaway title ylabel note callout values log".split(),
    "dots": "from kind table caption max_height takeaway xlabel ylabel log".split(),
    "lines": "from kind table caption max_height takeaway xlabel ylabel log callout".split(),
}
DIAGRAM_NEEDS = {"flow": "boxes", "stack": "boxes", "grid": "boxes", "strip": "rows", "pipeline": "rows", "graph": "nodes"}
FIGURE_TEXT = "title note takeaway caption label sub text xlabel ylabel row_label col_label out col_notes verdict legend edge_names axis".split()
# --------------------------------------------------------------------------------------------------

_SIDE = r"(?:left|right)(?:\.parts\[[0-9]+\])*"
_CELLS = r"(?:header(?:\[[0-9]+\])+|note|rows(?:\[[0-9]+\])+)"
#: where a slide's text stands on screen, by paths below the slide
SCREEN = "^(?:" + "|".join((
    r"(?:title|lead|bullets|steps|foot|fine|flow)(?:\[[0-9]+\])*", r"big(?:\[[0-9]+\])?(?:\.(?:value|text|label|note))?", r"block\.(?:title|text)",
    rf"{_SIDE}\.(?:head|text|bullets|steps)(?:\[[0-9]+\])*", rf"{_SIDE}\.block\.(?:title|text)",
    r"(?:(?:left|right)\.)?chart\.(?:title|note|row_label|col_label|col_notes(?:\[[0-9]+\])*|panels\[[0-9]+\]\.title)",
    rf"(?:{_SIDE}\.)?table\.{_CELLS}", rf"(?:(?:left|right)\.)?chart\.(?:panels\[[0-9]+\]\.)?table\.{_CELLS}",
)) + ")$"


def as_json(text: str | None) -> str | None:
    """A spec's text, JSON or YAML, as JSON; None where it is neither a list nor a mapping. YAML needs a reader of it."""
    if text is None:
        return None
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml

            found = yaml.safe_load(text)
        except ImportError:
            raise RuntimeError("YAML specs need the yaml package on all machines") from None
        except (yaml.YAMLError, ValueError):
            return None
    plain = lambda x: {str(k): plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x
    return json.dumps(plain(found), ensure_ascii=False, default=str) if isinstance(found, (dict, list)) else None


def _json(text: str) -> Column:
    """A spec's text as JSON; what begins like JSON and is well formed does not go through Python: a UDF in a CASE gets every
    row, so it is given null for those."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(as_json)

    t = F.col(text)
    fine = t.rlike(r"^\s*[\[{]") & F.expr(f"try_parse_json(`{text}`)").isNotNull()
    return F.when(fine, t).when(t.isNotNull(), read(F.when(~fine, t)))


def json_texts(specs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, json) of specs."""
    return specs.select(key, _json(text).alias("json"))


def nodes(specs: DataFrame, key: str = "path", text: str = "text", slides: DataFrame | None = None) -> DataFrame:
    """One row a value of each spec: (key, node, parent, name, label, depth, kind, value, of, shape, slide, rel, filled, cut).

    `node` is the path of the value and `parent` that of what holds it; `name` its key (null in a list), `label` the
    nearest key above; `kind` object, array, text, number, boolean or null; `value` a scalar as text; `of` what kind of object holds it
    and `shape` what kind of object the spec's grammar expects here; `slide` the slide's number from 0 and `rel` the path below the slide; `filled`
    is false for what counts as nothing (null, false, zero, an empty text, list or mapping); `cut` is true for what a pane holds beside its
    parts, which is not drawn. A text that is no spec has
    one row of kind null. Levels are walked one by one and written down with what is told of each value, as deep as the
    deepest spec, so checks read no value again; each value moves once, parts of few specs once more, so that all tasks share them.

    `slides`, (key, node, text), are slides that lie apart from their specs, by the place they have there: `[3]` in a spec that is a
    list, `slides[3]` in a mapping. The list itself is then in no text: a mapping is given without it, a list not at all. So no row
    and no task holds a spec whole, and specs of any length are walked. A slide that is none has a row of kind null at its place.
    """
    spark = specs.sparkSession
    below = F.create_map(*[F.lit(x) for (shape, name), child in BELOW.items() for x in (f"{shape}.{name}", child)])
    none, text_of = F.lit(None).cast("string"), F.expr("try_parse_json(json)").alias("v")
    level = json_texts(specs, key, text).select(F.col(key).alias("_key"), F.lit("").alias("node"), none.alias("parent"), none.alias("name"), none.alias("label"), none.alias("of"), F.lit(None).cast("int").alias("slide"), none.alias("rel"), F.lit(False).alias("cut"), F.lit(0).alias("depth"), text_of)
    level = level.withColumn("shape", F.when(F.expr("to_json(v)").startswith("["), "slide").otherwise("spec"))
    if slides is not None:
        within = F.when(F.startswith("node", F.lit("slides")), F.lit("slides"))
        apart = slides.select(F.col(key).alias("_key"), "node", _json(text).alias("json")).select(
            "_key", "node", F.coalesce(within, F.lit("")).alias("parent"), none.alias("name"), within.alias("label"), none.alias("of"), F.regexp_extract("node", r"\[([0-9]+)\]$", 1).try_cast("int").alias("slide"),
            F.lit("").alias("rel"), F.lit(False).alias("cut"), F.when(within.isNotNull(), 2).otherwise(1).alias("depth"), text_of, F.lit("slide").alias("shape"))
        level = level.unionByName(apart)
    levels = []
    while True:
        level, _ = written(_described(level), "nodes")
        few = level.limit(FEW + 1).count()
        if levels and not few:
            break
        levels.append(level.drop("v"))
        plain = F.when(F.col("e.key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("e.key")).otherwise(F.concat(F.lit('"'), F.replace("e.key", F.lit('"'), F.lit('\\"')), F.lit('"')))
        bare = F.when(F.col("e.key").isNull(), F.concat(F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))).otherwise(plain)
        under = lambda path: F.when(F.col("e.key").isNull() | (F.col(path) == ""), F.concat(path, "step")).otherwise(F.concat(F.col(path), F.lit("."), F.col("step")))
        # the rows of a diagram are of its kind
        owner = F.when(F.col("shape") == "diagram", F.coalesce(F.expr("try_variant_get(v, '$.kind', 'string')"), F.lit("flow"))).otherwise(F.col("shape"))
        # a pane with parts draws only these; what stands deeper goes with it, up to the next pane
        split = F.when(F.col("shape").eqNullSafe("pane") & F.col("rel").rlike(rf"^{_SIDE}$"), F.coalesce(_filled(F.expr("to_json(try_variant_get(v, '$.parts', 'variant'))")), F.lit(False))).otherwise(F.col("cut"))
        # worked out before the values are taken apart, so that no part carries the whole; what has no parts is not read
        rows = level.where("kind IN ('object', 'array')").withColumn("owner", owner).withColumn("split", split).withColumn("listed", (F.col("kind") == "array") & F.col("node").isin("", "slides"))
        rows = rows.select("_key", "node", "label", "shape", "slide", "rel", "depth", "owner", "split", "listed", "v").alias("n").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).alias("e")).withColumn("step", bare)
        level = rows.select(
            F.col("n._key").alias("_key"), under("n.node").alias("node"), F.col("n.node").alias("parent"), F.col("e.key").alias("name"), F.coalesce("e.key", "n.label").alias("label"),
            F.when(F.col("e.key").isNotNull(), F.col("n.shape")).alias("of"), F.when(F.col("n.listed"), F.col("e.pos")).otherwise(F.col("n.slide")).alias("slide"), F.when(F.col("n.listed"), "").otherwise(under("n.rel")).alias("rel"),
            F.col("n.split").alias("cut"), (F.col("n.depth") + 1).alias("depth"), F.col("e.value").alias("v"),
            F.when(F.col("e.key").isNull(), F.col("n.shape")).otherwise(F.try_element_at(below, F.concat_ws(".", F.col("n.owner"), F.col("e.key")))).alias("shape"))
        if few <= FEW:
            level = level.repartition(4 * spark.sparkContext.defaultParallelism, "_key", "node")
    if slides is not None:
        inside = F.when(F.col("node") == "slides", "slides")
        lists = levels[0].where("rel = ''").select("_key", F.col("parent").alias("node")).distinct().select(
            "_key", "node", F.when(inside.isNotNull(), "").alias("parent"), inside.alias("name"), inside.alias("label"), F.when(inside.isNotNull(), "spec").alias("of"), F.lit(None).cast("int").alias("slide"), none.alias("rel"), F.lit(False).alias("cut"),
            F.when(inside.isNotNull(), 1).otherwise(0).alias("depth"), F.lit("slide").alias("shape"), F.lit("array").alias("kind"), none.alias("value"), F.lit(True).alias("filled"))
        levels.append(written(lists, "lists")[0])
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    cut = F.col("cut") & ~F.coalesce(F.endswith("rel", F.lit(".parts")), F.lit(False))
    return out.select(F.col("_key").alias(key), "node", "parent", "name", "label", "depth", "kind", "value", "of", "shape", "slide", "rel", "filled", cut.alias("cut"))


FEW = 10_000  # rows of a level that may lie in a few tasks


def _filled(json: Column) -> Column:
    return ~json.isin("null", '""', "false", "[]", "{}") & ~F.coalesce(json.try_cast("double") == 0, F.lit(False))


def _described(level: DataFrame) -> DataFrame:
    """A level with what is told of its values. A list that has parts is known by its first and not written out."""
    rows = level.withColumn("json", F.when(F.expr("try_variant_get(v, '$[0]', 'variant')").isNotNull(), "[.").otherwise(F.expr("to_json(v)")))
    json = F.col("json")
    infinite = json.isin('"Infinity"', '"-Infinity"') & (F.expr("schema_of_variant(v)") == "DOUBLE")
    kind = F.when(json.startswith("{"), "object").when(json.startswith("["), "array").when(json.isin("true", "false"), "boolean").when(json.startswith('"') & ~infinite, "text").when(json != "null", "number")
    rows = rows.withColumn("kind", kind).withColumn("filled", F.coalesce(_filled(json), F.lit(False)))
    return rows.withColumn("value", F.when(~F.coalesce(F.col("kind"), F.lit("")).isin("object", "array"), F.expr("try_variant_get(v, '$', 'string')"))).drop("json")


def _known(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def unknown_keys(tree: DataFrame, key: str = "path", keys: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, node, shape, name, nearest, distance): keys that objects of their kind do not have, and the known key that is
    nearest by edits (the first by name of several). Objects of kinds without a list of keys are not checked."""
    known = _known(keys or KEYS)
    rows = tree.withColumn("known", F.try_element_at(known, F.col("of"))).where(F.col("known").isNotNull() & ~F.array_contains("known", F.col("name")))
    near = F.array_min(F.transform("known", lambda k: F.struct(F.levenshtein(k, F.col("name")).alias("d"), k.alias("k"))))
    return rows.select(key, "node", F.col("of").alias("shape"), "name", near["k"].alias("nearest"), near["d"].alias("distance"))


def undrawn_keys(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, node, kind, name): keys that their slide's or chart's kind does not draw, so they would vanish.

    A slide without a kind has one by what it holds; a table that a chart beside it reads is data and counts as drawn; a
    chart with panels is of tiles. Keys that nothing knows are left to `unknown_keys`."""
    slides = slide_kinds(tree, key)
    rows = tree.where("rel RLIKE '^[A-Za-z_]+$'").select(key, "slide", "node", "name").join(slides, [key, "slide"])
    drawn = F.array_union(F.try_element_at(_known(DRAWN), F.col("kind")), F.array(*map(F.lit, ALWAYS)))
    on_slide = rows.where(F.col("name").isin(KEYS["slide"]) & ~F.array_contains(drawn, F.col("name")) & ~((F.col("name") == "table") & F.col("has_chart")) & (F.col("name") != "steps"))
    charts = tree.where("shape = 'chart' AND kind = 'object'").select(key, F.col("node").alias("parent"))
    parts = tree.where("name IS NOT NULL").select(key, "parent", "node", "name", "value", "filled").join(charts, [key, "parent"])
    kinds = parts.groupBy(key, "parent").agg(
        F.when(F.bool_or((F.col("name") == "panels") & F.col("filled")), "tiles").otherwise(F.coalesce(F.max(F.when(F.col("name") == "kind", F.col("value"))), F.lit("heat"))).alias("kind"))
    dead = parts.join(kinds, [key, "parent"]).where(F.col("name").isin(KEYS["chart"]) & ~F.array_contains(F.try_element_at(_known(CHART_DRAWN), F.col("kind")), F.col("name")))
    return on_slide.select(key, "node", "kind", "name").unionByName(dead.select(key, "node", F.concat(F.lit("chart "), F.col("kind")).alias("kind"), "name"))


def missing_parts(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, node, kind, needs): diagrams of an unknown kind (needs is null) or without what their kind is drawn from."""
    diagrams = tree.where("shape = 'diagram' AND kind = 'object'").select(key, "node")
    parts = tree.where("name IS NOT NULL").select(key, F.col("parent").alias("node"), "name", "value", "filled")
    kinds = diagrams.join(parts, [key, "node"], "left").groupBy(key, "node").agg(
        F.coalesce(F.max(F.when(F.col("name") == "kind", F.col("value"))), F.lit("flow")).alias("kind"), F.collect_set(F.when(F.col("filled"), F.col("name"))).alias("has"))
    needs = F.try_element_at(F.create_map(*[F.lit(x) for kv in DIAGRAM_NEEDS.items() for x in kv]), F.col("kind"))
    return kinds.withColumn("needs", needs).where(F.col("needs").isNull() | ~F.array_contains("has", F.col("needs"))).select(key, "node", "kind", "needs")


def violations(specs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, node, section, detail): all that the strict walk refuses: texts that are no spec, unknown keys with the key
    that was probably meant, keys that are not drawn, diagrams without their parts, bad acronyms."""
    tree = nodes(specs, key, text)
    row = lambda df, node, section, detail: df.select(key, F.lit(node).alias("node") if node is not None else F.col("node"), F.lit(section).alias("section"), detail.alias("detail"))
    found = row(tree.where("node = '' AND kind IS NULL"), "", "no spec", F.lit("neither JSON nor YAML of slides"))
    found = found.unionByName(row(unknown_keys(tree, key), None, "unknown key", F.concat(F.lit("nearest: "), F.col("nearest"))))
    found = found.unionByName(row(undrawn_keys(tree, key), None, "not drawn", F.concat(F.col("kind"), F.lit(" does not draw "), F.col("name"))))
    found = found.unionByName(row(missing_parts(tree, key), None, "diagram", F.concat(F.col("kind"), F.coalesce(F.concat(F.lit(" needs "), F.col("needs")), F.lit(" is no kind")))))
    return found.unionByName(row(bad_acronyms(tree, key), "meta.acronyms", "acronym", F.coalesce("name", F.lit("no mapping"))))


def _kind() -> list[Column]:
    """Of a slide's rows: kind, the one that is given, else the one that what a slide holds stands for; has_chart."""
    has = lambda *names: F.coalesce(F.bool_or(F.col("rel").isin(*names) & F.col("filled")), F.lit(False))
    inferred = F.when(has("big", "flow"), "standout").when(has("left", "right"), "columns").when(has("figure", "chart", "diagram"), "figure").when(has("table"), "table").otherwise("content")
    return [F.coalesce(F.max(F.when((F.col("rel") == "kind") & F.col("filled"), F.col("value"))), inferred).alias("kind"), has("chart").alias("has_chart")]


def slide_kinds(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, slide, kind, has_chart): the kind that is given, else the one that what a slide holds stands for."""
    return tree.where("slide IS NOT NULL").groupBy(key, "slide").agg(*_kind())


def screen_texts(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, slide, node, text): every text that a slide shows, in panes and their parts, tables, charts and their panels."""
    rows = tree.where(~F.col("cut")).where(F.col("rel").rlike(SCREEN) & (F.col("value") != ""))
    return rows.select(key, "slide", "node", F.col("value").alias("text"))


def figure_words(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, slide, node, text): texts drawn inside charts and diagrams, by the key they stand under."""
    inside = F.col("rel").rlike(rf"^(?:{_SIDE}\.)?(?:chart|diagram)[.\[]")
    rows = tree.where(~F.col("cut")).where(inside & (F.col("kind") == "text") & F.col("label").isin(*FIGURE_TEXT) & (F.col("value") != ""))
    return rows.select(key, "slide", "node", F.col("value").alias("text"))


def boxes(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, slide, diagram, label): names of a diagram's boxes, cells and stages, blank ones left out."""
    return tree.where(_is_box()).select(key, "slide", F.regexp_extract("rel", _BOX, 1).alias("diagram"), F.col("value").alias("label"))


_BOX = r"^(.*?diagram)(?:\.rows\[[0-9]+\])?\.(?:boxes|cells|stages)\[[0-9]+\](\.label)?$"


def _is_box() -> Column:
    return F.contains("rel", F.lit("diagram")) & F.col("rel").rlike(_BOX) & ((F.regexp_extract("rel", _BOX, 2) != "") | ~F.col("kind").isin("object", "array")) & (F.trim("value") != "")


def slide_facts(tree: DataFrame, key: str = "path") -> DataFrame:
    """A row a slide: its kind, tables that are shown (a chart of its own table eats it), charts, diagrams, boxes, chunks
    of panes, whether it has marks, and whether a chart draws a table that stands beside it."""
    return tree.where(F.col("slide").isNotNull() & F.col(key).isNotNull()).groupBy(key, "slide").agg(*_kind(), *_facts(), F.count_if(_is_box()).alias("n_boxes")).select(
        key, "slide", "n_charts", "n_diagrams", "n_chunks", "has_marks", *_shown(), "kind", "n_boxes")


_SIDES = {"self": "", "left": "left.", "right": "right."}


def _has_marks() -> Column:
    rel = F.col("rel")
    # a mark below a diagram, a chart or a list of big values; cells carry roles and legends explain them
    pointed = rel.rlike(rf"^(?:big\[|(?:{_SIDE}\.)?(?:diagram|chart)\.)") & ~rel.rlike(r"(?:^|\.)(?:cells|legend)(?:\[|\.|$)")
    marks = ((F.col("name").isin("mark", "callout") & F.col("filled")) | ((F.col("name") == "mark_at") & F.col("kind").isNotNull())) & pointed
    return F.coalesce(F.bool_or(marks), F.lit(False)).alias("has_marks")


def _facts() -> list[Column]:
    rel = F.col("rel")
    flag = lambda path: F.coalesce(F.bool_or((rel == path) & F.col("filled")), F.lit(False))
    value = lambda path: F.max(F.when(rel == path, F.col("value")))
    leaf = (F.col("kind") == "object") & F.col("filled") & rel.rlike(rf"^{_SIDE}$")
    return [
        *[x for s, p in _SIDES.items() for x in (flag(f"{p}table").alias(f"t_{s}"), flag(f"{p}chart").alias(f"c_{s}"), F.coalesce(value(f"{p}chart.from"), F.lit("self")).alias(f"f_{s}"), flag(f"{p}chart.table").alias(f"own_{s}"))],
        F.count_if((F.col("name") == "chart") & F.col("filled") & rel.rlike(rf"^(?:{_SIDE}\.)?chart$")).alias("n_charts"), F.count_if((F.col("name") == "diagram") & F.col("filled") & rel.rlike(rf"^(?:{_SIDE}\.)?diagram$")).alias("n_diagrams"),
        (F.count_if(leaf) - F.count_if((F.col("name") == "parts") & F.col("filled") & rel.rlike(rf"^{_SIDE}\.parts$"))).alias("n_chunks"), _has_marks()]


def _shown() -> list[Column]:
    shown = lambda s: F.col(f"t_{s}") & ~(F.col(f"c_{s}") & (F.col(f"f_{s}") == "self") & ~F.col(f"own_{s}"))
    have = F.filter(F.array(*[F.when(shown(s), F.lit(s)) for s in _SIDES]), lambda x: x.isNotNull())
    return [F.size(have).cast("long").alias("n_tables"), F.greatest(*[F.col(f"c_{s}") & F.array_contains(have, F.col(f"f_{s}")) for s in _SIDES]).alias("same_twice")]


def bad_acronyms(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, value) of `meta.acronyms` that are no positive numbers; one row without a name where it is no mapping."""
    whole = tree.where("node = 'meta.acronyms' AND kind <> 'object'").select(key, F.lit(None).cast("string").alias("name"), "value")
    return whole.unionByName(tree.where("parent = 'meta.acronyms' AND name IS NOT NULL AND NOT coalesce(try_cast(value AS double) > 0, false)").select(key, "name", "value"))


def acronyms(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, table): a spec's words of each acronym read aloud, for `spoken_words`."""
    rows = tree.where("parent = 'meta.acronyms' AND try_cast(value AS double) > 0")
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("value").cast("double")))).alias("table"))


def key_reference() -> list[tuple[str, str, str]]:
    """(kind of object, key, kind of the objects below): what a spec may hold, from the one table that checks it."""
    return [(shape, name, BELOW.get((shape, name), "")) for shape, names in KEYS.items() for name in names]


#: texts that may carry emphasis, by paths below the slide
EMPHASIS = "^(?:" + "|".join((
    r"(?:title|lead|formula|bullets|steps|foot|fine|flow)(?:\[[0-9]+\])*", r"lines\[[0-9]+\](?:\.text)?", r"big(?:\[[0-9]+\])?(?:\.(?:value|text|label|note))?", r"block\.(?:title|text)",
    rf"{_SIDE}\.(?:head|text|bullets|steps)(?:\[[0-9]+\])*", rf"(?:{_SIDE}\.)?(?:chart\.(?:panels\[[0-9]+\]\.)?)?table\.(?:header|rows)(?:\[[0-9]+\])+", r"table\.note",
    rf"(?:{_SIDE}\.)?figure\.grid\.(?:cols|caption)(?:\[[0-9]+\])+",
)) + ")$"


def slide_density(tree: DataFrame, key: str = "path") -> DataFrame:
    """A row a slide of what density is counted from: backup, figure, table, columns, standout, emphasis and whether it
    counts, bullets only, a question, directions for the speaker, bullets and their words, rows and columns of its table."""
    rel = F.col("rel")
    drawn = ~F.col("cut")
    flag = lambda cond: F.coalesce(F.bool_or(drawn & F.col("filled") & cond), F.lit(False))
    value = lambda path: F.max(F.when(drawn & (rel == path) & F.col("filled") & ~F.col("kind").isin("object", "array"), F.col("value")))
    bullet = drawn & F.col("label").isin("bullets", "steps") & rel.rlike(rf"^(?:{_SIDE}\.)?(?:bullets|steps)\[[0-9]+\]$") & F.col("value").isNotNull()
    words = F.size(F.filter(F.split(C.strip_markup(F.when(bullet, F.col("value"))), r"\s+"), lambda w: w != ""))
    number = lambda pattern: F.max(F.when(drawn & F.col("label").isin("rows", "header"), F.regexp_extract("rel", pattern, 1).try_cast("long") + 1))
    rows = tree.where(F.col("slide").isNotNull() & F.col(key).isNotNull()).groupBy(key, "slide").agg(
        *_kind(), _has_marks(),
        flag(rel == "backup").alias("backup"), flag(F.col("name").isin("figure", "chart", "diagram", "formula") & rel.rlike(rf"^(?:{_SIDE}\.)?(?:figure|chart|diagram)$|^formula$")).alias("figure"), flag((F.col("name") == "table") & rel.rlike(rf"^{_SIDE}\.table$")).alias("pane_table"),
        flag(rel == "table").alias("t"), flag(rel == "chart").alias("c"), F.coalesce(value("chart.from"), F.lit("self")).alias("f"), flag(rel == "chart.table").alias("own"),
        F.coalesce(F.bool_or(drawn & F.col("value").rlike("[*<]") & C.emphasised(F.col("value")) & rel.rlike(EMPHASIS)), F.lit(False)).alias("emphasised"), F.count_if(bullet).alias("n_bullets"), F.coalesce(F.sum(F.when(bullet, words)), F.lit(0)).cast("long").alias("n_words"),
        value("title").alias("title"), value("lead").alias("lead"), value("big").alias("big"), flag(rel.isin("cue", "note") & (F.trim("value") != "")).alias("directed"),
        F.coalesce(number(r"^table\.rows\[([0-9]+)\]"), F.lit(0).cast("long")).alias("n_rows"), F.coalesce(number(r"^table\.(?:rows\[[0-9]+\]|header)\[([0-9]+)\]"), F.lit(0).cast("long")).alias("n_columns"))
    table = (F.col("t") & ~(F.col("c") & (F.col("f") == "self") & ~F.col("own"))) | F.col("pane_table")
    standout, lead = F.col("kind") == "standout", F.coalesce("lead", F.lit(""))
    asked = F.coalesce("title", F.when(standout, F.col("lead")), F.col("big"), F.lit(""))
    return rows.select(
        key, "slide", "kind", "backup", "figure", table.alias("table"), (F.col("kind") == "columns").alias("columns"), standout.alias("standout"), (F.col("emphasised") | F.col("has_marks")).alias("emphasis"),
        (~((F.col("kind") == "title") | (standout & F.contains(lead, F.lit("?"))))).alias("counts"), ((F.col("n_bullets") > 0) & ~F.col("figure") & ~table & ~F.col("kind").isin("standout", "title")).alias("bullets_only"),
        F.rtrim(C.strip_markup(asked)).endswith("?").alias("question"), "directed", "n_bullets", "n_words", "n_rows", "n_columns")


def density(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, n_slides, seven shares, bullets_a_slide, words_a_bullet) of each spec's slides, without backup ones."""
    main = slide_density(tree, key).where("NOT backup")
    share = lambda c: (F.count_if(c) / F.count("*")).alias(c)
    emphasis = F.count_if(F.col("counts") & F.col("emphasis")) / F.greatest(F.count_if("counts"), F.lit(1))
    return main.groupBy(key).agg(
        F.count("*").alias("n_slides"), *map(share, ("figure", "table", "columns", "standout", "bullets_only", "question")), emphasis.alias("emphasis"),
        (F.sum("n_bullets") / F.count("*")).alias("bullets_a_slide"), (F.sum("n_words") / F.greatest(F.sum("n_bullets"), F.lit(1))).alias("words_a_bullet"))


def slide_notes(tree: DataFrame, key: str = "path", max_rows: int = 12) -> DataFrame:
    """(key, slide, note): slides of bullets alone, main slides without directions for the speaker, tables of more rows than
    fit, and large tables of the main part (nine rows and five columns or more)."""
    rows = slide_density(tree, key)
    notes = {
        "bullets only": F.col("bullets_only"), "undirected": ~F.col("backup") & ~F.col("kind").isin("title", "section") & ~F.col("directed"),
        "too many rows": F.col("n_rows") > max_rows, "large table": ~F.col("backup") & (F.col("n_rows") >= 9) & (F.col("n_columns") >= 5)}
    return rows.select(key, "slide", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in notes.items()]), lambda x: x.isNotNull())).alias("note"))


#: what else a slide is made of, by paths below it: name -> pattern
PARTS = {
    "chart field": rf"^(?:{_SIDE}\.)?chart\.(?!table\.|panels\[[0-9]+\]\.table\.).+$", "figure": rf"^(?:{_SIDE}\.)?figure\.(?:path|grid\.images(?:\[[0-9]+\])+)$", "grid text": rf"^(?:{_SIDE}\.)?figure\.grid\.(?:cols|rows|caption)(?:\[[0-9]+\])+$",
    "big": r"^big(?:\[[0-9]+\])?(?:\.(?:value|text|label|note))?$", "highlight": rf"^(?:{_SIDE}\.)?figure\.highlight(?:\[[0-9]+\])?\.label$",
}


def parts(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, slide, what, node, field, value): fields of charts without their tables, files of figures and grids, texts of
    grids, pieces of big values, labels of highlights; at the slide itself, in panes and their parts."""
    rel = F.col("rel")
    what = F.coalesce(*[F.when(rel.rlike(p), F.lit(n)) for n, p in PARTS.items()])
    rows = tree.where("slide IS NOT NULL AND value IS NOT NULL AND NOT cut").withColumn("what", what).where("what IS NOT NULL AND value <> ''")
    return rows.select(key, "slide", "what", "node", F.col("label").alias("field"), "value")


def page_lists(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, list, slides): slides of the backup part, those with a highlight, those with a chart or diagram, in order."""
    rows = tree.where("slide IS NOT NULL AND NOT cut").where("filled")
    at = F.coalesce(F.when(F.col("rel") == "backup", F.lit("backup")), F.when(F.col("name") == "highlight", F.lit("highlight")), F.when(F.col("rel").rlike(rf"^(?:{_SIDE}\.)?(?:chart|diagram)$"), F.lit("drawn")))
    return rows.withColumn("list", at).where("list IS NOT NULL").groupBy(key, "list").agg(F.array_sort(F.collect_set("slide")).alias("slides"))


def flat_diagrams(tree: DataFrame, key: str = "path") -> DataFrame:
    """(key, n_diagrams, n_flat): diagrams, and those in which nothing is marked."""
    at = rf"^((?:{_SIDE}\.)?diagram)(?:\.|$)"
    rows = tree.where("slide IS NOT NULL AND NOT cut").where(F.col("rel").rlike(at)).withColumn("diagram", F.regexp_extract("rel", at, 1))
    marked = ((F.col("name") == "mark") & F.col("filled")) | ((F.col("name") == "mark_at") & F.col("kind").isNotNull())
    each = rows.groupBy(key, "slide", "diagram").agg(F.coalesce(F.bool_or(marked), F.lit(False)).alias("marked"))
    return each.groupBy(key).agg(F.count("*").alias("n_diagrams"), F.count_if(~F.col("marked")).alias("n_flat"))
