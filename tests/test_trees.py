"""Specs as trees: typos at any depth, what kinds draw, marks, panes and their parts, JSON and YAML."""

import json

import pytest

from pyspark.sql import functions as F

from verisift.operators.sequence import numbered
from verisift.plans import spec_queries
from verisift.sources import specs, trees


def tree(spark, *found):
    return trees.nodes(spark.createDataFrame([(f"s{i}", x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(found)], "path string, text string"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def walked(x, node="", depth=0):
    """A plain walk: (node, depth, kind, value)."""
    kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "boolean" if isinstance(x, bool) else "text" if isinstance(x, str) else None if x is None else "number"
    yield node, depth, kind, None if isinstance(x, (dict, list)) or x is None else str(x).lower() if isinstance(x, bool) else str(x)
    for k, v in x.items() if isinstance(x, dict) else []:
        name = k if k.isidentifier() else '"' + k.replace('"', '\\"') + '"'
        yield from walked(v, f"{node}.{name}" if node else name, depth + 1)
    for i, v in enumerate(x) if isinstance(x, list) else []:
        yield from walked(v, f"{node}[{i}]", depth + 1)


DEEP = {"meta": {"title": "T", "a.b": [1, [2.5, [True, None]], {"x": ""}], 'q"': "v"}, "slides": [{"left": {"parts": [{"parts": [{"text": "deep"}]}]}}], "e": {}, "l": []}


def test_nodes_against_a_plain_walk(spark):
    t = tree(spark, DEEP, "[]", "just words", "[1, 2")
    assert rows(t.where("path = 's0'"), "node", "depth", "kind", "value") == sorted(walked(DEEP), key=str)
    assert [r.filled for r in t.where("path = 's1'").collect()] == [False] and rows(t.where("path IN ('s2', 's3')"), "node", "kind") == [("", None)] * 2


def test_unknown_keys_at_any_depth(spark):
    spec = {"meta": {"titel": 1}, "slides": [
        {"title": "t", "bulets": ["x"]}, {"chart": {"panels": [{"table": {"headr": []}}]}}, {"left": {"parts": [{"parts": [{"txet": 1}]}]}, "right": {"diagram": {"kind": "pipeline", "rows": [{"stages": [{"lable": 1}]}]}}},
        {"diagram": {"rows": [{"anything": 1}]}}, {"block": {"whatever": 1}}]}
    got = rows(trees.unknown_keys(tree(spark, spec, "[]")), "node", "shape", "name", "nearest")
    assert got == sorted([
        ("meta.titel", "meta", "titel", "title"), ("slides[0].bulets", "slide", "bulets", "bullets"), ("slides[1].chart.panels[0].table.headr", "table", "headr", "header"),
        ("slides[2].left.parts[0].parts[0].txet", "pane", "txet", "text"), ("slides[2].right.diagram.rows[0].stages[0].lable", "stage", "lable", "label")], key=str)


def test_what_kinds_draw(spark):
    deck = [
        {"kind": "content", "title": "t", "table": {"rows": []}}, {"title": "t", "figure": {"path": "x"}, "table": {"rows": [[1]]}, "chart": {"kind": "heat", "col_notes": ["n"]}},
        {"big": "9", "foot": "f"}, {"title": "t", "bullets": ["b"], "steps": ["s"], "pause": 3}, {"chart": {"panels": [{"title": "t"}], "kind": "tiles", "verdict": {"hit": "bad"}, "ylabel": "y"}}]
    got = rows(trees.undrawn_keys(tree(spark, deck)), "node", "kind")
    assert got == sorted([("[0].table", "content"), ("[1].chart.col_notes", "chart heat"), ("[2].foot", "standout"), ("[4].chart.ylabel", "chart tiles")])
    wrong = [{"diagram": {"kind": "spiral", "boxes": [{"label": "one"}]}}, {"diagram": {"kind": "grid", "cols": ["a", "b"]}}, {"diagram": {"boxes": ["x"]}}, {"left": {"diagram": {"kind": "graph", "nodes": []}}}]
    assert rows(trees.missing_parts(tree(spark, wrong)), "node", "kind", "needs") == [("[0].diagram", "spiral", None), ("[1].diagram", "grid", "boxes"), ("[3].left.diagram", "graph", "nodes")]


def test_marks_tables_and_charts(spark):
    table = {"header": ["a"], "rows": [["1"]]}
    deck = [
        {"big": [{"value": "-15.3", "mark": "hit"}, {"value": "+0.4"}]}, {"diagram": {"kind": "pipeline", "rows": [{"stages": [{"label": "x", "mark": "a"}]}]}},
        {"diagram": {"kind": "strip", "rows": [{"cells": [{"label": "R", "mark": "ride"}]}]}}, {"diagram": {"rows": [{"mark_at": 0}]}}, {"chart": {"callout": {"at": 1}}}, {"table": {"mark": "x"}},
        {"table": table, "chart": {"from": "self"}}, {"table": table, "chart": {"from": "self", "table": table}}, {"left": {"table": table}, "right": {"chart": {"from": "left"}}}, {"left": {"parts": [{"diagram": {"mark": "a"}}, {"text": "t"}]}, "right": {"text": "x"}},
    ]
    facts = {r.slide: r for r in trees.slide_facts(tree(spark, deck)).collect()}
    assert [facts[i].has_marks for i in range(10)] == [True, True, False, True, True, False, False, False, False, True]
    assert [(facts[i].n_tables, facts[i].same_twice) for i in (6, 7, 8)] == [(0, False), (1, True), (1, True)]
    assert facts[9].n_chunks == 3 and facts[9].kind == "columns" and facts[2].n_boxes == 1 and facts[0].kind == "standout"


def test_texts_of_panes_and_figures(spark):
    deck = [
        {"title": "T", "left": {"head": "unread", "bullets": ["unread"], "parts": [{"head": "H", "parts": [{"text": ["a", "b"]}]}, {"table": {"header": ["h"], "rows": [["c", 7]], "note": "n"}}]}, "right": {"block": {"title": "bt", "text": "bx", "kind": "alert"}}, "say": ["not shown"], "cue": "no"},
        {"chart": {"title": "ct", "panels": [{"title": "p", "table": {"rows": [["x"]]}}], "verdict": {"hit": "v"}, "caption": "cap", "col_notes": ["cn"]}, "diagram": {"boxes": [{"label": "l", "mark": "a"}, "plain"], "legend": {"a": "role"}, "takeaway": ""}},
    ]
    t = tree(spark, deck)
    assert sorted(r.text for r in trees.screen_texts(t).where("slide = 0").collect()) == sorted(["T", "a", "b", "h", "c", "7", "n", "bt", "bx"])
    assert sorted(r.text for r in trees.screen_texts(t).where("slide = 1").collect()) == sorted(["ct", "p", "x", "cn"])
    assert sorted(r.text for r in trees.figure_words(t).collect()) == sorted(["ct", "p", "cap", "cn", "l"])
    assert rows(trees.boxes(t), "slide", "diagram", "label") == [(1, "diagram", "l"), (1, "diagram", "plain")]


def test_acronyms(spark):
    bad = {"meta": {"acronyms": {"ECU": "many", "GPU": 0, "MB": 2, "x": None}}, "slides": []}
    t = tree(spark, bad, {"meta": {"acronyms": ["ECU"]}}, {"meta": {"acronyms": {"ZZTOP": 5}}})
    assert rows(trees.bad_acronyms(t), "path", "name") == [("s0", "ECU"), ("s0", "GPU"), ("s0", "x"), ("s1", None)]
    assert rows(trees.acronyms(t), "path", "table") == [("s0", {"MB": 2.0}), ("s2", {"ZZTOP": 5.0})]


YAML = """# a deck
meta: {title: T, lang: en}
slides:
  - kind: content
    title: "One: two"
    bullets: [a, b]
    say:
      - |
        first
        second
  - table:
      header: [x, y]
      rows:
        - [1, 2.50]
    backup: true
    tabel: 3
"""


def test_yaml(spark):
    pytest.importorskip("yaml")
    t = tree(spark, YAML, "a: [1", "- title: list\n- big: 5\n")
    assert rows(trees.unknown_keys(t), "node", "nearest") == [("slides[1].tabel", "table")]
    assert rows(t.where("rel = 'title'"), "path", "slide", "value") == [("s0", 0, "One: two"), ("s2", 0, "list")] and t.where("path = 's1' AND kind IS NULL").count() == 1
    df = spark.createDataFrame([("y", YAML), ("n", None), ("w", "words"), ("j", '[{"title": "t", "zzz": 1, "chart": {}}]')], "path string, text string")
    parsed = specs.parse(df)
    assert rows(parsed.where("slide IS NOT NULL"), "path", "n", "slide.kind") == [("j", 0, "content"), ("y", 0, "content"), ("y", 1, "table")]
    assert rows(parsed.where("path = 'y'"), "slide.backup", "slide.say") == [(False, ["first\nsecond\n"]), (True, [])]
    found = rows(trees.violations(df), "path", "section", "node")
    assert found == [("j", "not drawn", "[0].chart"), ("j", "unknown key", "[0].zzz"), ("n", "no spec", ""), ("w", "no spec", ""), ("y", "unknown key", "slides[1].tabel")]


def test_key_reference_names_every_key_once():
    listed = trees.key_reference()
    assert len(listed) == len(set(listed)) == sum(map(len, trees.KEYS.values())) and ("pane", "parts", "pane") in listed
    assert all(shape in (*trees.KEYS, "spec", "pipeline", "strip") and (shape not in trees.KEYS or name in trees.KEYS[shape]) for shape, name in trees.BELOW)


def test_density_of_slides(spark):
    table = {"header": ["a", "b", "c", "d", "e"], "rows": [["1"] * 5] * 9}
    deck = [
        {"kind": "title", "title": "T"}, {"title": "Only bullets", "bullets": ["one two", "**three**"]}, {"title": "Why?", "table": table, "cue": "point"}, {"big": [{"value": "9", "mark": "hit"}], "lead": "so what?"},
        {"title": "x", "left": {"bullets": ["p"], "parts": [{"bullets": ["a b c"]}, {"figure": {"path": "f"}}]}, "right": {"text": "t"}}, {"title": "eaten", "table": table, "chart": {"from": "self"}, "note": "n"},
        {"title": "back", "backup": True, "bullets": ["b"]}, {"title": "f", "formula": "$x$", "bullets": ["<hit>b</hit>"]}]
    t = tree(spark, deck)
    d = {r.slide: r for r in trees.slide_density(t).collect()}
    assert [d[i].bullets_only for i in range(8)] == [False, True, False, False, False, False, True, False] and [d[i].question for i in (0, 2, 3)] == [False, True, True]
    assert [d[i].emphasis for i in range(8)] == [False, True, False, True, False, False, False, True] and [d[i].table for i in (2, 4, 5)] == [True, False, False] and d[4].figure and (d[4].n_bullets, d[4].n_words) == (1, 3)
    p = trees.density(t).first()
    assert (p.n_slides, p.figure, p.table, p.columns, p.standout, p.question, p.bullets_only) == (7, 3 / 7, 1 / 7, 1 / 7, 1 / 7, 2 / 7, 1 / 7)
    assert p.emphasis == 2 / 5 and p.bullets_a_slide == 4 / 7 and p.words_a_bullet == 7 / 4
    notes = rows(trees.slide_notes(t, max_rows=8), "slide", "note")
    assert [n for n in notes if n[1] == "undirected"] == [(i, "undirected") for i in (1, 3, 4, 7)] and (2, "large table") in notes and (5, "large table") in notes and (2, "too many rows") in notes and (1, "bullets only") in notes


def test_parts_lists_and_flat_diagrams(spark):
    deck = [
        {"chart": {"kind": "bars", "ylabel": "y", "table": {"header": ["no"]}, "panels": [{"title": "p", "table": {"rows": [["no"]]}}], "callout": {"text": "c"}}, "backup": True},
        {"left": {"parts": [{"figure": {"path": "a.png", "highlight": [{"label": "look", "x": 0}]}}]}, "right": {"figure": {"grid": {"images": [["b.png", "c.png"]], "cols": ["u", "v"]}}}}, {"big": [{"value": "9", "label": "n"}, {"text": "w"}]},
        {"diagram": {"boxes": [{"label": "x"}]}}, {"left": {"diagram": {"rows": [{"mark_at": 0}]}}, "right": {"diagram": {"boxes": [{"mark": "a"}]}}}]
    t = tree(spark, deck)
    found = {}
    for r in trees.parts(t).collect():
        found.setdefault(r.what, set()).add((r.slide, r.field, r.value))
    assert found == {
        "chart field": {(0, "kind", "bars"), (0, "ylabel", "y"), (0, "title", "p"), (0, "text", "c")}, "figure": {(1, "path", "a.png"), (1, "images", "b.png"), (1, "images", "c.png")}, "grid text": {(1, "cols", "u"), (1, "cols", "v")},
        "highlight": {(1, "label", "look")}, "big": {(2, "value", "9"), (2, "label", "n"), (2, "text", "w")}}
    assert rows(trees.page_lists(t), "list", "slides") == [("backup", [0]), ("drawn", [0, 3, 4]), ("highlight", [1])]
    assert rows(trees.flat_diagrams(t), "n_diagrams", "n_flat") == [(3, 1)]


def test_values_are_told_once_and_read_no_more(spark):
    texts = ['[{"title": "a", "bullets": ["x", [], {}, "", 0, 0.5, true, false, null]}]', '{"meta": {}, "slides": []}', "[]", "{}", None, "plain"]
    tree = trees.nodes(spark.createDataFrame(list(enumerate(texts)), "path int, text string"))
    got = {(r.path, r.node): (r.kind, r.value, r.filled) for r in tree.collect()}
    assert got[0, "[0].bullets"] == ("array", None, True) and got[0, "[0].bullets[1]"] == ("array", None, False) and got[0, "[0].bullets[2]"] == ("object", None, False)
    scalars = [got[0, f"[0].bullets[{i}]"] for i in (0, 3, 4, 5, 6, 7, 8)]
    assert scalars == [("text", "x", True), ("text", "", False), ("number", "0", False), ("number", "0.5", True), ("boolean", "true", True), ("boolean", "false", False), (None, None, False)]
    assert got[1, ""] == ("object", None, True) and got[1, "meta"] == ("object", None, False) and got[1, "slides"] == ("array", None, False)
    assert got[2, ""] == ("array", None, False) and got[3, ""] == ("object", None, False) and got[4, ""] == (None, None, False) == got[5, ""]
    assert "variant" not in tree._jdf.queryExecution().optimizedPlan().toString()  # checks read no value again


def test_slides_apart_give_the_tree_of_the_whole(spark):
    slides = [{"title": "a", "left": {"head": "cut", "parts": [{"text": "t", "parts": [{"text": "u"}]}, "p"]}, "right": {"text": "r", "parts": []}}, {}, {"a.b": [[], {"x\ny": 0}]}, {"big": "9", "parts": [1]}] * 4
    deep = {"meta": {"title": "T"}, "slides": slides}
    whole = tree(spark, slides, deep)
    texts = spark.createDataFrame([(path, i, json.dumps(x)) for path in ("s0", "s1") for i, x in enumerate(slides)], "path string, i int, text string").repartition(3)
    apart = texts.select("path", F.concat(F.when(F.col("path") == "s1", "slides").otherwise(""), F.lit("["), "i", F.lit("]")).alias("node"), "text")
    heads = spark.createDataFrame([("s1", json.dumps({"meta": deep["meta"]}))], "path string, text string")
    assert rows(trees.nodes(heads, slides=apart), *whole.columns) == rows(whole, *whole.columns)
    cut = {r.rel for r in whole.where("cut AND slide = 0").collect()}
    assert cut == {"left.head", "left.parts[0]", "left.parts[1]", "left.parts[0].text", "left.parts[0].parts[0]"}


def test_no_row_holds_a_deck_whole(spark, tmp_path, monkeypatch):
    spark.range(600).selectExpr("id AS p_partkey", "'n' AS p_name", "concat('Brand#', id % 2) AS p_brand", "'T' AS p_type", "7 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    sizes, real = [], trees.written

    def seen(df, name):
        out = real(df, name)
        if "v" in df.columns:
            sizes.append(out[0].agg(F.max(F.length(F.expr("to_json(v)")))).first()[0] or 0)
        return out

    monkeypatch.setattr(trees, "written", seen)
    got = {(r.path, r.note): r.n for r in spec_queries.spec_slide_notes(spark, str(tmp_path)).collect()}
    assert 100 < max(sizes) < 1000
    assert got == {("Brand#0", "bullets only"): 50, ("Brand#0", "undirected"): 250, ("Brand#1", "undirected"): 250, ("Brand#1", "too many rows"): 50}


def test_numbers_over_ranges(spark):
    found = [(k, i % 7, f"{i:03}") for k, n in (("a", 500), (None, 40), ("b", 1), ("", 3)) for i in range(n)]
    df = spark.createDataFrame(found, "k string, o int, t string").repartition(5)
    want = [(*x, n) for k in ("a", None, "b", "") for n, x in enumerate(sorted((x for x in found if x[0] == k), key=lambda x: x[1:]))]
    assert rows(numbered(df, "k", ["o", "t"]), "k", "o", "t", "n") == sorted(want, key=str)
