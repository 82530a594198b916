"""Reports on small planted tables."""

import pyspark.sql.functions as F

from verisift.operators import report as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_top_and_structure(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, v int")
    assert rows(R.top_rows(df, "k", [F.desc("v")], 2).select("k", "v", "n_more")) == [("a", 3, 3), ("a", 4, 3), ("b", 9, 0)]
    runs = spark.createDataFrame([("d", x) for x in ("1/4", " 2 / 4", "4/4", "3/9", "9/3", "text")], "deck string, text string")
    got = R.page_structure(runs)
    assert [tuple(r) for r in got.collect()] == [("d", 4, 3, 3, [3])]
    assert R.accepted_denominator(got, spark.createDataFrame([("d",)] * 8, "deck string")).count() == 1
    assert R.accepted_denominator(got, spark.createDataFrame([("d",)] * 9, "deck string")).count() == 0


def test_lines_and_baselines(spark):
    lines = spark.createDataFrame([("word",), ("# no",), ("re:x+ # why",), ("a|b",), ("",), ("two words  # note",)], "line string")
    assert rows(R.ban_kinds(lines)) == [("bare", 1), ("marked", 1), ("word", 2)]
    p = spark.createDataFrame([("figure", 0.2), ("bullets", 0.4), ("table", 0.2)], "name string, value double")
    b = spark.createDataFrame([("figure", 0.5, "low"), ("bullets", 0.1, "high"), ("table", 0.3, "low")], "name string, expected double, bad string")
    assert rows(R.baseline_diff(p, b).select("name", "flagged")) == [("bullets", True), ("figure", True), ("table", False)]


def test_feedback(spark):
    kind = "slide int, reserve double, last double, bound boolean"
    state = spark.createDataFrame([], kind)
    over = lambda *x: spark.createDataFrame(list(x), "slide int, over double")
    one = R.feedback(state, over((1, 10.0), (2, 8.0)))
    assert rows(one) == [(1, 10.0, 10.0, False), (2, 8.0, 8.0, False)]
    two = R.feedback(spark.createDataFrame(one.collect(), kind), over((1, 2.0), (2, 7.0)))
    assert rows(two) == [(1, 12.0, 2.0, False), (2, 8.0, 7.0, True)]


def test_widths_and_votes(spark):
    cells = spark.createDataFrame([(1, 0, "ab"), (1, 0, "abcdef"), (1, 1, "xy")], "tbl int, c int, cell string")
    assert rows(R.column_widths(cells, 8.0)) == [(1, 0, 6.0), (1, 1, 2.0)]
    w = spark.createDataFrame([("f", 7.0, 5.0, "b"), ("f", 7.0, 4.0, "a"), ("f", 7.0, 6.0, "c"), ("f", 7.0, 6.5, "d"), ("f", 7.0, 5.0, "b")], "figure string, floor double, pt double, text string")
    assert rows(R.warnings_rolled_up(w)) == [("f", 7.0, 4, 4.0, ["a", "b", "c"])]
    assert R.warnings_rolled_up(w, w.select("figure", "floor", "text")).count() == 0
    t = spark.createDataFrame([("g", 9.3), ("g", 8.9), ("h", 5.0)], "g string, pt double")
    assert rows(R.common_size(t, "g")) == [("g", 8.5), ("h", 7.0)]
    assert rows(R.binding_side(spark.createDataFrame([("f", "w"), ("f", "h"), ("g", "h")], "figure string, bound string"))) == [("f", "w"), ("g", "h")]


def test_first_uses(spark):
    uses = spark.createDataFrame([("d", 3, "red"), ("d", 5, "red"), ("d", 2, "blue"), ("d", 9, "green")], "deck string, n int, colour string")
    keys = spark.createDataFrame([("d", 4, "red"), ("d", 5, "blue")], "deck string, n int, colour string")
    assert rows(R.colour_key_missing(uses, keys)) == [("d", "blue", 2), ("d", "green", 9)]
    labels = spark.createDataFrame([("d", n, x) for x in "abc" for n in (2, 4)] + [("d", 1, "z")], "deck string, n int, label string")
    assert rows(R.never_drawn(labels, spark.createDataFrame([("d", 3)], "deck string, n int"))) == [("d", 3, 2)]
    assert R.never_drawn(labels, spark.createDataFrame([("d", 2)], "deck string, n int")).count() == 0
