"""Cell and title functions on planted values."""

import pyspark.sql.functions as F

from verisift.functions import cells as C


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def test_markup(spark):
    assert column(spark, ["<hit>1.2</hit>", "**a *b***", "0.128**", "plain", "`x`"], C.strip_markup) == ["1.2", "a b", "0.128**", "plain", "x"]
    assert [(r.kind, r.text) for r in column(spark, ["x <safe>9</safe>", "**b** <hit>h</hit>", "n"], C.cell_kind)] == [("safe", "x 9"), ("b", "b h"), (None, "n")]
    assert column(spark, ["*i*", "a*b", None], C.emphasised) == [True, False, False]


def test_rows_and_cells(spark):
    assert [(r.level, r.text) for r in column(spark, ["  dry", "    x", "y", None], C.indent)] == [(1, "dry"), (2, "x"), (0, "y"), (0, "")]
    assert column(spark, ["…", " ... ", "a", None], C.is_ditto) == [True, True, False, False]
    assert column(spark, [["g", "", " "], ["g", "1"], ["g"], ["", ""]], C.is_group_row, "array<string>") == [True, False, False, False]
    assert column(spark, ["a -> b --> c <- d <=> e"], C.arrows) == ["a → b → c ← d <=> e"]


def test_words(spark):
    assert column(spark, ["can't won't doesn't it's"], C.uncontracted) == ["can not will not does not it"]
    assert column(spark, ["We irrigated the tokens"], C.content_words) == [["irrigat", "token"]]
    assert column(spark, ["HVCX", "P4V2", "w/l", "n/a", "III", "4x4", "t-1", "word", "the"], C.is_jargon) == [True, True, True, False, False, False, False, False, False]
    assert column(spark, ["say E-x-M-y and b over c, x sub i"], C.spoken_forms) == [["ExMy", "b/c", "x_i"]]


def test_titles(spark):
    titles = ["Related work", "The bench we used", "Costs fall fast", "Results", "It works.", "an open pool of many nice devices here", None, ""]
    assert column(spark, titles, C.is_claim) == [False, True, True, False, True, True, False, False]
    assert column(spark, ["Why? ", "No."], C.is_question) == [True, False]
    assert column(spark, ["Let x = y", "We use the same long words throughout this sentence", "an abuse of notation"], C.notation_only) == [True, False, True]
    assert column(spark, ["안녕하 ab", "hello 안", "12"], C.language) == ["ko", "en", "ko"]
    assert column(spark, ["short", "One is here. And then a second one", "nosentence but words here"], lambda c: C.clip(c, 20)) == ["short", "One is here.", "nosentence but…"]


def test_geometry_and_folds(spark):
    assert column(spark, [[1.0, 1.4, 5.0, 5.6, 1.9]], lambda c: C.snapped(c, 0.7), "array<double>") == [[1.0, 1.0, 5.0, 5.0, 1.9]]
    assert column(spark, [4.0], C.least_cap_percent, "double") == [2.0]
    assert column(spark, ["…—", "a", " "], C.uncountable) == [True, False, False]
    df = spark.createDataFrame([("T", "L", ["1"]), ("", "L", ["1"]), (None, None, ["1", "2"])], "t string, l string, v array<string>")
    assert [r.h for r in df.select(C.heading(F.col("t"), F.col("l"), F.col("v")).alias("h")).collect()] == ["T", "L", "1 vs 2"]
