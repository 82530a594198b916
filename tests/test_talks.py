"""Checks on whole talks: the planted case is found, the clean one is not."""

from verisift.operators import talks as K


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_focus_and_grids(spark):
    labels = spark.createDataFrame([(1, 0, "pump valve"), (1, 1, "storage tank"), (2, 0, "other thing")], "slide int, pos int, label string")
    claims = spark.createDataFrame([(1, "The storage tank fills"), (2, "Nothing here matches")], "slide int, claim string")
    assert rows(K.focus(labels, claims)) == [(1, "storage tank")]
    cells = spark.createDataFrame([(1, 0, "winter low", 2), (1, 1, "x", 2), (1, 3, "high pumps", 2)], "grid int, pos int, label string, n_cols int")
    r = spark.createDataFrame([(1, 0, "Winter"), (1, 1, "Summer")], "grid int, r int, row string")
    c = spark.createDataFrame([(1, 0, "Tanks"), (1, 1, "Pumps")], "grid int, c int, column string")
    assert rows(K.named_cells(cells, r, c).select("pos")) == [(0,), (3,)]


def test_thesis(spark):
    slides = spark.createDataFrame([("t", 1, "standout", "Bikes rust"), ("t", 2, "content", "pumps save water daily"), ("t", 3, "content", "nothing"), ("t", 4, "standout", "Pumps save water")], "talk string, n int, kind string, text string")
    assert rows(K.thesis(slides)) == [("t", "Pumps save water")]
    assert rows(K.off_thesis(slides)) == [("t", 1)]
    assert [(r.n, r.overlap) for r in K.thesis_coverage(slides).collect()] == [(2, 3), (3, 0)]


def test_order_and_figures(spark):
    slides = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("t", 3, True)], "talk string, n int, has_figure boolean")
    cells = spark.createDataFrame([("t", 1, x) for x in ("a", "b", "1", "2")] + [("t", 3, x) for x in ("1", "2", "3", "4.5", "-")], "talk string, n int, cell string")
    assert rows(K.concepts_before_results(slides, cells)) == [("t", 3, 1)]
    figs = spark.createDataFrame([("t", 1, "fig/a.png", False), ("t", 2, "b.png", True), ("t", 3, "c.pdf", None)], "talk string, n int, file string, photo boolean")
    assert rows(K.pasted_figures(figs, spark.createDataFrame([("t", "out/a.pdf")], "talk string, file string"))) == [("t", 3, "c.pdf")]


def test_people_and_references(spark):
    a = spark.createDataFrame([("p", 1, ["2"]), ("p", 2, ["1", "2"])], "paper string, pos int, marks array<string>")
    i = spark.createDataFrame([("p", "1", "North"), ("p", "2", "South")], "paper string, mark string, name string")
    assert rows(K.affiliations(a, i)) == [("p", ["South", "North"])]
    s = spark.createDataFrame([("d", 1, r"see \ref{f1}"), ("d", 2, r"\ref{f1} and \autoref{f2}"), ("d", 3, "none")], "doc string, sec_no int, body string")
    f = spark.createDataFrame([("d", "f1"), ("d", "f2"), ("d", "f3")], "doc string, label string")
    assert rows(K.cited_sections(s, f)) == [("d", "f1", [1, 2]), ("d", "f2", [2])]
    g = spark.createDataFrame([(1, k, x) for k, x in enumerate("aabba")], "b int, k int, x string")
    assert rows(K.repeated_labels_run(g, "b", "k", "x")) == [(1, "a", 0, 2), (1, "a", 4, 1), (1, "b", 2, 2)]
