"""Reading order of spans: two columns under a title, full-width lines between, raised and lowered parts, headings."""

from verisift.sources import pages


def spans(spark, *found):
    return spark.createDataFrame([(p, float(x0), float(y0), float(x1), float(y1), float(y1 - y0) if s is None else float(s), t) for p, x0, y0, x1, y1, s, t in found], "page int, x0 double, y0 double, x1 double, y1 double, size double, text string")


def test_columns_are_read_one_after_the_other(spark):
    rows = [(1, 40, 10, 560, 26, None, "A title over both")]
    rows += [(1, 40, 40 + 14 * i, 280, 50 + 14 * i, None, f"left {i}") for i in range(6)] + [(1, 320, 40 + 14 * i, 560, 50 + 14 * i, None, f"right {i}") for i in range(6)]
    rows += [(1, 40, 300, 560, 310, None, "A line across")] + [(1, 320, 320, 400, 330, None, "R"), (1, 40, 320, 100, 330, None, "L"), (1, 105, 320, 200, 330, None, "more")]
    rows += [(2, 40, 10, 200, 20, None, "one column"), (2, 340, 10, 500, 20, None, "of two parts"), (2, 40, 30, 200, 40, None, "next")]
    got = pages.read_lines(spans(spark, *rows)).orderBy("page", "no").collect()
    first = [r.text for r in got if r.page == 1]
    assert first == ["A title over both", *[f"left {i}" for i in range(6)], *[f"right {i}" for i in range(6)], "A line across", "L more", "R"]
    assert [r.text for r in got if r.page == 2] == ["one column of two parts", "next"]
    assert pages.read_lines(spans(spark)).count() == 0


def test_raised_and_lowered_parts_follow_their_base(spark):
    rows = [(1, 10, 100, 30, 112, None, "10"), (1, 31, 98, 38, 104, None, "-3"), (1, 45, 100, 60, 112, None, "x"), (1, 61, 108, 66, 114, None, "i"), (1, 70, 100, 90, 112, None, "end"), (1, 10, 116, 60, 128, None, "below")]
    assert [r.text for r in pages.read_lines(spans(spark, *rows)).orderBy("no").collect()] == ["10^-3 x_i end", "below"]


def test_two_columns_and_headings(spark):
    lines = [(1, 320.0, 510.0, 10.0, "body text that runs on and on")] * 5 + [(1, 40.0, 300.0, 14.0, "Large heading"), (1, 40.0, 300.0, 14.0, "Figure 3 shows"), (1, 40.0, 300.0, 14.0, "A sentence."), (1, 40.0, 300.0, 10.0, "2.1 METHODS"), (2, 40.0, 300.0, 10.0, "3 Methods"), (2, 40.0, 60.0, 14.0, "12")]
    df = spark.createDataFrame([("d", *r) for r in lines], "doc string, page int, x0 double, x1 double, size double, text string")
    assert {r.page: r.two for r in pages.two_columns(df, 600.0).collect()} == {1: True, 2: False}
    assert sorted({r.text for r in pages.headings(df).where("heading").collect()}) == ["2.1 METHODS", "Large heading"]
