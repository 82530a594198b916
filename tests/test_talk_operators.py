"""Labels on pictures, terms never said, untouched sentences, balanced titles, headers and citations on planted rows."""

import itertools
import random
import time

import pyspark.sql.functions as F

import pytest

from verisift.functions import markup as M
from verisift.operators import claims, ink, similarity
from verisift.sources import manuscripts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def picture():
    rng = random.Random(4)
    return {(i, x, y): rng.random() < (0.02 if i else 0.3) for i in (0, 1) for x in range(30) for y in range(20)}


def test_ink_of_rectangles(spark, picture):
    pixels = spark.createDataFrame([(*k, v) for k, v in picture.items()], "image long, x long, y long, dark boolean")
    rng = random.Random(7)
    boxes = [(n, rng.randrange(2), *sorted(rng.sample(range(31), 2)), *sorted(rng.sample(range(21), 2))) for n in range(200)] + [(900, 0, 5, 5, 3, 9), (901, 0, 0, 30, 0, 20)]
    asked = spark.createDataFrame(boxes, "box long, image long, x0 long, x1 long, y0 long, y1 long")
    got = {r.box: r.ink for r in ink.ink_of(asked, ink.summed_area(pixels, F.col("dark")), ["box"]).collect()}
    for n, i, x0, x1, y0, y1 in boxes:
        inside = [picture[i, x, y] for x in range(x0, x1) for y in range(y0, y1)]
        assert got[n] == pytest.approx(sum(inside) / len(inside) if inside else 0.0)
    dark = [k for k, v in picture.items() if v and k[0] == 1]
    assert (1, min(k[1] for k in dark), min(k[2] for k in dark), max(k[1] for k in dark) + 1, max(k[2] for k in dark) + 1, len(dark)) in rows(ink.ink_rectangles(pixels, F.col("dark")))


def test_labels_go_where_they_cover_least(spark):
    w, h = 100, 100
    dark = {(x, y) for x in range(w) for y in (range(23, 30) if x < 50 else range(0))} | {(x, y) for x in range(50) for y in range(50, 52)} | {(x, 30) for x in range(20)}
    pixels = spark.createDataFrame([("p", x, y, (x, y) in dark) for x in range(w) for y in range(h)], "image string, x long, y long, dark boolean")
    boxes = [("free", 0.6, 0.30, 0.2, 0.2, None), ("top", 0.6, 0.02, 0.2, 0.4, None), ("full", 0.6, 0.0, 0.1, 0.98, None), ("stated", 0.0, 0.3, 0.2, 0.2, "above"), ("taken", 0.1, 0.30, 0.3, 0.3, None), ("least", 0.0, 0.30, 0.5, 0.2, None)]
    got = {r.box: (r.place, r.covers) for r in ink.place_labels(spark.createDataFrame([("p", *b) for b in boxes], "image string, box string, x double, y double, w double, h double, label_at string"), pixels, F.col("dark")).collect()}
    assert got == {"free": ("above", False), "top": ("below", False), "full": ("inside", False), "stated": ("above", False), "taken": ("below", False), "least": ("inside", True)}


def test_terms_never_said(spark):
    talk = [
        (1, "RPC IC/OC 4x4 QM RTT DWA P4V2 w/l ExMy b/c R_T/T HBM3", "We use an RPC-based pool; IC, OC are channels. The queue manager, round-trip time, DWAs.", False),
        (2, "P4V2 again and GPU NVMe x1 II", "E-x-M-y, b over c, R T over T", False), (3, "SSD", "", True), (4, None, None, None), (5, "GPU", "HBM3", False)]
    df = spark.createDataFrame([("t", *r) for r in talk] + [("other", 1, "QM", "nothing", False)], "path string, n int, screen string, say string, backup boolean")
    assert rows(claims.unspoken(df)) == [("other", 1, "QM"), ("t", 1, "P4V2"), ("t", 1, "w/l"), ("t", 2, "GPU"), ("t", 2, "NVMe")]


def test_untouched_sentences(spark):
    source = spark.createDataFrame([(1, "Peak pressure reached 12.5 bar inside the chamber. Losses were 0.7 and 0.9 percent overall. Nothing here counts."), (2, None)], "doc_id long, text string")
    derived = lambda text: spark.createDataFrame([(9, text)], "doc_id long, text string")
    assert rows(similarity.untouched(source, derived("At 12.5 all is said, 0.7 too."))) == [(1, 2, 1)]
    assert rows(similarity.untouched(source, derived("12.5, 0.7, 0.9"))) == [(1, 2, 0)]
    assert rows(similarity.untouched(source, derived("losses were overall high, peak pressure reached"))) == [(1, 2, 0)]
    assert rows(similarity.untouched(source, derived("unrelated"))) == [(1, 2, 2)]


def test_untouched_sentences_of_held_dots_and_long_texts(spark):
    # a dot of an abbreviation is held while sentences are split; the time for many distinct words grows with their number
    source = spark.createDataFrame([(1, "See the chapter no.5 here. Pressure at 3.5 bar, fig. 4.25 shown."), (2, "no numbers here"), (3, "Odd 3\x015 sign here.")], "doc_id long, text string")
    letters = str.maketrans("0123456789", "abcdefghij")
    derived = spark.createDataFrame([(9, "4.25 " + " ".join(f"word{i}".translate(letters) for i in range(60_000)) + " pressure"), (10, None)], "doc_id long, text string")
    begin = time.monotonic()
    assert rows(similarity.untouched(source, derived)) == [(1, 1, 0), (3, 1, 1)]
    assert time.monotonic() - begin < 20


def test_balanced_wrap_equals_all_combinations(spark):
    rng = random.Random(3)
    titles = [" ".join("x" * rng.randint(1, 9) for _ in range(n)) for n in range(1, 11) for _ in range(3)] + ["", "  two  words ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    for lines in (1, 2, 3):
        got = {r.i: r.l for r in df.select("i", M.balanced_lines(F.col("t"), lines).alias("l")).collect()}
        for i, t in enumerate(titles):
            words = (t or "").split()
            if not words:
                assert got[i] == (None if t is None else [])
                continue
            cuts = [c for k in range(min(lines, len(words))) for c in itertools.combinations(range(1, len(words)), k)]
            widest = lambda c: max(len(" ".join(words[a:b])) for a, b in zip((0, *c), (*c, len(words))))
            assert " ".join(got[i]) == " ".join(words) and len(got[i]) <= lines and max(map(len, got[i])) == min(map(widest, cuts))


BIB = """@article{a1, author = {Müller, {Anna} and O'Neil, B.}, title = "A {year = 1900} \\"u\\"", year = {2001} }
% comment
@inproceedings { b2,
  author="Smith, J. {and sons}", YEAR = 1999, note = {nested {braces {deep}}}
}
@misc{c3, title = {No author}}"""


def test_bibliographies_and_years(spark):
    assert M.bib_entries(BIB) == [("article", "a1", "Müller, {Anna} and O'Neil, B.", "2001"), ("inproceedings", "b2", "Smith, J. {and sons}", "1999"), ("misc", "c3", "", "")]
    docs = spark.createDataFrame([("x.bib", BIB), ("x.bbl", "\\bibitem[S]{s} Keller, P.\n\\newblock About Brandt, 2010.\n\\bibitem{t} Smith, K.\n\\newblock T, 2005."), ("n", None)], "path string, text string")
    entries = manuscripts.bibliography(docs)
    assert [(r.path, r.years) for r in entries.orderBy("path", "no").collect()] == [("x.bbl", ["2010"]), ("x.bbl", ["2005"]), ("x.bib", ["2001"]), ("x.bib", ["1999"]), ("x.bib", [])]
    texts = spark.createDataFrame([(1, "Smith (1999), Smith et al. (2005) and Smith 2001; ICLR 2018. Keller and Smith, 2011; O'Neil (2001)"), (2, None)], "doc_id long, text string")
    assert rows(manuscripts.wrong_years(texts, entries)) == [(1, "Keller", "2011", ["2010"]), (1, "Smith", "2001", ["1999", "2005"])]


def test_headers_over_rows_and_blank_columns(spark):
    cells = [["Route", "Minutes", "", "", ""], ["", "day", "night", "", ""], ["North", "21.85", "21.85", "", " "], ["South", "13.35", "", "", ""]]
    df = spark.createDataFrame([("t", r, c, x) for r, row in enumerate(cells) for c, x in enumerate(row)] + [("u", 0, 0, ""), ("u", 0, 1, "a"), ("u", 1, 0, "1"), ("u", 1, 1, "2")], "tbl string, r int, c int, cell string")
    heads = spark.createDataFrame([("t", 2), ("u", 1)], "tbl string, n_head int")
    got = {(r.tbl, r.r, r.c): r.cell for r in manuscripts.with_merged_headers(df, heads, ["tbl"]).collect()}
    assert [got["t", 0, c] for c in range(3)] == ["Route", "Minutes day", "Minutes night"] and ("t", 0, 3) not in got
    assert [got["t", r, c] for r in (1, 2) for c in range(3)] == ["North", "21.85", "21.85", "South", "13.35", ""]
    assert [got["u", r, c] for r in (0, 1) for c in (0, 1)] == ["", "a", "1", "2"]


def test_reciprocals_said_and_shown(spark):
    df = spark.createDataFrame([("t", 1, "0.31 and 5.5, 2.0", "3.23 or 0.5"), ("t", 2, "0.31 3.23", "3.23"), ("t", 3, "3.25", "0.31 10"), ("t", 4, None, "0.5")], "path string, n int, screen string, say string")
    assert rows(claims.reciprocals(df)) == [("t", 1, 0.31, 3.23), ("t", 3, 3.25, 0.31)]


def test_counts_in_words(spark):
    slides = [
        (1, "Six limits", "Six limits of three retries", {"bullets": 5}), (2, "A title", "three retries a request", {"bullets": 5}), (3, "", "the four things, eight hours", {"grid rows": 1, "grid columns": 3}),
        (4, "", "three things", {"grid rows": 1, "grid columns": 3}), (5, "", "six cars", {"grid rows": 2, "grid columns": 3}), (6, "", "five cars, twenty more", {"items in the figure": 4}), (7, "two ways", "two ways", {"bullets": 4}), (8, None, None, {"bullets": 4})]
    df = spark.createDataFrame([("t", *s) for s in slides], "path string, n int, head string, screen string, counts map<string,int>")
    assert rows(claims.counts_off(df)) == [("t", 1, 6, 5, "bullets"), ("t", 3, 4, 1, "grid rows"), ("t", 3, 4, 3, "grid columns"), ("t", 6, 5, 4, "items in the figure")]


def test_numbers_beyond_and_conjunctions(spark):
    from verisift.functions import cells

    texts = spark.createDataFrame([("a", "Fig. 4, Figures 2, Table 3 and configuration 9"), ("b", "Table 1, fig 12"), ("c", None)], "g string, text string")
    limits = spark.createDataFrame([("a", 3, 2), ("b", 12, 0), ("c", 1, 1)], "g string, figures int, tables int")
    assert rows(claims.numbers_beyond(texts, limits, "g")) == [("a", "figure", 4, 3), ("a", "table", 3, 2)]
    titles = ["And then", "But why?", "Android", "Which one?", "Which is odd", "So", "Because.", "Sofa", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    assert [r.c for r in df.select("i", cells.opens_with_conjunction(F.col("t")).alias("c")).orderBy("i").collect()] == [True, True, False, False, True, True, True, False, False]
