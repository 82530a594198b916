"""Readers and nested grammar on small planted texts."""

import json

import pyspark.sql.functions as F

from verisift.functions import markup as M
from verisift.sources import manuscripts as S, specs

TEX = r"""\documentclass{article} % a comment with 9.9
\newcommand{\gain}{12.5\%}
\begin{document}
\section{Intro}
We gain \gain{} at 100\% load. \iffalse hidden 8.8 \fi
\iftoggle{long}{long text}{short text}
\subsection{More}
\begin{tabular}{l*{2}{r}@{\hskip 5pt}}
\toprule Name & A & \textbf{B} \\ x & $-$1 & 2 \\ \multicolumn{2}{c}{both} & 3 \\ \bottomrule
\end{tabular}
\begin{figure}\caption[short]{A \emph{nested {deep}} one.}\end{figure}
\end{document}"""


def test_accents_leave_commands_alone():
    texts = {
        r"\cite{a} \caption{Fig} \vspace{1em} \cline{1-2} \centering \hline \ref{r} \k \underline{u}": None,
        r"R{\'e}, R\'{e}, R\'e, {\'{e}}": "Ré, Ré, Ré, é", r"{R{\'e}}": "{Ré}", r"\c{c}a \v{s} \H{o} {\u{a}} \r{a} \k{e}": "ça š ő ă å ę", r"{\ss} \ss{} {\o} \o {\l}ód\'z \AA": "ß ß{} ø \\o łódź Å",
        r"\"o {\=a} \.z {\.z} \^o \^{o}": "ö ā \\.z ż \\^o ô", r"\i \ae x": "\\i æ x",
    }
    for text, want in texts.items():
        assert M.with_accents(text) == (text if want is None else want)


def test_wrap_count(spark):
    rows = spark.createDataFrame([("",), ("a b c",), ("a b cde",), ("abcdefgh ij",), ("abcde f",), (None,)], "t string")
    assert [r.n for r in rows.select(M.wrap_count(rows.t, 5).alias("n")).collect()] == [0, 1, 2, 3, 2, None]


def test_plain_functions():
    assert M.closing("{a{b}c}d", 0) == 7 and M.closing(r"{a\}b}", 0) == 6 and M.closing("{open", 0) == 5
    assert M.without_commands(r"a \x{b{c}}d \y", ["x"]) == r"a d \y" and M.without_commands(r"\emph{a \emph{b}}", ["emph"], True) == "a b"
    assert M.captions(TEX) == [r"A \emph{nested {deep}} one."]
    assert "9.9" not in M.without_comments(TEX) and "8.8" not in M.without_comments(TEX) and r"100\%" in M.without_comments(TEX)
    assert r"12.5\%" in M.with_macros(TEX) and r"\gain" not in M.with_macros(TEX)
    assert "short text" in M.with_toggles(TEX) and "long text" in M.with_toggles(r"\toggletrue{long}" + TEX)
    assert M.with_accents(r"caf\'{e} \"o") == "café ö"
    assert M.math_text(r"$\alpha_{12} \leq \frac{1}{2} x^{2}$") == "α₁₂ ≤ 1/2 x²"
    spoken = {
        "Three hundred and twelve cases, twenty-five percent": "312 cases, 25%", "five and six": "5 and 6", "one two three": "1 2 3", "a percent of it": "a percent of it", "nine hundred ninety-nine": "999",
        "forty nine, sixty and two hundred": "49, 60 and 200", "one thousand two": "1 thousand 2", "twenty-twelve one_two tone": "20-12 one_two tone", "4 per cent": "4%", "hundred and one": "hundred and 1",
        "two hundred and": "200 and", "three hundred\nand\tforty": "340", "": "",
    }
    assert {x: M.number_words(x) for x in spoken} == spoken
    assert "12.5" not in M.clean_prose(r"We $12.5$ see \cite{a} \textbf{bold} \& more") and "bold & more" in M.clean_prose(r"We \textbf{bold} \& more")
    assert S.column_spec(r"l*{2}{r}@{\hskip 5pt}p{3cm}|c>{\bf}S") == ["l", "r", "r", "l", "c", "S"]


def test_columns_agree_with_functions(spark):
    df = spark.createDataFrame([(TEX,), ("no markup, 5 percent",), (None,)], "t string")
    got = [r.r for r in df.select(M.strip_comments(F.col("t")).alias("r")).collect()]
    assert got == [M.without_comments(TEX), "no markup, 5 percent", None]
    assert [r.r for r in df.select(M.wrap_count(F.col("t"), 10).alias("r")).collect()][1:] == [2, None]


def test_read_and_sections(spark, tmp_path):
    (tmp_path / "a.tex").write_text(TEX)
    (tmp_path / "b.md").write_text("---\ntitle: T\nauthor: Me\n---\nstart\n# One\ntext 1.5\n## Two ##\n| a | b |\n|---|:-:|\n| 1 | 2 | 3 |\n| x |\n\n![cap](f.png)\n# References\n[1] A. Author. 2019.\n[2] B. Other, 2020 and 1999.\n")
    docs = S.read(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    assert {r.path: r.syntax for r in docs.collect()} == {"a.tex": "latex", "b.md": "plain"}
    heads = [(r.path, r.level, r.title) for r in S.sections(docs).orderBy("path", "sec_no").collect()]
    assert heads == [("a.tex", 0, ""), ("a.tex", 1, "Intro"), ("a.tex", 2, "More"), ("b.md", 0, ""), ("b.md", 1, "One"), ("b.md", 2, "Two"), ("b.md", 1, "References")]
    cells = [(r.r, r.c, r.cell, r.n_ragged) for r in S.markdown_tables(docs).orderBy("r", "c").collect()]
    assert cells == [(0, 0, "a", 2), (0, 1, "b", 2), (1, 0, "1", 2), (1, 1, "2", 2), (2, 0, "x", 2), (2, 1, "", 2)]
    tex = {(r.r, r.c): r.cell for r in S.tex_tables(docs).collect()}
    assert tex[0, 2] == "B" and tex[1, 1] == "-1" and tex[2, 0] == tex[2, 1] == "both"
    assert [(r.file, r.caption) for r in S.markdown_figures(docs).collect()] == [("f.png", "cap")]
    assert [(r.no, r.years) for r in S.references(docs).where("path = 'b.md'").collect()] == [(0, ["2019"]), (1, ["2020", "1999"])]
    assert docs.where("path = 'b.md'").select(S.front_matter(F.col("text")).alias("m")).first().m == {"title": "T", "author": "Me"}


def test_includes(spark):
    files = spark.createDataFrame([("m.tex", r"a \input{x} b \include{y.tex} c"), ("x.tex", r"X\input{y}"), ("y.tex", r"Y\input{m}")], "path string, text string")
    got = {r.path: r.text for r in S.with_includes(files).collect()}
    assert got["m.tex"] == "a XY b Y c"


def test_specs(spark):
    good = [{"kind": "title", "title": "T"}, {"title": "C", "bullets": ["a"], "say": ["x", "y"], "backup": True}, {"title": "W", "table": {"header": ["a", "b"], "rows": [["1", "2"]]}}]
    bad = [{"kind": "poster"}, {"kind": "figure", "big": "x"}, {"title": "a\x0cb", "table": {"header": ["a"], "rows": [["1", "2"]]}}]
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("no", "x: y")], "path string, text string")
    slides = specs.parse(df)
    rows = sorted((r.path, r.n, r.section) for r in specs.violations(slides).collect() if r.path != "no")
    assert rows == [("bad", 0, "unknown kind"), ("bad", 1, "not drawn"), ("bad", 2, "escape"), ("bad", 2, "ragged")]
    assert specs.violations(slides).where("path = 'no'").first().section == "syntax"
    audit = {r.n: (r.kind, r.place, r.page) for r in specs.audit_rows(slides).where("path = 'good'").collect()}
    assert audit == {0: ("title", 1, None), 1: ("content", 3, None), 2: ("table", 2, 1)}


def test_sidecar_and_logs(spark, tmp_path):
    old = spark.createDataFrame([("a", "r", "c", "1"), ("b", "r", "", "2")], "tag string, row string, col string, value string")
    new = spark.createDataFrame([("a", "r", "c", "9")], old.schema)
    path = str(tmp_path / "side")
    for _ in range(2):
        specs.write_sidecar(old, new, path)
    assert sorted(map(tuple, specs.read_sidecar(spark, path).collect())) == [("a", "r", "c", "9"), ("b", "r", "", "2")]
    (tmp_path / "sizes.tsv").write_text("# png\n" + "a.png\t10\t20\tff\t7.5\ttext\nb.png\tx\t20\tff\t7\tbad\n")
    assert [(r.png, r.pt) for r in specs.read_figure_text(spark, str(tmp_path / "sizes.tsv")).collect()] == [("a.png", 7.5)]
    log = spark.createDataFrame([("l", 1, "over", 9.0), ("l", 2, "page", 1.0), ("l", 3, "over", 5.0), ("l", 4, "over", 8.0), ("l", 5, "page", 2.0), ("l", 6, "over", 7.0)], "path string, pos long, kind string, v double")
    assert sorted((r.page, r.pt) for r in specs.overfull(log).collect()) == [(1, 9.0), (2, 8.0), (3, 7.0)]


def test_lines_from_spans(spark):
    spans = spark.createDataFrame([(1, 10.0, 100.0, "b", 10.0), (1, 0.0, 101.0, "a", 10.0), (1, 0.0, 120.0, "c", 10.0)], "page int, x0 double, y0 double, text string, size double")
    assert sorted((r.line, r.text) for r in S.pieces_to_lines(spans).collect()) == [(1, "a b"), (2, "c")]


def test_streams(spark, tmp_path):
    from verisift.streaming.sidecar import upsert_stream, windowed_counts

    src = str(tmp_path / "in")
    schema = "tag string, line string"
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: upsert_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    spark.createDataFrame([("a", "9")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "state" / "v1")).collect())) == [("a", "9"), ("b", "2")]
    ev = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS event_type UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'x'")
    assert windowed_counts(ev).first().n == 2


def test_toggles_hand_their_state_down():
    t = r"\toggletrue{x}\toggletrue{y}\iftoggle{x}{\iftoggle{y}{Y}{N}}{Z}"
    assert M.with_toggles(t).endswith("{y}Y") and M.with_toggles(r"\newtoggle{x}\iftoggle{x}{a}{b}").endswith("b")
    assert M.with_toggles(r"\toggletrue{x}\newtoggle{x}\iftoggle{x}{a}{\toggletrue{z}b}\iftoggle{z}{c}{d}").endswith("bc")


def test_fractions_nest_without_limit():
    deep = "g"
    for c in "fedcba":
        deep = rf"\frac{{{c}}}{{{deep}}}"
    assert M.math_text(deep) == "a/b/c/d/e/f/g"


def test_references_have_no_limit(spark):
    text = "".join(rf"\bibitem{{k{i}}} Entry {i} of 19{i % 90 + 10}. " for i in range(100_003))
    rows = S.references(spark.createDataFrame([("a", text)], "path string, text string"))
    assert rows.count() == 100_003
