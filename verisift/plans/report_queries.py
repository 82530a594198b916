"""Queries on reports, talks, manuscripts and specs: rows of the tables read as pages, boxes, slides and files, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cells as C, markup as M, text as T
from ..operators import claims as K, layout as L, report as V, sequence as Q, talks as A
from ..sources import manuscripts as I, specs as D
from ..sources.tables import table
from .table_queries import spoken_sql


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part")


def _pick(number: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


# ---- reports -------------------------------------------------------------------------------------


def top_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest parts of each brand by price, and how many more there are."""
    rows = _part(spark, sf_dir).select("p_brand", "p_partkey", "p_retailprice")
    top = V.top_rows(rows, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3)
    return top.select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"), F.col("n_more").cast("long").alias("n_more"))


def _runs(spark, sf_dir) -> DataFrame:
    """Page numbers of decks (customers): "n/m" texts, some of them with another total."""
    n, m = F.col("o_orderkey") % 11 + 1, F.when(F.col("o_orderkey") % 5 == 0, 12).otherwise(F.col("o_custkey") % 4 + 8)
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("deck"), F.concat(F.lit(" "), n.cast("string"), F.lit(" / "), m.cast("string")).alias("text"))


def page_structure(spark, sf_dir):
    out = V.page_structure(_runs(spark, sf_dir))
    return out.select("deck", F.col("denominator").cast("long").alias("denominator"), "n_runs", F.col("n_numbers").cast("long").alias("n_numbers"), F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def accepted_denominators(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return V.accepted_denominator(V.page_structure(runs), runs).select("deck", F.col("denominator").cast("long").alias("denominator"), "n_slides")


def ban_line_kinds(spark, sf_dir):
    """Part names written as lines of a ban list."""
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat(F.lit("re:"), name)).when(k == 1, F.concat(name, F.lit("s?"))).when(k == 2, F.concat(F.lit("# "), name)).when(k == 3, F.concat(name, F.lit("  # why"))).otherwise(F.lit("  "))
    return V.ban_kinds(_part(spark, sf_dir).select(line.alias("line")))


def density_against_baseline(spark, sf_dir):
    """Shares of parts by type, against expected ones: too low is bad for ECONOMY, too high for the others."""
    parts = _part(spark, sf_dir)
    profile = parts.groupBy(F.col("p_type").alias("name")).agg(F.round(F.avg(F.col("p_size") / 50.0), 9).alias("value"))
    baseline = parts.select(F.col("p_type").alias("name")).distinct().select("name", F.when(F.col("name") == "ECONOMY", 0.7).otherwise(0.3).alias("expected"), F.when(F.col("name") == "ECONOMY", "low").otherwise("high").alias("bad"))
    return V.baseline_diff(profile, baseline)


def fit_feedback(spark, sf_dir):
    """Reserves of slides (parts) after a pass that still overflows on some of them."""
    parts = _part(spark, sf_dir)
    state = parts.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("slide"), (F.col("p_size") / 4.0).alias("reserve"), (F.col("p_size") / 2.0).alias("last"), (F.col("p_partkey") % 9 == 0).alias("bound"))
    now = parts.where("p_partkey % 4 < 3").select(F.col("p_partkey").alias("slide"), (F.col("p_partkey") % 13 * 1.5).cast("double").alias("over"))
    return V.feedback(state, now)


def table_column_widths(spark, sf_dir):
    cells = _part(spark, sf_dir).select(F.col("p_brand").alias("tbl"), F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("p_name").alias("cell")), F.struct(F.lit(1).alias("c"), F.col("p_type").alias("cell")))).alias("x")).select("tbl", "x.*")
    return V.column_widths(cells, 72.0).select("tbl", "c", F.round("width", 6).alias("width"))


def small_text_warnings(spark, sf_dir):
    rows = _part(spark, sf_dir).where("p_size < 15").select(F.col("p_brand").alias("figure"), (F.col("p_partkey") % 2 + 7).alias("floor"), F.col("p_size").cast("double").alias("pt"), F.col("p_name").alias("text"))
    out = V.warnings_rolled_up(rows, rows.where("text LIKE 'red%'").select("figure", "floor", "text").distinct())
    return out.select("figure", "floor", "n", "least_pt", F.array_join("sample", "|").alias("sample"))


def sibling_sizes(spark, sf_dir):
    return V.common_size(_part(spark, sf_dir).select("p_brand", (F.col("p_retailprice") / 97.0).alias("pt")).where("pt < 16"), "p_brand")


def binding_sides(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("figure"), F.when(F.col("p_size") % 2 == 0, "w").otherwise("h").alias("bound"))
    return V.binding_side(rows)


def colour_keys_missing(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    uses = line.select((F.col("l_orderkey") % 200).alias("deck"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("colour"))
    keys = line.where("l_quantity > 48").select((F.col("l_orderkey") % 200).alias("deck"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("colour"))
    return V.colour_key_missing(uses, keys)


def labels_never_drawn(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    labels = line.select((F.col("l_orderkey") % 400).alias("deck"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 9).alias("label"))
    figures = line.where("l_quantity > 47 AND l_linenumber > 2").select((F.col("l_orderkey") % 400).alias("deck"), F.col("l_linenumber").alias("n"))
    return V.never_drawn(labels, figures)


# ---- talks ---------------------------------------------------------------------------------------


def _slides(spark, sf_dir) -> DataFrame:
    """Parts as slides of talks (sizes), some of them standouts."""
    p = _part(spark, sf_dir)
    text = F.concat_ws(" ", "p_name", F.lit("is"), F.when(F.col("p_partkey") % 3 > 0, F.lower("p_type")))
    return p.select(F.col("p_size").alias("talk"), F.col("p_partkey").alias("n"), F.when(F.col("p_partkey") % 4 == 0, "standout").otherwise("content").alias("kind"), text.alias("text"))


def standouts_off_thesis(spark, sf_dir):
    return A.off_thesis(_slides(spark, sf_dir))


def thesis_overlaps(spark, sf_dir):
    return A.thesis_coverage(_slides(spark, sf_dir)).groupBy("talk", F.col("overlap").cast("long").alias("overlap")).agg(F.count(F.lit(1)).alias("n_slides"), F.min("n").alias("first"))


def focus_boxes(spark, sf_dir):
    """Which of a size's parts its first part's type and name name best."""
    p = _part(spark, sf_dir)
    labels = p.select(F.col("p_size").alias("slide"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"))
    claims = p.groupBy(F.col("p_size").alias("slide")).agg(F.max_by("p_name", "p_partkey").alias("claim"))
    return A.focus(labels, claims)


def named_grid_cells(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    cells = n.select((F.col("n_nationkey") % 2).alias("grid"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("pos"), F.lit(4).alias("n_cols"), F.concat_ws(" ", "n_name", _pick(F.col("n_nationkey"), "north", "south", "east", "west", "mid")).alias("label"))
    grid = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = table(spark, sf_dir, "region").select(grid.alias("grid"), F.col("r_regionkey").alias("r"), F.concat(_pick(F.col("r_regionkey"), "north", "south", "east"), F.lit(" row")).alias("row"))
    columns = table(spark, sf_dir, "region").where("r_regionkey < 4").select(grid.alias("grid"), F.col("r_regionkey").alias("c"), _pick(F.col("r_regionkey"), "west", "mid").alias("column"))
    return A.named_cells(cells, rows, columns)


def concepts_before_results(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("talk", F.col("l_orderkey") % 300)
    slides = line.groupBy("talk", F.col("l_linenumber").alias("n")).agg((F.count_if(F.col("l_quantity") > 45) % 2 == 1).alias("has_figure"))
    cell = F.when(F.col("l_suppkey") % 3 == 0, F.lit("n/a")).when(F.col("l_quantity") > F.col("l_linenumber") * 6, F.col("l_quantity").cast("int").cast("string")).otherwise("word")
    return A.concepts_before_results(slides, line.select("talk", F.col("l_linenumber").alias("n"), cell.alias("cell")))


def pasted_figures(spark, sf_dir):
    p = _part(spark, sf_dir)
    figures = p.select(F.col("p_size").alias("talk"), F.col("p_partkey").alias("n"), F.concat(F.lit("figs/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".png")).alias("file"), (F.col("p_partkey") % 6 == 0).alias("photo"))
    drawn = p.where("p_partkey % 5 = 0").select(F.col("p_size").alias("talk"), F.concat(F.lit("out/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".pdf")).alias("file"))
    return A.pasted_figures(figures, drawn)


def author_affiliations(spark, sf_dir):
    """Nations as institutions of regions' papers, suppliers as authors."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    authors = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("paper"), F.col("s_suppkey").alias("pos"), F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 5) % 25).alias("marks"))
    out = A.affiliations(authors, n.select(F.col("n_regionkey").alias("paper"), F.col("n_nationkey").alias("mark"), F.col("n_name").alias("name")))
    return out.select("paper", F.array_join("institutions", "|").alias("institutions"))


def cited_figures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sections = o.select((F.col("o_custkey") % 40).alias("doc"), F.col("o_orderkey").alias("sec_no"), F.concat(F.lit("see \\ref{fig"), (F.col("o_orderkey") % 8).cast("string"), F.lit("} and \\cref{fig"), (F.col("o_custkey") % 5).cast("string"), F.lit("}")).alias("body"))
    figures = table(spark, sf_dir, "nation").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("doc"), F.concat(F.lit("fig"), F.col("n_nationkey").cast("string")).alias("label"))
    return A.cited_sections(sections, figures).select("doc", "label", F.size("sections").cast("long").alias("n_sections"), F.get("sections", F.lit(0)).alias("first"))


def label_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return A.repeated_labels_run(rows, "user_id", "event_id", "event_type")


def shown_before_said(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    late = K.said_late(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", "turn", F.array_distinct(T.word_run(F.col("text"))))
    return late.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_words"), F.count("said").alias("n_late"))


def new_words_by_turn(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.word_run(F.col("text"))).alias("said"), F.array_distinct(T.word_run(T.first_line(F.col("text")))).alias("shown"))
    return rows.select("conv_id", "turn", F.size(Q.new_here("said", "conv_id", ["turn"], "shown")).cast("long").alias("n_new"))


def talk_lengths(spark, sf_dir):
    """Seconds of each talk from its words and syllables, with two of pause a turn."""
    text = F.col("text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.spoken_words(text)).alias("words"), F.sum(T.syllables(text)).alias("syllables"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", F.round(T.talk_seconds(F.col("words"), F.col("syllables"), F.col("turns") * 2), 6).alias("seconds"))


# ---- text functions ------------------------------------------------------------------------------


def clipped_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", C.clip(F.col("text"), 80).alias("clip"))
    return rows.where("clip IS NOT NULL")


def line_inches(spark, sf_dir):
    """The widest line of each document at 18 points, in inches."""
    line = F.explode(F.split("text", "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    return rows.groupBy("doc_id").agg(F.round(F.max(C.text_width(F.col("line"), F.lit(18))), 6).alias("inches"))


def content_stems(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.explode(C.content_words(F.col("text"))).alias("stem"))
    return rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


def contractions(spark, sf_dir):
    said = F.concat(_pick(F.col("p_partkey"), "can't ", "won’t ", "doesn't ", "it's ", "we've "), F.col("p_name"))
    return _part(spark, sf_dir).select(C.uncontracted(said).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def notation_sentences(spark, sf_dir):
    said = F.concat(_pick(F.col("p_partkey"), "We denote ", "Let ", "By abuse of notation ", "Here x denotes ", "We see "), _pick(F.col("p_size"), "x = y_1", "the x of y", "f(x) = { z }"), F.lit(" by "), F.col("p_name"))
    return _part(spark, sf_dir).select(C.notation_only(said).alias("only"), "p_size").groupBy("only").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))


def cell_indents(spark, sf_dir):
    cell = F.concat(F.repeat(F.lit(" "), (F.col("p_partkey") % 6).cast("int")), F.when(F.col("p_partkey") % 7 == 0, "…").when(F.col("p_partkey") % 11 == 0, "**...**").otherwise(F.col("p_name")))
    rows = _part(spark, sf_dir).select(C.indent(cell).alias("x"), C.is_ditto(cell).alias("ditto"))
    return rows.groupBy(F.col("x.level").cast("long").alias("level"), "ditto").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x.text")).alias("n_chars"))


def slide_headings(spark, sf_dir):
    p = _part(spark, sf_dir)
    title, lead = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.lit("")), F.when(F.col("p_partkey") % 3 == 1, F.col("p_type"))
    return p.select(C.heading(title, lead, F.array("p_brand", F.col("p_size").cast("string"))).alias("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


# ---- manuscripts, spans and specs ----------------------------------------------------------------


def _region_texts(spark, sf_dir, line: Column, head: str, name: str = "n_name") -> DataFrame:
    """A text for each region: the head, then a line for each of its nations in order."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n")
    return n.groupBy(F.col("n_regionkey").alias("path")).agg(F.concat(F.lit(head), body, F.lit("\nend")).alias("text"))


def pipe_tables(spark, sf_dir):
    """Nations written as Markdown tables, one with cells too many, one with too few, read back as cells."""
    extra = F.when(F.col("n_nationkey") % 5 == 0, " | more").otherwise("")
    line = F.concat(F.lit("| "), F.col("n_name"), F.when(F.col("n_nationkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" | "), F.col("n_nationkey").cast("string"))), extra, F.lit(" |"))
    return I.markdown_tables(_region_texts(spark, sf_dir, line, "text\n\n| name | key |\n|:-|-:|\n")).select("path", F.col("tbl").cast("long").alias("tbl"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "cell", F.col("n_ragged").cast("long").alias("n_ragged"))


def image_lines(spark, sf_dir):
    line = F.concat(F.lit("see ![Map of "), F.col("n_name"), F.lit("](maps/"), F.col("n_nationkey").cast("string"), F.lit('.png "t") there'))
    return I.markdown_figures(_region_texts(spark, sf_dir, line, "x\n"))


def reference_years(spark, sf_dir):
    line = F.concat(F.lit("["), (F.col("n_nationkey") + 1).cast("string"), F.lit("] A. "), F.col("n_name"), F.lit(",  Title, "), (1990 + F.col("n_nationkey")).cast("string"), F.lit("."))
    rows = I.references(_region_texts(spark, sf_dir, line, "Body 1234\n\n## References\n"))
    return rows.select("path", F.col("no").cast("long").alias("no"), F.array_join("years", ",").alias("years"), F.length("entry").cast("long").alias("n_chars"))


def manuscript_syntax(spark, sf_dir):
    ending = _pick(F.col("p_partkey"), "a.tex", "b.md", "c.TXT", "d", "e.doc")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\\begin{document}"), F.col("p_name"))).otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select(I.sniff(ending, text).alias("syntax"), ending.alias("file")).groupBy("syntax", "file").agg(F.count(F.lit(1)).alias("n"))


def front_matter_keys(spark, sf_dir):
    text = F.concat(F.lit("---\ntitle: "), F.col("p_name"), F.lit("\n  nested: no\nbrand:"), F.col("p_brand"), F.lit("\n---\nbody: none\n"))
    rows = _part(spark, sf_dir).select("p_partkey", F.explode(I.front_matter(text)).alias("key", "value"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def span_lines(spark, sf_dir):
    """Parts as spans of pages (sizes): lines are spans on one baseline, read from left to right; large ones are headings."""
    p = _part(spark, sf_dir).select(F.col("p_size").alias("page"), F.col("p_name").alias("text"), (F.col("p_partkey") * 7 % 503).cast("double").alias("x0"), (F.floor(F.col("p_partkey") / 150) * 14).cast("double").alias("y0"), F.when(F.floor(F.col("p_partkey") / 150) % 4 == 0, 16.0).otherwise(10.0).alias("size"))
    lines = I.pieces_to_lines(p)
    return lines.select("page", F.col("line").cast("long").alias("line"), "text", "x0", (F.col("size") > 12).alias("heading"))


def _specs(spark, sf_dir) -> DataFrame:
    """Slide lists in JSON: the parts of a brand, with kinds, fields that their kind does not draw and ragged tables."""
    p = _part(spark, sf_dir)
    k = F.col("p_partkey") % 5
    slide = F.struct(
        F.when(k == 0, "standout").when(k == 1, "poster").alias("kind"), F.col("p_name").alias("title"), F.when(k == 2, F.array("p_type", "p_name")).alias("bullets"), F.when(k == 0, F.col("p_brand")).alias("big"),
        F.when(k == 3, F.struct(F.array(F.lit("a"), F.lit("b")).alias("header"), F.array(F.array("p_name", "p_type"), F.array("p_type")).alias("rows"))).alias("table"), F.when(k == 4, F.lit("left text")).alias("left"),
        F.array(F.concat(F.lit("We say "), F.col("p_name"))).alias("say"), F.when(F.col("p_size") > 40, True).alias("backup"), F.when(k == 2, F.lit("cause")).alias("lead"),
    )
    slides = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", slide.alias("s")))), lambda x: x["s"]))
    lists = p.groupBy(F.col("p_brand").alias("path")).agg(slides.alias("text"))
    return D.parse(lists.unionAll(lists.where("path LIKE '%1'").select(F.concat("path", F.lit("x")).alias("path"), F.concat(F.lit("x"), "text").alias("text"))))


def spec_violations(spark, sf_dir):
    return D.violations(_specs(spark, sf_dir)).groupBy("section", "detail").agg(F.count(F.lit(1)).alias("n"))


def audit_of_specs(spark, sf_dir):
    rows = D.audit_rows(_specs(spark, sf_dir))
    return rows.select("path", F.col("n").cast("long").alias("n"), "kind", "backup", F.length("screen").cast("long").alias("n_screen"), F.length("say").cast("long").alias("n_say"), F.col("place").cast("long").alias("place"), F.col("page").cast("long").alias("page"))


def prose_of_markup(spark, sf_dir):
    """Part names inside markup, reduced to what a reader reads; equal texts are counted, then read once."""
    text = F.concat(F.lit("\\section{"), F.col("p_name"), F.lit("} % note\nWe~see \\cite{k} \\textbf{"), F.col("p_type"), F.lit("} and $x^2$ {now}."))
    texts = _part(spark, sf_dir).groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.select(M.prose(M.strip_comments(F.col("text"))).alias("prose"), "n").groupBy("prose").agg(F.sum("n").alias("n"))


def _said(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def accented_names(spark, sf_dir):
    """Part names with accents as commands, among commands that only look like some."""
    k = F.col("p_partkey") % 4
    accent = F.when(k == 0, "R{\\'e}").when(k == 1, "\\c{c}a").when(k == 2, '{\\"o}').otherwise("{\\ss}")
    return _part(spark, sf_dir).select(M.fold_accents(_said(accent, " \\cite{a} ", F.col("p_name"), " \\caption{v}")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def expanded_macros(spark, sf_dir):
    text = _said("\\newcommand{\\what}{", F.col("p_name"), "}\\def\\kind{", F.col("p_type"), "}See \\what{} and \\kind, not \\whatever.")
    return _part(spark, sf_dir).select(F.trim(M.expand_macros(text)).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def resolved_toggles(spark, sf_dir):
    toggle = F.when(F.col("p_partkey") % 3 == 0, "\\toggletrue{x}").when(F.col("p_partkey") % 3 == 1, "\\togglefalse{x}").otherwise("")
    inner = F.when(F.col("p_partkey") % 2 == 0, "\\toggletrue{y}").otherwise("")
    text = _said(toggle, inner, "a \\iftoggle{x}{", F.col("p_name"), "}{\\iftoggle{y}{z}{", F.col("p_type"), "}} b")
    return _part(spark, sf_dir).select("p_partkey", M.resolve_toggles(text).alias("text"))


def caption_texts(spark, sf_dir):
    text = _said("\\begin{figure}\\caption[short]{", F.col("p_name"), " in {\\bf braces} \\}}\\end{figure} \\caption{", F.col("p_type"), "}")
    return _part(spark, sf_dir).select(F.explode(M.caption_list(text)).alias("caption")).groupBy("caption").agg(F.count(F.lit(1)).alias("n"))


def dropped_commands(spark, sf_dir):
    text = _said("a \\note{", F.col("p_name"), "{x}}[b] \\emph{", F.col("p_type"), "} % c\n d \\iffalse gone \\fi e")
    return _part(spark, sf_dir).select(M.strip_comments(M.drop_commands(text, ["note"])).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def formula_texts(spark, sf_dir):
    text = _said("$\\alpha_{", F.col("p_size").cast("string"), "} \\times x^2 \\le \\frac{\\mathrm{", F.col("p_type"), "}}{2}$")
    return _part(spark, sf_dir).select(M.math_to_text(text).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def tabular_cells(spark, sf_dir):
    """Nations written as a tabular for each region, with a cell over both columns at the end, read back as cells."""
    line = F.concat(F.replace("n_name", F.lit("_"), F.lit("\\_")), F.lit(" & \\textbf{"), F.col("n_nationkey").cast("string"), F.lit("} \\\\ \\hline"))
    docs = _region_texts(spark, sf_dir, line, "\\begin{tabular}{l*{1}{r}}\nName & Key \\\\\n").withColumn("text", F.concat("text", F.lit(" \\multicolumn{2}{c}{all} \\\\\n\\end{tabular}")))
    docs = docs.withColumn("text", F.regexp_replace("text", "\nend ", "\n"))
    return I.tex_tables(docs).select("path", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "cell")


def included_files(spark, sf_dir):
    """Regions as files that include nations' files, which include one another's in circles of five."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = lambda c: F.col(c).cast("string")
    mains = r.select(F.concat(F.lit("/x/r"), key("r_regionkey"), F.lit(".tex")).alias("path"), F.concat("r_name", F.lit(": \\input{n"), (F.col("r_regionkey") * 5).cast("string"), F.lit("} end")).alias("text"))
    parts = n.select(F.concat(F.lit("/x/n"), key("n_nationkey"), F.lit(".tex")).alias("path"), F.concat(F.lit("["), "n_name", F.lit(" \\include{n"), (F.col("n_nationkey") + F.when(F.col("n_nationkey") % 5 == 4, -4).otherwise(1)).cast("string"), F.lit("}]")).alias("text"))
    return I.with_includes(mains.unionAll(parts)).where("path LIKE '%/r%'")


# ---- layout --------------------------------------------------------------------------------------


def _boxes(spark, sf_dir) -> DataFrame:
    """Suppliers as boxes of pages."""
    s = table(spark, sf_dir, "supplier")
    x, y = (F.col("s_suppkey") * 37 % 400).cast("double"), (F.col("s_suppkey") * 53 % 300).cast("double")
    return s.select((F.col("s_suppkey") % 10).alias("page"), F.col("s_suppkey").alias("box"), x.alias("x0"), y.alias("y0"), (x + 20 + F.col("s_nationkey") * 3).alias("x1"), (y + 15 + F.col("s_nationkey")).alias("y1"))


def crossed_boxes(spark, sf_dir):
    """Boxes that straight arrows between points given by parts run through."""
    k = F.col("p_partkey")
    paths = _part(spark, sf_dir).select((k % 10).alias("page"), k.alias("path"), (k * 11 % 400).cast("double").alias("x0"), (k * 29 % 300).cast("double").alias("y0"), (k * 71 % 400).cast("double").alias("x1"), (k * 13 % 300).cast("double").alias("y1"))
    return L.crossed_boxes(paths, _boxes(spark, sf_dir), steps=16)


def boxes_on_canvas(spark, sf_dir):
    moved = _boxes(spark, sf_dir).select("page", "box", *[(F.col(c) - d).alias(c) for c, d in (("x0", 100), ("x1", 100), ("y0", 60), ("y1", 60))])
    return L.on_canvas(moved, F.lit(240.0), F.lit(180.0)).groupBy("page").agg(F.count(F.lit(1)).alias("n_boxes"), F.min("box").alias("first"))


def callout_rows(spark, sf_dir):
    """Callouts by number and by name at the nations of a region."""
    n = table(spark, sf_dir, "nation")
    pos = F.floor(F.col("n_nationkey") / 5).cast("long")
    labels = n.select(F.col("n_regionkey").alias("chart"), pos.alias("pos"), F.concat(F.lit(" "), F.lower("n_name")).alias("label"))
    targets = n.select(F.col("n_regionkey").alias("chart"), F.when(F.col("n_nationkey") % 3 == 0, (F.col("n_nationkey") % 7).cast("string")).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit(" "))).otherwise("none").alias("target"))
    return L.callouts(targets, labels)


def referenced_tables(spark, sf_dir):
    p = _part(spark, sf_dir)
    slide = F.floor(F.col("p_partkey") / 2)
    tables = p.select(slide.alias("slide"), F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 3 == 1, "left").otherwise("right").alias("pane"), F.col("p_partkey").alias("tbl"))
    references = p.select(slide.alias("slide"), _pick(F.col("p_partkey"), "self", "left", "right").alias("ref")).distinct()
    one = tables.groupBy("slide", "pane").agg(F.min("tbl").alias("tbl"))
    return L.table_of(references, one)


def backup_only_values(spark, sf_dir):
    """Parts as sentences with their size and the next one as numbers, which other parts of the brand show on slides."""
    p = _part(spark, sf_dir).select("p_brand", "p_partkey", "p_size")
    sentences = p.where("p_partkey % 5 = 0").select("p_brand", "p_partkey", F.when(F.col("p_size") % 7 > 0, F.array("p_size", F.col("p_size") + 1)).otherwise(F.array().cast("array<int>")).alias("values"))
    slides = p.where("p_partkey % 5 > 0").select("p_brand", (F.col("p_partkey") % 4 < 3).alias("backup"), F.array("p_size").alias("values"))
    return L.backup_only(sentences, slides, "p_brand", "p_partkey")


def long_topic_hits(spark, sf_dir):
    """Words of documents that the benchmark has, or has as a part or the whole of a long word."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.alpha_words(F.col("text"))).alias("word"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.alpha_words(F.col("text"))).alias("word"))
    return L.topic_hits(words, known, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))


def wide_tokens(spark, sf_dir):
    texts = _part(spark, sf_dir).select(F.col("p_partkey").alias("box"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), (F.col("p_size") % 20 + 8).cast("double").alias("pt"), (F.col("p_size") / 40.0).alias("inches"))
    return L.wide_tokens(texts)


def table_heights(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return L.table_heights(line.select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("r"), F.ceil(F.col("l_quantity") / 10).alias("lines"), (F.col("l_suppkey") % 3 + 10).alias("line_height")))


def marked_cells(spark, sf_dir):
    cell = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("**"), "p_name", F.lit("**"))).when(F.col("p_size") < 25, F.lit("–")).otherwise(F.col("p_name"))
    return L.marked_share(_part(spark, sf_dir).select(F.col("p_brand").alias("tbl"), (F.col("p_partkey") % 6).alias("r"), cell.alias("cell")))


def _pixels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("image"), F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), F.floor(F.col("l_quantity") * F.col("l_linenumber") / 3).cast("long").alias("colour"))


def paper_colours(spark, sf_dir):
    return L.paper_colour(_pixels(spark, sf_dir), F.col("colour") < 6)


def photographs(spark, sf_dir):
    out = L.photographs(_pixels(spark, sf_dir), least=100)
    return out.select("image", "n_colours", F.round("top_share", 9).alias("top_share"), "photo")


def ink_runs(spark, sf_dir):
    rows = _pixels(spark, sf_dir).groupBy("image", "x").agg(F.max("colour").alias("colour"))
    return L.ink_runs(rows, F.col("colour") > 60, ["image"], "x").select("image", F.round("share", 9).alias("share"), "n_runs")


def figure_room(spark, sf_dir):
    slides = _part(spark, sf_dir).select("p_partkey", (F.col("p_size") % 3).alias("leads"), (F.col("p_size") % 7).alias("lines"), F.when(F.col("p_size") > 30, 1).alias("foot"))
    return slides.select("p_partkey", F.round(L.room(slides, 4.5, {"leads": 0.4, "lines": 0.75, "foot": 0.3}), 6).alias("inches"))


def omitted_values(spark, sf_dir):
    text = F.concat(_pick(F.col("p_partkey"), "14,562,0.99", "0.99,108,109", "1,234,567, 8", "a;b,c; ", ",,7"), F.when(F.col("p_size") % 2 == 0, ",x").otherwise(""))
    return _part(spark, sf_dir).select(F.array_join(C.omitted(text), "|").alias("parts")).groupBy("parts").agg(F.count(F.lit(1)).alias("n"))


def font_families(spark, sf_dir):
    name = F.concat(_pick(F.col("p_partkey"), "ABCDEF+", "", "Abcdef+"), _pick(F.col("p_size"), "Arial-Bold", "TimesNewRomanPS-ItalicMT", "Calibri,Bold", "ArialMT"))
    return _part(spark, sf_dir).select(C.font_family(name).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        top_warnings, page_structure, accepted_denominators, ban_line_kinds, density_against_baseline, fit_feedback, table_column_widths, small_text_warnings, sibling_sizes, binding_sides, colour_keys_missing,
        labels_never_drawn, standouts_off_thesis, thesis_overlaps, focus_boxes, named_grid_cells, concepts_before_results, pasted_figures, author_affiliations, cited_figures, label_runs, shown_before_said,
        new_words_by_turn, talk_lengths, clipped_texts, line_inches, content_stems, contractions, notation_sentences, cell_indents, slide_headings, pipe_tables, image_lines, reference_years, manuscript_syntax,
        front_matter_keys, span_lines, spec_violations, audit_of_specs, prose_of_markup, accented_names, expanded_macros, resolved_toggles, caption_texts, dropped_commands, formula_texts, tabular_cells,
        included_files, crossed_boxes, boxes_on_canvas, callout_rows, referenced_tables, backup_only_values, long_topic_hits, wide_tokens, table_heights, marked_cells, paper_colours, photographs, ink_runs, figure_room,
        omitted_values, font_families,
    )
}

_RUN = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_STOP = ", ".join(repr(w) for w in C.STOP)
_STEM = r"(CASE WHEN length({0}) > 3 AND {0} LIKE '%e' THEN substr({0}, 1, length({0}) - 1) ELSE {0} END)".format(r"regexp_replace(w, '^(.{3,}?)(?:ing|ed|es|s)$', '\1')")
_FIRST = "coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '')"


def _content(c: str) -> str:
    return rf"list_transform(list_filter(regexp_extract_all(lower({c}), '[A-Za-z][A-Za-z''\-]*'), lambda w: w NOT IN ({_STOP})), lambda w: {_STEM})"


def _pick_sql(number: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{number} % {len(values)} + 1]"


_RUNS = """(SELECT o_custkey AS deck, o_orderkey % 11 + 1 AS n, CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE o_custkey % 4 + 8 END AS m FROM orders)"""
_STRUCTURE = f"""(SELECT deck, m, n_runs, numbers FROM (SELECT deck, m, count(*) AS n_runs, list_sort(list(DISTINCT n)) AS numbers, row_number() OVER (PARTITION BY deck ORDER BY count(*) DESC, m) AS k FROM {_RUNS} WHERE n <= m GROUP BY deck, m) WHERE k = 1)"""
_SLIDES = "(SELECT p_size AS talk, p_partkey AS n, p_partkey % 4 = 0 AS standout, p_name || ' is' || CASE WHEN p_partkey % 3 > 0 THEN ' ' || lower(p_type) ELSE '' END AS text FROM part)"
_THESIS = f"(SELECT talk, max_by(text, n) AS thesis FROM {_SLIDES} WHERE standout GROUP BY talk)"
_TALK_CELLS = "(SELECT l_orderkey % 300 AS talk, l_linenumber AS n, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_quantity > l_linenumber * 6 END AS number, l_quantity FROM lineitem)"
_BOXES = """(SELECT s_suppkey % 10 AS page, s_suppkey AS box, (s_suppkey * 37 % 400)::DOUBLE AS x0, (s_suppkey * 53 % 300)::DOUBLE AS y0, (s_suppkey * 37 % 400)::DOUBLE + 20 + s_nationkey * 3 AS x1, (s_suppkey * 53 % 300)::DOUBLE + 15 + s_nationkey AS y1 FROM supplier)"""
_PIXELS = "(SELECT l_suppkey % 20 AS image, l_orderkey AS x, l_linenumber AS y, floor(l_quantity * l_linenumber / 3)::BIGINT AS colour FROM lineitem)"
_CELL = "repeat(' ', (p_partkey % 6)::INT) || CASE WHEN p_partkey % 7 = 0 THEN '…' WHEN p_partkey % 11 = 0 THEN '**...**' ELSE p_name END"
_SPEC = """(SELECT p_brand AS path, p_partkey, p_partkey % 5 AS k, p_name, p_type, p_size > 40 AS backup, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)"""


def sql() -> dict[str, str]:
    denote = " OR ".join(f"regexp_matches(s, '{p}')" for p in (r"^\s*(?:we\s+(?:denote|write|use)\b|let\b|here\b[^.]{0,20}\bdenotes?\b)",)).replace("'^", "'(?i)^")
    return {
        "top_warnings": "SELECT p_brand, p_partkey, k AS rank, greatest(n - 3, 0) AS n_more FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE k <= 3",
        "page_structure": f"SELECT deck, m AS denominator, n_runs, len(numbers)::BIGINT AS n_numbers, coalesce(array_to_string(list_filter(range(1, m + 1), lambda x: NOT list_contains(numbers, x)), ','), '') AS missing FROM {_STRUCTURE}",
        "accepted_denominators": f"SELECT s.deck, m AS denominator, n_slides FROM {_STRUCTURE} s JOIN (SELECT deck, count(*) AS n_slides FROM {_RUNS} GROUP BY deck) t USING (deck) WHERE n_runs * 2 >= greatest(1, n_slides - 2)",
        "ban_line_kinds": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'marked' WHEN 1 THEN 'bare' ELSE 'word' END AS kind, count(*) AS n FROM part WHERE p_partkey % 5 IN (0, 1, 3) GROUP BY 1",
        "density_against_baseline": """SELECT name, value, expected, CASE WHEN name = 'ECONOMY' THEN expected - value ELSE value - expected END > 0.15 AS flagged FROM (
SELECT p_type AS name, round(avg(p_size / 50.0::DOUBLE), 9) AS value, CASE WHEN p_type = 'ECONOMY' THEN 0.7 ELSE 0.3 END::DOUBLE AS expected FROM part GROUP BY p_type)""",
        "fit_feedback": """WITH o AS (SELECT p_partkey AS slide, p_size / 4.0::DOUBLE AS reserve, p_size / 2.0::DOUBLE AS last, p_partkey % 9 = 0 AS bound FROM part WHERE p_partkey % 3 < 2),
n AS (SELECT p_partkey AS slide, (p_partkey % 13 * 1.5)::DOUBLE AS over FROM part WHERE p_partkey % 4 < 3),
b AS (SELECT coalesce(o.slide, n.slide) AS slide, reserve, last, over, coalesce(bound, false) OR (last IS NOT NULL AND over IS NOT NULL AND last - over < reserve * 0.5) AS bound FROM o FULL JOIN n ON o.slide = n.slide)
SELECT slide, coalesce(reserve, 0) + CASE WHEN over IS NOT NULL AND NOT bound THEN over ELSE 0 END AS reserve, coalesce(over, last) AS last, bound FROM b""",
        "table_column_widths": """WITH w AS (SELECT p_brand AS tbl, 0 AS c, greatest(max(length(p_name)), 1)::DOUBLE AS w FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 1, greatest(max(length(p_type)), 1)::DOUBLE FROM part GROUP BY p_brand)
SELECT tbl, c, round(w * 72 / sum(w) OVER (PARTITION BY tbl), 6) AS width FROM w""",
        "small_text_warnings": """WITH r AS (SELECT DISTINCT p_brand AS figure, p_partkey % 2 + 7 AS floor, p_size::DOUBLE AS pt, p_name AS text FROM part WHERE p_size < 15 AND p_name NOT LIKE 'red%'),
k AS (SELECT *, row_number() OVER (PARTITION BY figure, floor ORDER BY pt, text) AS k FROM r)
SELECT figure, floor, count(*) AS n, min(pt) AS least_pt, string_agg(text, '|' ORDER BY pt, text) FILTER (WHERE k <= 3) AS sample FROM k GROUP BY figure, floor""",
        "sibling_sizes": "SELECT p_brand, greatest(floor(min(p_retailprice / 97.0::DOUBLE) * 2) / 2, 7.0) AS pt FROM part WHERE p_retailprice / 97.0::DOUBLE < 16 GROUP BY p_brand",
        "binding_sides": "SELECT p_brand AS figure, CASE WHEN count(*) FILTER (WHERE p_size % 2 = 0) * 2 >= count(*) THEN 'w' ELSE 'h' END AS side FROM part GROUP BY p_brand",
        "colour_keys_missing": """SELECT u.deck, u.colour, u.first FROM (SELECT l_orderkey % 200 AS deck, l_returnflag AS colour, min(l_linenumber) AS first, min(l_linenumber) FILTER (WHERE l_quantity > 48) AS told FROM lineitem GROUP BY ALL) u
WHERE told IS NULL OR told > first + 1""",
        "labels_never_drawn": """WITH l AS (SELECT deck, label, min(n) AS place FROM (SELECT l_orderkey % 400 AS deck, l_suppkey % 9 AS label, l_linenumber AS n FROM lineitem) GROUP BY deck, label HAVING count(DISTINCT n) >= 2),
d AS (SELECT deck, count(*) AS n_labels, min(place) AS first FROM l GROUP BY deck HAVING count(*) >= 3),
f AS (SELECT l_orderkey % 400 AS deck, min(l_linenumber) AS drawn FROM lineitem WHERE l_quantity > 47 AND l_linenumber > 2 GROUP BY 1)
SELECT deck, n_labels, first FROM d LEFT JOIN f USING (deck) WHERE drawn IS NULL OR drawn > first""",
        "standouts_off_thesis": f"SELECT s.talk, s.n FROM {_SLIDES} s JOIN {_THESIS} t USING (talk) WHERE standout AND NOT list_has_any({_content('text')}, {_content('thesis')})",
        "thesis_overlaps": f"SELECT talk, overlap, count(*) AS n_slides, min(n) AS first FROM (SELECT s.talk, s.n, len(list_intersect({_content('text')}, {_content('thesis')}))::BIGINT AS overlap FROM {_SLIDES} s JOIN {_THESIS} t USING (talk) WHERE NOT standout) GROUP BY talk, overlap",
        "focus_boxes": f"""WITH c AS (SELECT p_size, max_by(p_name, p_partkey) AS claim FROM part GROUP BY p_size),
s AS (SELECT p.p_size AS slide, p_partkey, p_name AS label, list_distinct({_content('p_name')}) AS w, {_content('claim')} AS k FROM part p JOIN c USING (p_size)),
r AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY len(list_intersect(w, k))::DOUBLE / greatest(len(w), 1) DESC, p_partkey) AS i FROM s)
SELECT slide, label FROM r WHERE i = 1 AND len(list_intersect(w, k)) * 2 >= len(w) AND len(w) > 0""",
        "named_grid_cells": f"""WITH c AS (SELECT n_nationkey % 2 AS grid, n_nationkey // 2 AS pos, {_RUN.format("n_name || ' ' || " + _pick_sql('n_nationkey', 'north', 'south', 'east', 'west', 'mid'))} AS w FROM nation),
p AS (SELECT grid, pos, w, r.row, k.col FROM c LEFT JOIN (SELECT r_regionkey, {_pick_sql('r_regionkey', 'north', 'south', 'east')} || ' row' AS row FROM region) r ON r.r_regionkey = pos // 4
LEFT JOIN (SELECT r_regionkey, {_pick_sql('r_regionkey', 'west', 'mid')} AS col FROM region WHERE r_regionkey < 4) k ON k.r_regionkey = pos % 4)
SELECT grid, pos, row, col AS "column" FROM p WHERE coalesce(len(list_filter({_RUN.format('row')}, lambda x: length(x) >= 3 AND list_contains(w, x))) > 0, false) OR coalesce(len(list_filter({_RUN.format('col')}, lambda x: length(x) >= 3 AND list_contains(w, x))) > 0, false)""",
        "concepts_before_results": f"""WITH t AS (SELECT talk, min(n) AS first_result FROM (SELECT talk, n, count(*) FILTER (WHERE number) AS k, count(number) AS a FROM {_TALK_CELLS} GROUP BY talk, n) WHERE k >= 4 AND k * 2 >= a GROUP BY talk),
s AS (SELECT talk, n, count(*) FILTER (WHERE l_quantity > 45) % 2 = 1 AS f FROM {_TALK_CELLS} GROUP BY talk, n)
SELECT talk, first_result, count(*) FILTER (WHERE f AND n < first_result) AS n_figures FROM s JOIN t USING (talk) GROUP BY talk, first_result""",
        "pasted_figures": """SELECT p_size AS talk, p_partkey AS n, 'figs/' || replace(p_name, ' ', '-') || '.png' AS file FROM part p WHERE p_partkey % 6 <> 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 5 = 0 AND q.p_size = p.p_size AND q.p_name = p.p_name)""",
        "author_affiliations": """WITH a AS (SELECT n_regionkey AS paper, s_suppkey AS pos, unnest([0, 1]) AS k, unnest([s_nationkey, (s_nationkey + 5) % 25]) AS mark FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT paper, n_name, min((pos, k)) AS place FROM a JOIN nation ON n_regionkey = paper AND n_nationkey = mark GROUP BY paper, n_name) SELECT paper, string_agg(n_name, '|' ORDER BY place) AS institutions FROM f GROUP BY paper""",
        "cited_figures": """WITH r AS (SELECT DISTINCT o_custkey % 40 AS doc, o_orderkey AS s, unnest(['fig' || (o_orderkey % 8), 'fig' || (o_custkey % 5)]) AS label FROM orders)
SELECT doc, label, count(*) AS n_sections, min(s) AS first FROM r WHERE label IN (SELECT 'fig' || n_nationkey FROM nation) GROUP BY doc, label""",
        "label_runs": """WITH m AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS start, count(*) AS n FROM m GROUP BY user_id, event_type, g""",
        "shown_before_said": f"""WITH w AS (SELECT conv_id, role, unnest({_RUN.format('text')}) AS word, turn FROM conversations),
f AS (SELECT conv_id, word, min(turn) FILTER (WHERE role = 'user') AS shown, min(turn) FILTER (WHERE role = 'assistant') AS said FROM w GROUP BY conv_id, word)
SELECT conv_id, count(*) AS n_words, count(said) AS n_late FROM f WHERE shown IS NOT NULL AND (said IS NULL OR said > shown) GROUP BY conv_id""",
        "new_words_by_turn": f"""WITH r AS (SELECT conv_id, turn, list_distinct({_RUN.format('text')}) AS said, {_RUN.format(_FIRST)} AS shown FROM conversations),
l AS (SELECT *, coalesce(lag(shown) OVER (PARTITION BY conv_id ORDER BY turn), []) AS before FROM r)
SELECT conv_id, turn, len(list_filter(said, lambda w: NOT list_contains(shown, w) AND NOT list_contains(before, w)))::BIGINT AS n_new FROM l""",
        "talk_lengths": f"""SELECT conv_id, round(sum(w) * 60.0::DOUBLE / {T.WORDS_PER_MINUTE} + sum(len(regexp_extract_all(text, '{T.CJK}'))) / {T.SYLLABLES_PER_SECOND}::DOUBLE + count(*) * 2, 6) AS seconds
FROM (SELECT conv_id, text, {spoken_sql("coalesce(text, '')")} AS w FROM conversations) GROUP BY conv_id""",
        "clipped_texts": r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 80) AS h FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, regexp_extract(h, '(?s)^(.*[.!?])(?:\s|$)', 1) AS s, regexp_extract(h, '(?s)^(.*)\s', 1) AS w FROM h)
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN s <> '' THEN s ELSE (CASE WHEN w <> '' THEN w ELSE h END) || '…' END AS clip FROM p""",
        "line_inches": f"SELECT doc_id, round(max(length(line) * 18 * {C.EM}::DOUBLE / 72.0), 6) AS inches FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
        "content_stems": f"SELECT stem, count(*) AS n FROM (SELECT unnest({_content('text')}) AS stem FROM benchmark) GROUP BY stem",
        "contractions": f"SELECT text, count(*) AS n FROM (SELECT {_pick_sql('p_partkey', 'can not ', 'will not ', 'does not ', 'it ', 'we ')} || p_name AS text FROM part) GROUP BY text",
        "notation_sentences": rf"""WITH s AS (SELECT p_size, {_pick_sql('p_partkey', 'We denote ', 'Let ', 'By abuse of notation ', 'Here x denotes ', 'We see ')} || {_pick_sql('p_size', 'x = y_1', 'the x of y', 'f(x) = { z }')} || ' by ' || p_name AS s FROM part),
t AS (SELECT *, string_split(s, ' ') AS t FROM s)
SELECT contains(s, 'abuse of notation') OR (({denote}) AND 5 * len(list_filter(t, lambda x: regexp_matches(x, '[_^|=\\{{}}()<>]|^[A-Za-z]$|^\W+$'))) >= 2 * len(t)) AS only, count(*) AS n, sum(p_size)::BIGINT AS total FROM t GROUP BY 1""",
        "cell_indents": f"""WITH c AS (SELECT (p_partkey % 6 + 1) // 2 AS level, ltrim({_CELL}) AS t FROM part) SELECT level, t IN ('…', '**...**') AS ditto, count(*) AS n, sum(length(t))::BIGINT AS n_chars FROM c GROUP BY ALL""",
        "slide_headings": "SELECT heading, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand || ' vs ' || p_size END AS heading FROM part) GROUP BY heading",
        "pipe_tables": """WITH r AS (SELECT n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_name, CASE WHEN n_nationkey % 7 = 0 THEN CASE WHEN n_nationkey % 5 = 0 THEN 'more' ELSE '' END ELSE n_nationkey::VARCHAR END AS second,
(1 + (n_nationkey % 7 <> 0)::INT + (n_nationkey % 5 = 0)::INT <> 2)::INT AS ragged FROM nation),
x AS (SELECT path, r, unnest([0, 1]) AS c, unnest([n_name, second]) AS cell FROM r UNION ALL SELECT DISTINCT path, 0, c, cell FROM r, (VALUES (0, 'name'), (1, 'key')) v(c, cell))
SELECT path, 1::BIGINT AS tbl, r, c, cell, (SELECT sum(ragged) FROM r WHERE r.path = x.path)::BIGINT AS n_ragged FROM x""",
        "image_lines": "SELECT n_regionkey AS path, 'maps/' || n_nationkey || '.png' AS file, 'Map of ' || n_name AS caption FROM nation",
        "reference_years": """SELECT n_regionkey AS path, row_number() OVER w - 1 AS no, (1990 + n_nationkey)::VARCHAR AS years, (length('[' || (n_nationkey + 1) || '] A. ' || n_name || ', Title, ' || (1990 + n_nationkey) || '.')
+ CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY n_regionkey) THEN 4 ELSE 0 END)::BIGINT AS n_chars FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
        "manuscript_syntax": f"SELECT CASE WHEN file = 'a.tex' THEN 'latex' WHEN file IN ('b.md', 'c.TXT') THEN 'plain' WHEN p_size % 2 = 0 THEN 'latex' ELSE 'plain' END AS syntax, file, count(*) AS n FROM (SELECT p_size, {_pick_sql('p_partkey', 'a.tex', 'b.md', 'c.TXT', 'd', 'e.doc')} AS file FROM part) GROUP BY ALL",
        "front_matter_keys": "SELECT 'title' AS key, count(*) AS n, count(DISTINCT p_name) AS n_values FROM part UNION ALL SELECT 'brand', count(*), count(DISTINCT p_brand) FROM part",
        "span_lines": """WITH s AS (SELECT p_size AS page, p_name, (p_partkey * 7 % 503)::DOUBLE AS x0, p_partkey // 150 AS y FROM part)
SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY y) AS line, string_agg(p_name, ' ' ORDER BY x0, p_name) AS text, min(x0) AS x0, y % 4 = 0 AS heading FROM s GROUP BY page, y""",
        "spec_violations": f"""WITH s AS {_SPEC} SELECT section, detail, count(*) AS n FROM (
SELECT 'unknown kind' AS section, 'poster' AS detail FROM s WHERE k = 1
UNION ALL SELECT 'ragged', p_type FROM s WHERE k = 3
UNION ALL SELECT 'syntax', 'not a slide list' FROM (SELECT DISTINCT path FROM s WHERE path LIKE '%1')) GROUP BY ALL""",
        "audit_of_specs": f"""WITH s AS {_SPEC}, k AS (SELECT *, CASE k WHEN 0 THEN 'standout' WHEN 1 THEN 'poster' WHEN 3 THEN 'table' WHEN 4 THEN 'columns' ELSE 'content' END AS kind,
CASE k WHEN 0 THEN length(p_name) + 1 + length(path) WHEN 1 THEN length(p_name) WHEN 2 THEN length(p_name) * 2 + length(p_type) + 8 WHEN 3 THEN 2 * length(p_name) + 2 * length(p_type) + 7 ELSE length(p_name) + 10 END AS n_screen FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY backup, n) AS place, NOT backup AND kind <> 'standout' AS numbered FROM k)
SELECT path, n, kind, backup, n_screen::BIGINT AS n_screen, (length(p_name) + 7)::BIGINT AS n_say, place, CASE WHEN numbered THEN sum(numbered::INT) OVER (PARTITION BY path ORDER BY place) END::BIGINT AS page FROM p""",
        "accented_names": r"SELECT text, count(*) AS n FROM (SELECT ['Ré', 'ça', 'ö', 'ß'][p_partkey % 4 + 1] || ' \cite{a} ' || p_name || ' \caption{v}' AS text FROM part) GROUP BY text",
        "expanded_macros": r"SELECT text, count(*) AS n FROM (SELECT 'See ' || p_name || ' and ' || p_type || ', not \whatever.' AS text FROM part) GROUP BY text",
        "resolved_toggles": r"SELECT p_partkey, ['\toggletrue{x}', '\togglefalse{x}', ''][p_partkey % 3 + 1] || CASE WHEN p_partkey % 2 = 0 THEN '\toggletrue{y}' ELSE '' END || 'a ' || CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN 'z' ELSE p_type END || ' b' AS text FROM part",
        "caption_texts": r"SELECT caption, count(*) AS n FROM (SELECT p_name || ' in {\bf braces} \}' AS caption FROM part UNION ALL SELECT p_type FROM part) GROUP BY caption",
        "dropped_commands": r"SELECT text, count(*) AS n FROM (SELECT 'a [b] \emph{' || p_type || '} ' || chr(10) || ' d  e' AS text FROM part) GROUP BY text",
        "formula_texts": "SELECT text, count(*) AS n FROM (SELECT 'α' || translate(p_size::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') || ' × x² ≤ ' || p_type || '/2' AS text FROM part) GROUP BY text",
        "tabular_cells": """WITH n AS (SELECT n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_name, n_nationkey FROM nation),
a AS (SELECT path, r, unnest([0, 1]) AS c, unnest([n_name, n_nationkey::VARCHAR]) AS cell FROM n)
SELECT * FROM a UNION ALL SELECT r_regionkey, 0, c, cell FROM region, (VALUES (0, 'Name'), (1, 'Key')) v(c, cell) UNION ALL SELECT path, max(r) + 1, c, 'all' FROM a GROUP BY path, c""",
        "included_files": """SELECT '/x/r' || r_regionkey || '.tex' AS path, r_name || ': ' || string_agg('[' || n_name || ' ', '' ORDER BY n_nationkey) || ']]]]] end' AS text FROM region, nation WHERE n_nationkey // 5 = r_regionkey GROUP BY r_regionkey, r_name""",
        "crossed_boxes": f"""WITH b AS {_BOXES}, p AS (SELECT p_partkey % 10 AS page, p_partkey AS path, (p_partkey * 11 % 400)::DOUBLE AS x0, (p_partkey * 29 % 300)::DOUBLE AS y0, (p_partkey * 71 % 400)::DOUBLE AS x1, (p_partkey * 13 % 300)::DOUBLE AS y1 FROM part),
k AS (SELECT page, path, x0 + (x1 - x0) * (k / 16.0::DOUBLE) AS x, y0 + (y1 - y0) * (k / 16.0::DOUBLE) AS y FROM (SELECT *, unnest(range(1, 16)) AS k FROM p))
SELECT k.page, path, box, count(*) AS n FROM k JOIN b ON k.page = b.page AND x > b.x0 AND x < b.x1 AND y > b.y0 AND y < b.y1 GROUP BY ALL""",
        "boxes_on_canvas": f"SELECT page, count(*) AS n_boxes, min(box) AS first FROM {_BOXES} WHERE x1 > 100 AND y1 > 60 AND x0 < 340 AND y0 < 240 GROUP BY page",
        "callout_rows": """SELECT n_regionkey AS chart, CASE n_nationkey % 3 WHEN 0 THEN (n_nationkey % 7)::VARCHAR WHEN 1 THEN n_name || ' ' ELSE 'none' END AS target,
CASE n_nationkey % 3 WHEN 0 THEN CASE WHEN n_nationkey % 7 <= 4 THEN n_nationkey % 7 END WHEN 1 THEN n_nationkey // 5 END::BIGINT AS pos FROM nation""",
        "referenced_tables": f"""WITH t AS (SELECT p_partkey // 2 AS slide, ['self', 'left', 'right'][p_size % 3 + 1] AS pane, min(p_partkey) AS tbl FROM part GROUP BY ALL),
r AS (SELECT DISTINCT p_partkey // 2 AS slide, {_pick_sql('p_partkey', 'self', 'left', 'right')} AS ref FROM part)
SELECT slide, ref, coalesce((SELECT tbl FROM t WHERE t.slide = r.slide AND pane = ref), CASE WHEN ref = 'self' THEN coalesce((SELECT tbl FROM t WHERE t.slide = r.slide AND pane = 'left'), (SELECT tbl FROM t WHERE t.slide = r.slide AND pane = 'right')) END) AS tbl FROM r""",
        "backup_only_values": """WITH s AS (SELECT p_brand, p_size AS v, bool_and(p_partkey % 4 < 3) AS held FROM part WHERE p_partkey % 5 > 0 GROUP BY ALL),
v AS (SELECT p_brand, p_partkey, unnest([p_size, p_size + 1]) AS v FROM part WHERE p_partkey % 5 = 0 AND p_size % 7 > 0)
SELECT p_brand, p_partkey FROM v LEFT JOIN s USING (p_brand, v) GROUP BY ALL HAVING bool_and(coalesce(held, false))""",
        "long_topic_hits": rf"""WITH w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]{{3,}}'))) AS w FROM documents), k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]{{3,}}'))) AS k FROM benchmark)
SELECT doc_id, count(*) AS n_hits FROM w WHERE w IN (SELECT w FROM (SELECT DISTINCT w FROM w) JOIN k ON w = k OR (length(w) >= 7 AND length(k) >= 7 AND (contains(w, k) OR contains(k, w)))) GROUP BY doc_id""",
        "wide_tokens": f"""WITH w AS (SELECT p_partkey AS box, unnest(string_split(p_name || ' ' || p_brand, ' ')) AS w, p_size % 20 + 8 AS pt, p_size / 40.0::DOUBLE AS inches FROM part), x AS (SELECT *, length(w) * pt::DOUBLE * {C.EM}::DOUBLE / 72.0::DOUBLE AS width FROM w)
SELECT box, count(*) AS n, max_by(w, (width, w)) AS widest FROM x WHERE width > inches GROUP BY box""",
        "table_heights": "SELECT tbl, sum(h)::BIGINT AS height FROM (SELECT l_orderkey AS tbl, l_linenumber, max(ceil(l_quantity / 10) * (l_suppkey % 3 + 10)) AS h FROM lineitem GROUP BY ALL) GROUP BY tbl",
        "marked_cells": """WITH r AS (SELECT p_brand AS tbl, p_partkey % 6 AS r, count(*) FILTER (WHERE p_partkey % 4 = 0) AS m, count(*) AS n, count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_size < 25) AS b FROM part GROUP BY ALL)
SELECT tbl, sum(m)::BIGINT AS n_marked, sum(n)::BIGINT AS n_cells, count(*) FILTER (WHERE b * 2 > n) AS n_blank_rows FROM r GROUP BY tbl""",
        "paper_colours": f"SELECT image, colour, n FROM (SELECT image, colour, count(*) AS n, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, colour) AS k FROM {_PIXELS} WHERE colour >= 6 GROUP BY image, colour) WHERE k = 1",
        "photographs": f"""WITH c AS (SELECT image, colour, count(*) AS n, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, colour) AS k FROM {_PIXELS} GROUP BY image, colour),
s AS (SELECT image, count(*) AS n_colours, sum(n) FILTER (WHERE k <= 32)::DOUBLE / sum(n) AS s FROM c GROUP BY image) SELECT image, n_colours, round(s, 9) AS top_share, s <= 0.45 AND n_colours >= 100 AS photo FROM s""",
        "ink_runs": f"""WITH r AS (SELECT image, x, max(colour) > 60 AS dark FROM {_PIXELS} GROUP BY image, x), s AS (SELECT *, dark AND NOT coalesce(lag(dark) OVER (PARTITION BY image ORDER BY x), false) AS starts FROM r)
SELECT image, round(count(*) FILTER (WHERE dark)::DOUBLE / count(*), 9) AS share, count(*) FILTER (WHERE starts) AS n_runs FROM s GROUP BY image""",
        "figure_room": "SELECT p_partkey, round(greatest(0, 4.5::DOUBLE - (p_size % 3 * 0.4::DOUBLE + p_size % 7 * 0.75::DOUBLE + (p_size > 30)::INT * 0.3::DOUBLE)), 6) AS inches FROM part",
        "omitted_values": f"""SELECT CASE p_partkey % 5 WHEN 0 THEN '14,562|0.99' WHEN 1 THEN '0.99|108,109' WHEN 2 THEN '1,234,567|8' WHEN 3 THEN 'a|b,c' ELSE '7' END
|| CASE WHEN p_size % 2 = 1 THEN '' WHEN p_partkey % 5 = 3 THEN '|,x' ELSE '|x' END AS parts, count(*) AS n FROM part GROUP BY 1""",
        "font_families": "SELECT CASE WHEN p_partkey % 3 = 2 THEN 'Abcdef+' ELSE '' END || ['Arial', 'TimesNewRoman', 'Calibri', 'Arial'][p_size % 4 + 1] AS family, count(*) AS n FROM part GROUP BY 1",
        "prose_of_markup": "SELECT p_name || ' ' || chr(10) || 'We see ' || p_type || ' and now .' AS prose, count(*) AS n FROM part GROUP BY ALL",
    }
