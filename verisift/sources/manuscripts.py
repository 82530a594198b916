"""Manuscripts as tables: whole texts by syntax, sections, figures, tables, references."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import markup as M
from .._staging import staged_loop

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MD_HEAD = r"^(#{1,6})[ \t]+(.+?)[ \t#]*$"
TEX_HEAD = r"^\\(section|subsection|subsubsection|paragraph)\*?\{(.+?)\}"
LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def sniff(path: Column, text: Column) -> Column:
    """latex or plain, by the ending first, then by the text."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(ending == "tex", "latex").when(ending.isin("md", "txt", "markdown"), "plain").when(F.contains(text, F.lit("\\begin{document}")), "latex").otherwise("plain")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, syntax) of whole files; LaTeX without comments, macros and toggles resolved, accents folded."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    raw = raw.withColumn("syntax", sniff(F.col("path"), F.col("text")))
    tex = M.fold_accents(M.expand_macros(M.resolve_toggles(M.strip_comments(F.col("text")))))
    return raw.withColumn("text", F.when(F.col("syntax") == "latex", tex).otherwise(F.col("text")))


def with_includes(files: DataFrame) -> DataFrame:
    """(path, text) with \\input and \\include replaced by the text of the named file, until none is left.

    Each round is one join on the names. An inserted text's own includes are written with the files they came through
    (name|file|file), so a file that includes itself, at once or through others, is left out there and only there.
    """
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.tex$", "")
    pattern = r"\\(?:input|include)\{[^}]*\}"
    bodies = files.select(name(F.col("path")).alias("b_name"), F.col("text").alias("body")).dropDuplicates(["b_name"])

    def step(df: DataFrame) -> DataFrame:
        parts = df.select("path", F.posexplode(F.split("text", f"(?={pattern})|(?<=\\}})")).alias("pos", "part"))
        inner = F.split(F.regexp_extract("part", r"^\\(?:input|include)\{([^}]*)\}", 1), r"\|")
        parts = parts.withColumn("name", name(inner[0])).withColumn("via", F.array_union(F.slice(inner, F.lit(2), F.size(inner)), F.array(name(F.col("path")))))
        got = parts.join(bodies, (F.col("name") == F.col("b_name")) & (F.col("name") != "") & ~F.array_contains("via", F.col("name")), "left")
        mark = F.concat(F.lit("\\\\input{$1|"), F.array_join("via", "|"), F.lit("|"), F.col("name"), F.lit("}"))
        inserted = F.regexp_replace(F.coalesce("body", F.lit("")), F.lit(r"\\(?:input|include)\{([^}]*)\}"), mark)
        rows = got.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("name") == "", F.col("part")).otherwise(inserted).alias("x")))).alias("p"))
        return rows.select("path", F.array_join(F.transform("p", lambda x: x["x"]), "").alias("text"))

    # a chain of includes without cycles is no longer than there are files
    return staged_loop(files.select("path", "text"), step, lambda df: df.where(F.col("text").rlike(pattern)).limit(1).count() == 0, files.count() + 1)


def sections(docs: DataFrame, key: str = "path", text: str = "text", syntax: str = "syntax") -> DataFrame:
    """(key, sec_no, level, title, start, body): heads with their lines up to the next; level 0 is what stands before."""
    lines = docs.select(key, syntax, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    md, tex = F.regexp_extract("line", MD_HEAD, 1), F.regexp_extract("line", TEX_HEAD, 1)
    is_md, is_tex = (F.col(syntax) != "latex") & (md != ""), (F.col(syntax) == "latex") & (tex != "")
    tex_level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), tex)
    level = F.when(is_md, F.length(md)).when(is_tex, tex_level)
    title = F.when(is_md, F.regexp_extract("line", MD_HEAD, 2)).when(is_tex, F.regexp_extract("line", TEX_HEAD, 2))
    over = W.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("level", level).withColumn("title", title).withColumn("sec_no", F.sum(F.col("level").isNotNull().cast("int")).over(over))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "sec_no").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.coalesce(F.max("title"), F.lit("")).alias("title"), F.min("pos").alias("start"), body.alias("body"))


def markdown_figures(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, file, caption) of Markdown images."""
    pattern = r"!\[([^\]]*)\]\(([^) ]+)[^)]*\)"
    rows = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))
    return rows.select(key, F.regexp_extract("m", pattern, 2).alias("file"), F.regexp_extract("m", pattern, 1).alias("caption"))


def markdown_tables(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, tbl, r, c, cell, n_ragged): cells of pipe tables, header row 0; rows are padded or cut to the header.

    Lines with bars that follow each other are one island; an island with a dash line second is a table.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where(F.col("line").rlike(r"^\|?.*\|"))
    over = W.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("g", F.col("pos") - F.row_number().over(over))
    rows = rows.withColumn("cells", F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x)))
    tables = rows.groupBy(key, "g").agg(F.min("pos").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda x: x["cells"]).alias("rows"))
    tables = tables.where(F.forall(F.coalesce(F.get("rows", F.lit(1)), F.array(F.lit(""))), lambda x: x.rlike("^:?-+:?$")))
    body = F.concat(F.slice("rows", 1, 1), F.slice("rows", F.lit(3), F.greatest(F.size("rows") - 2, F.lit(0))))
    tables = tables.withColumn("tbl", F.row_number().over(W.partitionBy(key).orderBy("at"))).withColumn("w", F.size(F.get("rows", F.lit(0)))).withColumn("body", body)
    tables = tables.withColumn("n_ragged", F.size(F.filter("body", lambda r: F.size(r) != F.col("w"))))
    cells = tables.select(key, "tbl", "n_ragged", "w", F.posexplode("body").alias("r", "cells")).withColumn("cells", F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("w"))), F.lit(1), F.col("w")))
    return cells.select(key, "tbl", "r", "n_ragged", F.posexplode("cells").alias("c", "cell")).select(key, "tbl", "r", "c", "cell", "n_ragged")


def column_spec(spec: str) -> list[str]:
    """A tabular's columns: repeats spelled out, decoration left out."""
    out, i = [], 0
    while i < len(spec):
        c = spec[i]
        if c == "*":
            args, i = M.arguments(spec, i + 1)
            out += column_spec(args[1]) * int(args[0]) if len(args) > 1 and args[0].strip().isdigit() else []
        elif c in "@!><":
            _, i = _one(spec, i + 1)
        elif c in "pmbDSX":
            out.append(c if c in "DSX" else "l")
            i += 1
            if i < len(spec) and spec[i] == "{":
                _, i = _one(spec, i)
        else:
            out += [c] if c in "lrc" else []
            i += 1
    return out


def _one(text: str, at: int) -> tuple[str, int]:
    if at < len(text) and text[at] == "{":
        end = M.closing(text, at)
        return text[at + 1 : end - 1], end
    return "", at


def tabular_cells(text: str) -> list[tuple[int, int, int, str]]:
    """(table, row, column, cell) of LaTeX tabulars; a cell over several columns stands in each of them."""
    out = []
    for t, m in enumerate(re.finditer(r"\\begin\{tabular[x*]?\}", text)):
        args, at = M.arguments(text, m.end())
        if not args:
            continue
        width, end = len(column_spec(args[-1])), text.find("\\end{tabular", at)
        body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cmidrule(?:\([^)]*\))?\{[^}]*\}|cline\{[^}]*\})", "", text[at : end if end >= 0 else len(text)])
        for r, line in enumerate(x for x in re.split(r"\\\\(?:\[[^\]]*\])?", body) if x.strip()):
            cells = []
            for cell in re.split(r"(?<!\\)&", line):
                spans = M.commands(cell, ["multicolumn"])
                if spans and len(spans[0][2]) >= 3 and spans[0][2][0].strip().isdigit():
                    cells += [M.math_text(M.without_commands(spans[0][2][2], ["textbf", "emph"], True))] * int(spans[0][2][0])
                else:
                    cells.append(M.math_text(M.without_commands(cell, ["textbf", "emph"], True)))
            cells = (cells + [""] * width)[: max(width, 1)]
            out += [(t, r, c, x) for c, x in enumerate(cells)]
    return out


def tex_tables(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, tbl, r, c, cell) of the tabulars in LaTeX texts."""

    @F.pandas_udf("array<struct<tbl:int,r:int,c:int,cell:string>>")
    def cells(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [dict(zip(("tbl", "r", "c", "cell"), t)) for t in tabular_cells(x or "")])

    rows = docs.where(F.contains(F.col(text), F.lit("\\begin{tabular")))
    return rows.select(key, F.explode(cells(F.col(text))).alias("t")).select(key, "t.*")


def references(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, no, entry, years): entries of a numbered reference list behind its heading, or of \\bibitem."""
    tail = F.regexp_extract(text, r"(?is)(?:^|\n)#*\s*(?:references|bibliography)\s*\n(.*)$", 1)
    numbered = F.filter(F.split(tail, r"\n?(?=\[[0-9]+\] )"), lambda x: x.rlike(r"^\[[0-9]+\] "))
    items = F.split(text, r"\\bibitem(?:\[[^\]]*\])?\{[^}]*\}")
    items = F.slice(items, F.lit(2), F.size(items))
    entry = F.when(F.contains(F.col(text), F.lit("\\bibitem")), items).otherwise(numbered)
    years = F.array_distinct(F.regexp_extract_all("entry", F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)))
    return docs.select(key, F.posexplode(entry).alias("no", "entry")).withColumn("entry", F.trim(F.regexp_replace("entry", r"\s+", " "))).withColumn("years", years)


def bibliography(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, no, authors, years): entries of .bib texts, and of \\bibitem lists, whose authors end at the first \\newblock."""
    bib = docs.where(F.col(text).rlike(r"(?:^|\n)[ \t]*@[A-Za-z]+\s*\{")).select(key, F.posexplode(M.bib_list(F.col(text))).alias("no", "e"))
    bib = bib.select(key, "no", F.col("e.authors").alias("authors"), F.when(F.col("e.year") != "", F.array("e.year")).otherwise(F.array().cast("array<string>")).alias("years"))
    bbl = references(docs.where(F.contains(F.col(text), F.lit("\\bibitem"))), key, text)
    return bib.unionByName(bbl.select(key, "no", F.split_part("entry", F.lit("\\newblock"), F.lit(1)).alias("authors"), "years"))


def wrong_years(texts: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, year, listed): "Name (year)" where the name's entries have other years only; names without an entry are
    no citations. Surnames are the blocking key of an equi-join."""
    cite = r"\b([A-Z][a-z][A-Za-z'\-]+)(?:\s+(?:and|&)\s+[A-Z][A-Za-z'\-]+|\s+et\s+al\.?)?,?\s*\(?((?:19|20)[0-9]{2})\)?(?![0-9])"
    cited = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(cite), F.lit(0)))).alias("m")).select(key, F.regexp_extract("m", cite, 1).alias("name"), F.regexp_extract("m", cite, 2).alias("year")).distinct()
    names = entries.select(F.explode(F.array_distinct(F.regexp_extract_all("authors", F.lit(r"[A-Za-z][A-Za-z'\-]+"), F.lit(0)))).alias("name"), "years")
    known = names.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))).alias("listed"))
    return cited.join(known, "name").where(~F.array_contains("listed", F.col("year"))).select(key, "name", "year", "listed")


def with_merged_headers(cells: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    """Tables (by, r, c, cell) whose first `n_head` rows (by, n_head) are one header: (by, r, c, cell), the header row 0.

    In header rows above the last a blank cell goes on with the one to its left (a span); a column's header is its cells
    from the top down, repeats once, joined by spaces. Columns that are blank throughout are left out, but for the first,
    and the others numbered anew from 0."""
    rows = cells.join(heads, by).withColumn("filled", F.when(F.trim("cell") != "", F.trim("cell")))
    left = W.partitionBy(*by, "r").orderBy("c").rowsBetween(W.unboundedPreceding, W.currentRow)
    spread = F.when((F.col("r") < F.col("n_head") - 1) & (F.col("c") > 0), F.last("filled", ignorenulls=True).over(left)).otherwise(F.col("filled"))
    rows = rows.withColumn("cell", F.coalesce(F.when(F.col("r") < F.col("n_head"), spread).otherwise(F.col("filled")), F.lit("")))
    used = rows.groupBy(*by, "c").agg(F.bool_or(F.col("filled").isNotNull()).alias("used")).where("used OR c = 0")
    used = used.select(*by, "c", (F.row_number().over(W.partitionBy(*by).orderBy("c")) - 1).alias("to"))
    rows = rows.join(used, [*by, "c"])
    head = rows.where("r < n_head").groupBy(*by, "to").agg(F.array_join(F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("r", "cell"))), lambda x: x["cell"]), lambda x: x != "")), " ").alias("cell"))
    body = rows.where("r >= n_head").select(*by, (F.col("r") - F.col("n_head") + 1).cast("int").alias("r"), F.col("to").alias("c"), "cell")
    return head.select(*by, F.lit(0).alias("r"), F.col("to").alias("c"), "cell").unionByName(body)


def front_matter(text: Column) -> Column:
    """The keys and values between the first two lines of dashes, as a map; lines that are no `key: value` are left out."""
    block = F.regexp_extract(text, r"^---\n((?:.|\n)*?)\n---(?:\n|$)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)))))


def pieces_to_lines(spans: DataFrame, page: str = "page", size: str = "size") -> DataFrame:
    """(page, line, text, x0, y0, size): spans of a page on one baseline, in reading order: gaps and islands."""
    over = W.partitionBy(page).orderBy("y0", "x0")
    new = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(over)) > F.col(size) * 0.5, F.lit(True))
    rows = spans.withColumn("n", new.cast("int")).withColumn("line", F.sum("n").over(over))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(page, "line").agg(parts.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(size).alias(size))
