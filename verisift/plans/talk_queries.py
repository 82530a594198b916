"""Queries on talks against what they show: labels on pictures, terms never said, values never touched, titles, headers, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cells as C, markup as M, text as T
from ..operators import claims as K, ink as N, provenance as P, selftest as X, similarity as S
from ..sources import manuscripts as I, pages as G
from ..sources.tables import table

GRID, STRETCH = (60, 40), 3  # width and height of the pictures, and a step that spreads parts over the height


def _pictures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pixels of twenty whole pictures, dark where line items fall, and marked boxes on them: parts."""
    w, h = GRID
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select((F.col("l_suppkey") % 20).alias("image"), (F.col("l_orderkey") * 7 % w).alias("x"), (F.col("l_partkey") * STRETCH % h).alias("y")).distinct().withColumn("dark", F.lit(True))
    grid = items.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long"))).alias("x")).select("image", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h - 1).cast("long"))).alias("y"))
    pixels = grid.join(items, ["image", "x", "y"], "left").withColumn("dark", F.coalesce("dark", F.lit(False)))
    k = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(
        (k % 20).alias("image"), k.alias("box"), (k * 7 % 50 / 60.0).alias("x"), (k * 11 % 97 / 100.0).alias("y"), ((F.col("p_size") % 9 + 1) / 60.0).alias("w"), (F.col("p_size") / 60.0).alias("h"),
        F.when(k % 13 == 0, F.lit("inside")).alias("label_at"))
    return pixels, boxes


def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, boxes = _pictures(spark, sf_dir)
    return N.place_labels(boxes, pixels, F.col("dark")).select("image", "box", "place", F.round("ink", 9).alias("ink"), "covers")


def ink_rectangles(spark, sf_dir):
    return N.ink_rectangles(_pictures(spark, sf_dir)[0], F.col("dark"))


def _talks(spark, sf_dir) -> DataFrame:
    """Talks: documents as slides of a source's talk, their capitals and numbers on screen; conversations' replies are said."""
    shown = table(spark, sf_dir, "documents").select(F.col("lang").alias("path"), F.col("doc_id").alias("n"), F.col("text").alias("screen"), F.lit("").alias("say"), (F.col("doc_id") % 7 == 0).alias("backup"))
    said = shown.select("path").distinct().join(F.broadcast(table(spark, sf_dir, "benchmark").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("say"))))
    return shown.unionByName(said.select("path", F.lit(-1).cast("long").alias("n"), F.lit("").alias("screen"), "say", F.lit(False).alias("backup")))


def unspoken_terms(spark, sf_dir):
    """Terms that documents of a language show and no benchmark passage says in any form, by the first document."""
    return K.unspoken(_talks(spark, sf_dir))


def untouched_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.untouched(docs.where("source = 'src1'"), docs.where("source <> 'src1'"))


def balanced_titles(spark, sf_dir):
    """Titles of pages on two and on three lines."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    rows = table(spark, sf_dir, "pages").select(title.alias("title")).distinct()
    return rows.select("title", *[F.array_join(M.balanced_lines(F.col("title"), n), "|").alias(f"on_{n}") for n in (2, 3)])


def wrong_citation_years(spark, sf_dir):
    """A bibliography of customers in .bib and \\bibitem form, cited by orders; a third of the years are off."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    word = F.concat(F.lit("Name"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))
    bib = F.concat(F.lit("@article{k"), n.cast("string"), F.lit(",\n  title = {The {Big} one, year = {1900}},\n  author = {"), word, F.lit(", A. and {O'Other}, B.},\n  year = "), F.when(n % 2 == 0, F.concat(F.lit('"'), (n % 50 + 1950).cast("string"), F.lit('"'))).otherwise((n % 50 + 1950).cast("string")), F.lit("\n}\n"))
    bbl = F.concat(F.lit("\\bibitem{k} "), word, F.lit(", A.\n\\newblock Title of "), (n % 50 + 1950).cast("string"), F.lit(".\n"))
    entries = I.bibliography(c.select(n.alias("path"), F.when(n % 3 == 0, bbl).otherwise(bib).alias("text")))
    o = F.col("o_custkey")
    name = F.concat(F.lit("Name"), F.translate(o.cast("string"), "0123456789", "abcdefghij"))
    cited = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("As "), name, F.when(F.col("o_orderkey") % 2 == 0, " et al. (").otherwise(" and Nobody ("), (o % 50 + 1950 + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(") says, unlike Else 1999.")).alias("text"))
    return I.wrong_years(cited, entries).select("doc_id", "name", "year", F.array_join("listed", "|").alias("listed"))


def merged_headers(spark, sf_dir):
    """Tables of two header rows: a nation's customers below the region, which stands over two of four columns; one is blank."""
    n = F.col("n_nationkey")
    rows = F.array(*[F.struct(F.lit(r).alias("r"), F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in cells]).alias("cells")) for r, cells in enumerate((
        (F.lit(""), F.col("n_name"), F.lit(None).cast("string"), F.lit("")), (F.lit("key"), F.lit("low"), F.lit(" high "), F.lit("")), (n, n + 1, F.when(n % 2 == 0, n + 2), F.lit(" ")), (n * 2, F.lit(""), n * 3, F.lit("")))) ])
    cells = table(spark, sf_dir, "nation").select(n.alias("tbl"), F.explode(rows).alias("x")).select("tbl", "x.r", F.posexplode("x.cells").alias("c", "cell"))
    heads = table(spark, sf_dir, "nation").select(n.alias("tbl"), F.lit(2).alias("n_head"))
    out = I.with_merged_headers(cells, heads, ["tbl"])
    return out.select("tbl", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "cell")


def reciprocals_apart(spark, sf_dir):
    """Quantities on screen whose reciprocal is said: line items as slides."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("string")
    screen = F.concat(q.cast("string"), F.lit(".5 and "), n, F.lit(".25"))
    say = F.concat(F.lit("0."), F.lpad(F.floor(1000 / (q + 0.5)).cast("string"), 3, "0"), F.lit(" or "), F.when(F.col("l_suppkey") % 2 == 0, n).otherwise("9"), F.lit(".25"))
    rows = K.reciprocals(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("n"), screen.alias("screen"), say.alias("say")))
    return rows.groupBy("path").agg(F.count("*").alias("n_pairs"), F.max("a").alias("largest"))


def counts_in_words(spark, sf_dir):
    """Parts as slides that promise three to eleven things and draw bullets, a grid, or items of a figure."""
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    word = F.element_at(F.array(*[F.lit(w) for w in ("three", "Seven", "eleven", "two", "five")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    noun = F.element_at(F.array(*[F.lit(w) for w in ("parts", "hours", "of them", "kinds")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    counts = F.when(n % 3 == 0, F.create_map(F.lit("bullets"), (n % 9).cast("int"))).when(n % 3 == 1, F.create_map(F.lit("grid rows"), (n % 4 + 1).cast("int"), F.lit("grid columns"), (n % 5 + 1).cast("int"))).otherwise(F.create_map(F.lit("items in the figure"), (n % 13).cast("int")))
    said = F.concat(F.lit("The "), word, F.lit(" "), noun)
    slides = p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("n"), F.when(n % 2 == 0, said).otherwise(F.col("p_name")).alias("head"), F.concat(said, F.lit("; "), F.col("p_name")).alias("screen"), counts.alias("counts"))
    return K.counts_off(slides).select("n", F.col("said").cast("long").alias("said"), F.col("drawn").cast("long").alias("drawn"), "what")


def figures_beyond(spark, sf_dir):
    """Orders as texts that name figures and tables by number; each status has so many of them."""
    o = F.col("o_orderkey")
    texts = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat(F.lit("See Fig. "), (o % 9).cast("string"), F.lit(", Figure"), (o % 4).cast("string"), F.lit(" and tables "), (o % 7).cast("string"), F.lit(" or tab 1234.")).alias("text"))
    limits = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg((F.max("o_orderkey") % 5 + 2).alias("figures"), (F.count("*") % 3).alias("tables"))
    return K.numbers_beyond(texts, limits, "o_orderstatus").select("o_orderstatus", "kind", F.col("number").cast("long").alias("number"), F.col("held").cast("long").alias("held"))


def conjunction_titles(spark, sf_dir):
    """Opening words of sentences of documents that would not do as titles."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(C.opens_with_conjunction(F.col("s"))).alias("n_conjunction"))


def page_lines(spark, sf_dir):
    """Forty orders a page in two columns of items, small ones raised or lowered, with full-width titles at the top and in the
    middle: lines in reading order."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    top = (o % 40 * 14).cast("double")
    small = F.when(F.col("l_quantity") > 45, -2.0).when(F.col("l_quantity") < 4, 8.0)
    x = (F.when(n % 2 == 0, 40).otherwise(340) + F.floor(n / 2) * 60).cast("double")
    spans = table(spark, sf_dir, "lineitem").select(
        F.floor(o / 40).alias("page"), x.alias("x0"), F.coalesce(top + 2 + small, top + 2).alias("y0"), (x + 55).alias("x1"), F.when(small.isNotNull(), top + 2 + small + 5).otherwise(top + 12).alias("y1"), F.when(small.isNotNull(), 6.0).otherwise(10.0).alias("size"),
        F.col("l_partkey").cast("string").alias("text"))
    k = F.col("o_orderkey")
    titles = table(spark, sf_dir, "orders").where(k % 20 == 0).select(F.floor(k / 40).alias("page"), F.lit(40.0).alias("x0"), (k % 40 * 14 - 6).cast("double").alias("y0"), F.lit(600.0).alias("x1"), (k % 40 * 14 + 1).cast("double").alias("y1"), F.lit(14.0).alias("size"), F.col("o_orderstatus").alias("text"))
    lines = G.read_lines(spans.unionByName(titles))
    return lines.select("page", F.col("no").cast("long").alias("no"), F.col("col").cast("long").alias("col"), "text", "size")


QUERIES = {f.__name__: f for f in (label_places, ink_rectangles, unspoken_terms, untouched_sentences, balanced_titles, wrong_citation_years, merged_headers, page_lines, reciprocals_apart, counts_in_words, figures_beyond, conjunction_titles)}


def sql() -> dict[str, str]:
    from .text_queries import _ALPHA, _SENT

    w, h = GRID
    pixels = f"d AS (SELECT DISTINCT l_suppkey % 20 AS image, l_orderkey * 7 % {w} AS x, l_partkey * {STRETCH} % {h} AS y FROM lineitem WHERE l_quantity > 48)"
    term = "[A-Za-z][A-Za-z0-9/+_-]*"
    jargon = r"""length(t) > 1 AND NOT regexp_full_match(t, '[IVX]{2,4}') AND NOT regexp_full_match(t, '(?i)x?[0-9]+(?:x[0-9]+)*x?') AND NOT regexp_full_match(t, '[A-Za-z][-+]?[0-9]{1,3}|[0-9]{1,3}[-+]?[A-Za-z]')
  AND lower(t) NOT IN (@STOP) AND (regexp_matches(t, '[0-9]') OR len(regexp_extract_all(t, '[A-Z]')) >= 2 OR (contains(t, '/') AND length(t) <= 6))"""
    jargon = jargon.replace("@STOP", ", ".join(repr(x) for x in (*C.STOP, *C.PLAIN_WORDS)))
    spelled = r"""SELECT replace(replace(regexp_extract(x, '^.(.*).$', 1), '-', ''), ' ', '') FROM (SELECT unnest(regexp_extract_all(' ' || regexp_replace(say, '([^A-Za-z])', '\1\1', 'g') || ' ', '[^A-Za-z][A-Za-z](?:[- ]{2}[A-Za-z]){1,7}[^A-Za-z]')) AS x FROM y)"""
    name = "'Name' || translate({}::VARCHAR, '0123456789', 'abcdefghij')"
    need = lambda n: f"""(SELECT array_to_string(list_transform(range(0, len(c) + 1), lambda i: array_to_string(w[(CASE WHEN i = 0 THEN 0 ELSE c[i] END) + 1 : (CASE WHEN i = len(c) THEN len(w) ELSE c[i + 1] END)], ' ')), '|')
  FROM (SELECT [] AS c UNION ALL SELECT [a] FROM (SELECT unnest(range(1, len(w))) AS a){"" if n == 2 else " UNION ALL SELECT [a, b] FROM (SELECT unnest(range(1, len(w))) AS a), (SELECT unnest(range(1, len(w))) AS b) WHERE a < b"})
  ORDER BY list_max(list_transform(range(0, len(c) + 1), lambda i: length(array_to_string(w[(CASE WHEN i = 0 THEN 0 ELSE c[i] END) + 1 : (CASE WHEN i = len(c) THEN len(w) ELSE c[i + 1] END)], ' ')))), list_transform(c, lambda x: -x) LIMIT 1)"""  # noqa: E731
    return {
        "section_canaries": _canary_sql(),
        "reciprocals_apart": """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_suppkey % 2 = 0 AS same FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, q + 0.5::DOUBLE AS a1, l_linenumber + 0.25::DOUBLE AS a2, floor(1000 / (q + 0.5::DOUBLE)) / 1000 AS b1, CASE WHEN same THEN l_linenumber ELSE 9 END + 0.25::DOUBLE AS b2 FROM l),
x AS (SELECT l_orderkey, l_linenumber, a FROM (SELECT *, unnest([a1, a2]) AS a FROM v) WHERE NOT list_contains([b1, b2], a)), y AS (SELECT l_orderkey, l_linenumber, b FROM (SELECT *, unnest([b1, b2]) AS b FROM v) WHERE NOT list_contains([a1, a2], b) AND b > 0 AND b <> floor(b)),
p AS (SELECT l_orderkey, a, b FROM x JOIN y USING (l_orderkey, l_linenumber) WHERE abs(a * b - 1) <= 0.03)
SELECT l_orderkey AS path, count(*) AS n_pairs, max(a) AS largest FROM p GROUP BY l_orderkey""",
        "counts_in_words": """WITH p AS (SELECT p_partkey AS n, p_size AS z, [3, 7, 11, 2, 5][p_partkey % 5 + 1] AS w, p_partkey % 4 IN (0, 3) AS fine FROM part),
d AS (SELECT n, w, unnest(CASE z % 3 WHEN 0 THEN ['bullets'] WHEN 1 THEN ['grid rows', 'grid columns'] ELSE ['items in the figure'] END) AS what, unnest(CASE z % 3 WHEN 0 THEN [z % 9] WHEN 1 THEN [z % 4 + 1, z % 5 + 1] ELSE [z % 13] END) AS drawn, z FROM p WHERE fine)
SELECT n, w::BIGINT AS said, drawn::BIGINT AS drawn, what FROM d WHERE w >= 3 AND abs(w - drawn) BETWEEN 1 AND 4 AND NOT (what = 'bullets' AND z % 2 = 1) AND NOT (what LIKE 'grid%' AND w IN (z % 4 + 1, z % 5 + 1, (z % 4 + 1) * (z % 5 + 1)))""",
        "figures_beyond": """WITH l AS (SELECT o_orderstatus, max(o_orderkey) % 5 + 2 AS f, count(*) % 3 AS t FROM orders GROUP BY 1), x AS (SELECT DISTINCT o_orderstatus, unnest(['figure', 'figure', 'table']) AS kind, unnest([o_orderkey % 9, o_orderkey % 4, o_orderkey % 7]) AS number FROM orders)
SELECT o_orderstatus, kind, number, CASE kind WHEN 'figure' THEN f ELSE t END AS held FROM x JOIN l USING (o_orderstatus) WHERE CASE kind WHEN 'figure' THEN f ELSE t END BETWEEN 1 AND number - 1""",
        "conjunction_titles": f"""WITH s AS (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE regexp_matches(s, '(?i)^(?:and|but|so|because)(?:[^A-Za-z0-9_]|$)') OR regexp_matches(s, '(?i)^which(?:[^A-Za-z0-9_]|$)') AND NOT rtrim(s) LIKE '%?') AS n_conjunction FROM s GROUP BY doc_id""",
        "page_lines": f"""WITH s AS (SELECT l_orderkey // 40 AS page, l_orderkey % 40 AS o, (CASE WHEN l_linenumber % 2 = 0 THEN 40 ELSE 340 END + l_linenumber // 2 * 60)::DOUBLE AS x0, l_linenumber % 2 = 1 AS rgt, l_partkey::VARCHAR AS text,
  CASE WHEN l_quantity > 45 THEN -2.0 WHEN l_quantity < 4 THEN 8.0 END AS small, l_orderkey % 40 * 14.0 AS top FROM lineitem),
t AS (SELECT page, CASE WHEN small IS NULL THEN 10.0 ELSE 6.0 END AS size, x0, top + 2 + coalesce(small, 0) AS y0, CASE WHEN small IS NULL THEN top + 12 ELSE top + 7 + small END AS y1, x0 + 55 AS x1, text FROM s
  UNION ALL SELECT o_orderkey // 40, 14.0, 40.0, o_orderkey % 40 * 14 - 6, o_orderkey % 40 * 14 + 1, 600.0, o_orderstatus FROM orders WHERE o_orderkey % 20 = 0),
f AS (SELECT *, x1 - x0 > (max(x1) OVER (PARTITION BY page) - min(x0) OVER (PARTITION BY page)) * {G.FULL} AS wide FROM t),
c AS (SELECT *, NOT wide AND x0 > (SELECT max(g.x1) FROM f AS g WHERE g.page = f.page AND NOT g.wide AND g.x0 < f.x0) + {G.GUTTER} AS edge FROM f),
d AS (SELECT *, CASE WHEN wide THEN -1 ELSE (SELECT count(DISTINCT e.x0) FROM c AS e WHERE e.page = c.page AND e.edge AND e.x0 <= c.x0) END AS col, coalesce((SELECT max(e.y0) FROM c AS e WHERE e.page = c.page AND e.wide AND e.y0 <= c.y0), '-infinity'::DOUBLE) AS band FROM c),
k AS (SELECT page, count(*) FILTER (WHERE n >= {G.LEAST}) AS n FROM (SELECT page, col, count(*) AS n FROM d WHERE col >= 0 GROUP BY ALL) GROUP BY page),
e AS (SELECT d.* EXCLUDE (col), CASE WHEN col >= 0 AND coalesce(k.n, 0) < 2 THEN 0 ELSE col END AS col FROM d LEFT JOIN k USING (page)),
g AS (SELECT *, coalesce((y0 > max(y1) OVER (PARTITION BY page, band, col ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.25 * size)::INT, 0) AS fresh FROM e),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY page, band, col ORDER BY y0, y1 RANGE UNBOUNDED PRECEDING) AS line FROM g),
m AS (SELECT *, max(size) OVER w AS most, first_value((y0 + y1) / 2) OVER (PARTITION BY page, band, col, line ORDER BY size DESC, x0) AS base FROM l WINDOW w AS (PARTITION BY page, band, col, line)),
p AS (SELECT page, band, col, line, max(size) AS size, string_agg(CASE WHEN size > most * {G.SMALL} THEN ' ' WHEN (y0 + y1) / 2 < base THEN '^' ELSE '_' END || text, '' ORDER BY x0, text, size, (y0 + y1) / 2) AS text FROM m GROUP BY ALL)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY band, col, line) - 1 AS no, col::BIGINT AS col, ltrim(text) AS text, size::DOUBLE AS size FROM p""",
        "label_places": f"""WITH {pixels}, b AS (SELECT p_partkey % 20 AS image, p_partkey AS box, p_partkey * 7 % 50 / 60.0::DOUBLE AS x, p_partkey * 11 % 97 / 100.0::DOUBLE AS y, (p_size % 9 + 1) / 60.0::DOUBLE AS w, p_size / 60.0::DOUBLE AS h, CASE WHEN p_partkey % 13 = 0 THEN 'inside' END AS label_at FROM part),
s AS (SELECT *, unnest(['above', 'below', 'inside']) AS place, unnest([greatest(0, y - {N.BAND}::DOUBLE), y + h, y]) AS t, unnest([y, least(1, y + h + {N.BAND}::DOUBLE), least(1, y + {N.BAND}::DOUBLE)]) AS u, unnest([y >= {N.ROOM_ABOVE}, y + h <= {N.ROOM_BELOW}, true]) AS room FROM b WHERE image IN (SELECT image FROM d)),
r AS (SELECT *, greatest(0, floor(x * {w}))::BIGINT AS x0, least({w}, floor((x + w) * {w} + 0.5))::BIGINT AS x1, greatest(0, floor(t * {h}))::BIGINT AS y0, least({h}, floor(u * {h} + 0.5))::BIGINT AS y1 FROM s WHERE room),
k AS (SELECT r.image, r.box, r.label_at, r.place, CASE WHEN any_value(x1) > any_value(x0) AND any_value(y1) > any_value(y0) THEN count(d.image)::DOUBLE / ((any_value(x1) - any_value(x0)) * (any_value(y1) - any_value(y0))) ELSE 0 END AS ink
  FROM r LEFT JOIN d ON d.image = r.image AND d.x >= x0 AND d.x < x1 AND d.y >= y0 AND d.y < y1 GROUP BY ALL),
c AS (SELECT image, box, label_at, list(place ORDER BY CASE WHEN ink <= {N.CLEAN} AND place = 'above' THEN -2.0 WHEN ink <= {N.CLEAN} AND place = 'below' THEN -1.0 ELSE ink END, place)[1] AS best, map(list(place), list(ink)) AS inks FROM k GROUP BY ALL)
SELECT image, box, coalesce(label_at, best) AS place, round(inks[coalesce(label_at, best)], 9) AS ink, label_at IS NULL AND inks[best] > {N.CLEAN} AS covers FROM c""",
        "ink_rectangles": f"WITH {pixels} SELECT image, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS n FROM d GROUP BY image",
        "unspoken_terms": f"""WITH y AS (SELECT string_agg(text, ' ' ORDER BY text) AS say FROM benchmark), ws AS (SELECT regexp_extract_all(say, '[A-Za-z]+') AS w FROM y),
k1 AS (SELECT lower(unnest(regexp_extract_all(say, '{term}'))) AS k FROM y UNION SELECT lower(x) FROM ({spelled}) AS s(x)
  UNION SELECT lower(array_to_string(list_transform(w[i : i + n - 1], lambda a: a[1]), '')) FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ws, (SELECT unnest(range(2, 7)) AS n))
  UNION SELECT lower(regexp_replace(x, '\\s+over\\s+', '/')) FROM (SELECT unnest(regexp_extract_all(say, '(?i)\\b[A-Za-z0-9]{{1,4}}\\s+over\\s+[A-Za-z0-9]{{1,4}}\\b')) AS x FROM y)
  UNION SELECT lower(regexp_replace(x, '\\s+sub\\s+', '_')) FROM (SELECT unnest(regexp_extract_all(say, '(?i)\\b[A-Za-z]{{1,4}}\\s+sub\\s+[A-Za-z0-9]{{1,4}}\\b')) AS x FROM y)),
k2 AS (SELECT k FROM k1 UNION SELECT unnest(regexp_split_to_array(k, '[-/_+]')) FROM k1), k3 AS (SELECT k FROM k2 UNION SELECT lower(unnest(regexp_extract_all(say, '[A-Za-z]+|[0-9]+'))) FROM y),
t AS (SELECT path, t, min(n) AS n FROM (SELECT lang AS path, doc_id AS n, unnest(regexp_extract_all(text, '{term}(?:[0-9][.][0-9][A-Za-z0-9/+_-]*)*')) AS t FROM documents WHERE doc_id % 7 <> 0) WHERE {jargon} GROUP BY ALL),
p AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '[-/_+]'), lambda x: x <> '') AS p, (SELECT list(k) FROM k3) AS all_k FROM (SELECT * FROM t WHERE lower(t) NOT IN (SELECT k FROM k2) AND lower(t) || 's' NOT IN (SELECT k FROM k2) AND NOT (lower(t) LIKE '%s' AND left(lower(t), -1) IN (SELECT k FROM k2))))
SELECT path, n, t AS term FROM p WHERE NOT (len(p) > 1 AND len(list_filter(p, lambda x: NOT list_contains(all_k, x))) = 0)""",
        "untouched_sentences": rf"""WITH s AS (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents WHERE source = 'src1'),
r AS (SELECT doc_id, list_distinct(regexp_extract_all(s, '(?:^|[^A-Za-z0-9_.])([0-9]{{1,4}}\.[0-9]+)', 1)) AS v, {_ALPHA.format('s')} AS w FROM s),
u AS (SELECT (SELECT list(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^0-9.])([0-9]{{1,4}}\.[0-9]+)', 1)) AS x FROM documents WHERE source <> 'src1')) AS uv, (SELECT list(DISTINCT x) FROM (SELECT unnest({_ALPHA.format('text')}) AS x FROM documents WHERE source <> 'src1')) AS uw)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE len(list_intersect(v, uv)) < len(v) AND len(list_intersect(w, uw)) * 100 < len(w) * 34) AS n_untouched FROM r, u WHERE len(v) > 0 AND len(w) > 0 GROUP BY doc_id""",
        "wrong_citation_years": f"""SELECT o_orderkey AS doc_id, {name.format('o_custkey')} AS name, (o_custkey % 50 + 1951)::VARCHAR AS year, (o_custkey % 50 + 1950)::VARCHAR AS listed FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)""",
        "balanced_titles": rf"""WITH t AS (SELECT DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), x AS (SELECT title, list_filter(regexp_split_to_array(title, '\s+'), lambda a: a <> '') AS w FROM t)
SELECT title, CASE WHEN len(w) = 0 THEN '' ELSE {need(2)} END AS on_2, CASE WHEN len(w) = 0 THEN '' ELSE {need(3)} END AS on_3 FROM x""",
        "merged_headers": """SELECT n_nationkey AS tbl, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2])::BIGINT AS r, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2])::BIGINT AS c,
unnest(['key', n_name || ' low', n_name || ' high', n_nationkey::VARCHAR, (n_nationkey + 1)::VARCHAR, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey + 2)::VARCHAR ELSE '' END, (n_nationkey * 2)::VARCHAR, '', (n_nationkey * 3)::VARCHAR]) AS cell FROM nation""",
    }


def section_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sections count in all documents before and after canaries are planted, written from the sections' own patterns."""
    return X.mutation_counts(table(spark, sf_dir, "documents"), _sections())


def _sections() -> dict:
    count = lambda p: lambda c: F.regexp_count(c, F.lit(p))
    patterns = {"banned": P.inflected("worthless"), "leaks": "</?(?:hit|safe|hi)>", "why": T.whole_word(T.WHY), "caveat": T.whole_word(T.CAVEAT), "upto": r"(?i)up to [0-9]+(?:\.[0-9]+)? ?(?:%|x|times|fold)"}
    return {n: (X.example(p), count(p)) for n, p in patterns.items()}


QUERIES["section_canaries"] = section_canaries


def _canary_sql() -> str:
    """The same patterns for an engine without look-around: signs that are no word stand twice, so edges do not overlap."""
    edge, word = "(?:^|[^A-Za-z0-9_])(?:{})(?:$|[^A-Za-z0-9_])", "worthless(?:e|es|s|ed|d|ing|en|n)?"
    lead = r"(?:(?:^|[^A-Za-z0-9_])(?:not|never)|n\x27\x27t)(?:  |\t\t|\n\n)"
    double = r"regexp_replace({}, '([^A-Za-z0-9_])', '\1\1', 'g')"
    n = lambda p, c: f"len(regexp_extract_all({c}, '(?i){p}'))"
    # sign by sign doubled: what is one space in a pattern is two, \s* and \s+ hold as they are
    spaced = lambda p: p.replace(" ", "  ")
    of = lambda c: {
        "banned": f"{n(edge.format(word), double.format(c))} - {n(lead + f'(?:{word})' + '(?:$|[^A-Za-z0-9_])', double.format(c))}", "leaks": n("</?(?:hit|safe|hi)>", c),
        "why": n(edge.format(spaced(T.WHY)), double.format(c)), "caveat": n(edge.format(spaced(T.CAVEAT)), double.format(c)), "upto": n(r"up to [0-9]+(?:\.[0-9]+)? ?(?:%|x|times|fold)", c)}
    names, canaries = sorted(of("t")), _sections()
    planted = "CASE m " + " ".join(f"WHEN {i} THEN '{canaries[x][0]}'" for i, x in enumerate(names)) + " END"
    parts = " UNION ALL ".join(f"SELECT '{x}' AS section, m, count(*) AS n_texts, sum({of('t')[x]})::BIGINT AS before, sum({of('u')[x]})::BIGINT AS after FROM d GROUP BY m" for x in names)
    return f"""WITH d AS (SELECT m, t, t || chr(10) || chr(10) || {planted} AS u FROM (SELECT doc_id % {len(names)} AS m, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL))
SELECT [{', '.join(repr(x) for x in names)}][m + 1] AS mutant, section, n_texts, before, after FROM ({parts})"""
