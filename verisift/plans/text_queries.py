"""Queries on documents, benchmark passages and pages, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import profile, provenance as P, similarity as S
from ..sources.tables import table

SOURCE = "src1"
CLAIMS = [("share", "3.14"), ("gain", "12.5"), ("loss", "0.99"), ("year", "2019.5")]
BANNED = ["worthless", "pathetic", "utterly disgusting", "re:clowns?"]
LEAKS = {"strong": r"\*\*", "code": "###", "entity": "&(?:amp|quot|lt|gt);", "mark": "</?(?:hit|safe|hi)>"}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _split(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.where(F.col("source") == SOURCE), docs.where(F.col("source") != SOURCE)


def unsourced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, derived = _split(spark, sf_dir)
    return P.unsourced(derived, source).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unsourced"))


def unsourced_integers(spark, sf_dir):
    source, derived = _split(spark, sf_dir)
    return P.unsourced_integers(derived, source, skip=("2024",)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unsourced"))


def dropped_values(spark, sf_dir):
    source, derived = _split(spark, sf_dir)
    return P.dropped(source, derived)


def value_membership(spark, sf_dir):
    return P.membership(*_split(spark, sf_dir))


def two_sided_value_diff(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return P.membership(docs.where("lang = 'en'"), docs.where("lang <> 'en'")).where("side <> 'both'")


def claim_presence(spark, sf_dir):
    return P.claims(_docs(spark, sf_dir), CLAIMS)


def banned_words(spark, sf_dir):
    return P.banned(_docs(spark, sf_dir), BANNED)


def ngram_containment(spark, sf_dir):
    return P.containment(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=5)


def coined_terms(spark, sf_dir):
    return P.coined(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), floor=3)


def quote_containment(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return P.quotes(docs, table(spark, sf_dir, "benchmark"))


def fragment_arrival(spark, sf_dir):
    return P.arrived(table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir))


def page_match_jaccard(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return S.similar_sets(docs.select(T.alpha_words(T.first_line(F.col("text"))).alias("words")))


def sentence_flags(spark, sf_dir):
    """Sentences of each document by what they hold; counted in the row, so only numbers are grouped."""
    kinds = (("n_why", T.WHY), ("n_hedge", T.HEDGE), ("n_strong", T.STRONG), ("n_caveat", T.CAVEAT), ("n_negated", T.NEGATION))
    count = lambda s, p: F.size(F.filter(s, lambda x: x.rlike(T.whole_word(p)))).cast("long")
    flags = T.let(T.sentences(F.col("text")), lambda s: F.struct(F.size(s).cast("long").alias("n_sentences"), *[count(s, p).alias(n) for n, p in kinds]))
    rows = _docs(spark, sf_dir).select("doc_id", flags.alias("f"))
    return rows.groupBy("doc_id").agg(*[F.sum(f"f.{n}").alias(n) for n in ("n_sentences", *[n for n, _ in kinds])]).where("n_sentences > 0")


def up_to_dropped(spark, sf_dir):
    """Values with a unit that the source only states after "up to" and derived texts only without."""
    pattern = r"(?i)(up to )?([0-9]+(?:\.[0-9]+)?) ?(%|x|times|fold)"
    source, derived = _split(spark, sf_dir)

    def uses(df):
        rows = df.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
        return rows.select(F.regexp_extract("m", pattern, 2).alias("value"), F.lower("m").startswith("up to").alias("qualified"))

    s = uses(source).groupBy("value").agg(F.bool_and("qualified").alias("always"))
    d = uses(derived).groupBy("value").agg(F.bool_or("qualified").alias("ever"), F.count(F.lit(1)).alias("n_uses"))
    return d.where("NOT ever").join(s.where("always").select("value"), "value", "left_semi").select("value", "n_uses")


def uncovered_sentences(spark, sf_dir):
    return S.uncovered(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def markup_leaks(spark, sf_dir):
    return P.markup_leaks(table(spark, sf_dir, "pages"), "page_id", "html", LEAKS)


def contradicting_values(spark, sf_dir):
    """Labels of four letters or more before a number, with several values in several documents."""
    pattern = r"([A-Za-z]{4,}) ([0-9]{1,3}(?:\.[0-9]+)?)"
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
    rows = rows.select("doc_id", F.lower(F.regexp_extract("m", pattern, 1)).alias("label"), F.regexp_extract("m", pattern, 2).alias("value"))
    return profile.contradictions(rows, "label", "value", "doc_id")


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


def recurring_labels(spark, sf_dir):
    """The first word of a line with a bar, in two documents or more."""
    rows = _lines(spark, sf_dir).where(F.contains("line", F.lit(" | "))).select("doc_id", F.element_at(F.split("line", r" \| "), 1).alias("label"))
    return profile.recurring(rows, "label", "doc_id")


def boilerplate_lines(spark, sf_dir):
    """Lines, digits masked, on max(2, half) of a source's documents; sources of three documents or more."""
    rows = _lines(spark, sf_dir).select("doc_id", "source", T.masked_digits(F.trim(F.col("line"))).alias("line"))
    return profile.supported(rows, "source", "line", "doc_id", percent=5, least=3)


def density_profile(spark, sf_dir):
    docs = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    text = F.col("text")
    flags = {"n_question": text.rlike(r"\?"), "n_bars": F.contains(text, F.lit(" | ")), "n_digits": text.rlike("[0-9]"), "n_long": F.length(text) > 5000}
    totals = {"n_lines": F.size(F.split(text, "\n")).cast("long"), "n_chars": F.length(text).cast("long")}
    return profile.density(docs.select("quality", "text"), "quality", flags, totals)


def folded_vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    return words.select(T.folded(F.col("w")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n_forms"))


def named_terms(spark, sf_dir):
    """Words that documents introduce by "called", and whether a benchmark passage uses them."""
    rows = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?:^|[^a-z])(?:called|known as|denotes) ([a-z]{3,})"), F.lit(1))).alias("term"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.word_run(F.col("text"))).alias("term")).distinct()
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(known, "term", "left_anti")


def cited_years(spark, sf_dir):
    """(name, year) citations in documents with a year that no passage gives beside that name."""
    pattern = r"([A-Z][a-z]{2,}),? \(?((?:19|20)[0-9]{2})"
    cite = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m")).select(F.regexp_extract("m", pattern, 1).alias("name"), F.regexp_extract("m", pattern, 2).alias("year")).distinct()
    mine, known = cite(_docs(spark, sf_dir)), cite(table(spark, sf_dir, "benchmark"))
    return mine.join(known, ["name", "year"], "left_anti").withColumn("listed", F.lit(False)).join(known.select("name").distinct().withColumn("hit", F.lit(True)), "name", "left").select("name", "year", F.coalesce("hit", "listed").alias("known_name"))


def initialisms(spark, sf_dir):
    """Initials of two to six neighbouring words of a passage that some document has in capitals."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.transform(T.word_run(F.col("text")), lambda x: F.upper(F.substring(x, 1, 1))).alias("w"))
    initials = F.flatten(F.array(*[F.transform(T.shingles(F.col("w"), n), lambda g: F.replace(g, F.lit(" "), F.lit(""))) for n in range(2, 7)]))
    w = w.select("item_id", F.explode(F.array_distinct(initials)).alias("initials"))
    caps = _docs(spark, sf_dir).select(F.explode(T.found(F.col("text"), "(?<![A-Za-z0-9])([A-Z]{2,6})(?![A-Za-z0-9])")).alias("initials")).groupBy("initials").agg(F.count(F.lit(1)).alias("n_docs"))
    return w.groupBy("initials").agg(F.count(F.lit(1)).alias("n_items")).join(caps, "initials")


def length_bands(spark, sf_dir):
    """Documents whose text is too long for its clip: clipped at the last sentence end within 60 characters."""
    head = F.substring("text", 1, 60)
    return _docs(spark, sf_dir).select("doc_id", F.regexp_extract(head, r"^([^\n]*[.!?])(?:[ \n]|$)", 1).alias("clip"), (F.length("text") > 60).alias("clipped"))


def page_titles(spark, sf_dir):
    """Titles of pages: words, whether they look like a claim or a question, and how often they recur."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    rows = table(spark, sf_dir, "pages").select(title.alias("title"))
    rows = rows.groupBy("title").agg(F.count(F.lit(1)).alias("n_pages"))
    return rows.select("title", "n_pages", F.size(T.alpha_words(F.col("title"))).cast("long").alias("n_words"), F.col("title").endswith("?").alias("question"), F.col("title").rlike(T.whole_word(T.STRONG)).alias("strong"))


QUERIES = {f.__name__: f for f in (unsourced_values, unsourced_integers, dropped_values, value_membership, two_sided_value_diff, claim_presence, banned_words, ngram_containment, coined_terms, quote_containment, fragment_arrival, page_match_jaccard, sentence_flags, up_to_dropped, uncovered_sentences, markup_leaks, contradicting_values, recurring_labels, boilerplate_lines, density_profile, folded_vocabulary, named_terms, cited_years, initialisms, length_bands, page_titles)}

_D, _SD = r"(?:^|[^A-Za-z0-9_.])([0-9]{1,4}\.[0-9]+)", r"(?:^|[^0-9.])([0-9]{1,4}\.[0-9]+)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = f"regexp_extract_all({_LOW.format('text')}, '[a-z0-9]+')"


def _values(pattern: str, where: str) -> str:
    return f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS value FROM documents WHERE {where}"


def whole(alternatives: str) -> str:
    """Whether a text holds any of these as a whole word, for an engine without look-around."""
    return rf"(?i)(?:^|[^A-Za-z0-9_])(?:{alternatives})(?:$|[^A-Za-z0-9_])"


def _flat(c: str) -> str:
    """Signs between thousands are marked in two passes and then taken out; groups apart by spaces are marked, cut out and joined."""
    for _ in range(2):
        c = rf"regexp_replace({c}, '([0-9])(?:,|\x{{2009}}|\x{{202F}}|\\,)([0-9]{{3}})([^0-9]|$)', '\1' || chr(3) || '\2\3', 'g')"
    c = f"replace({c}, chr(3), '')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '(^|[^0-9.,\x01])([0-9]{{2,3}}(?: [0-9]{{3}})+)($|[^0-9.,])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g')"
    return f"array_to_string(list_transform(string_split({c}, chr(1)), lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, ' ', '') ELSE x END), '')"


def _claim(value: str) -> str:
    """Places between the pieces that a value cuts a text into where neither neighbour goes on with the number."""
    return f"""(SELECT sum(len(list_filter(range(1, len(p)), lambda i: NOT regexp_matches(CASE WHEN p[i] = '' AND i > 1 THEN '0' ELSE p[i] END, '[0-9.]$')
  AND NOT regexp_matches(CASE WHEN p[i + 1] = '' AND i + 1 < len(p) THEN '0' ELSE p[i + 1] END, '^[0-9]'))))::BIGINT FROM (SELECT string_split(text, '{value}') AS p FROM documents))"""


def _ban(line: str) -> str:
    """How often a text, or in d the text with all signs that are no word doubled, holds a banned phrase."""
    if line.startswith("re:"):
        return f"len(regexp_extract_all(text, '(?i){line[3:]}'))"
    words = P.inflected(line).split("(?<![A-Za-z0-9_])(?:")[-1].removesuffix(")(?![A-Za-z0-9_])")
    edge = "[^A-Za-z0-9_]"
    every = rf"len(regexp_extract_all(d, '(?i)(?:^|{edge})(?:{words})(?:$|{edge})'))"
    return every + rf" - len(regexp_extract_all(d, '(?i)(?:(?:^|{edge})(?:not|never)|n\x27\x27t)(?:  |\t\t|\n\n)(?:{words})(?:$|{edge})'))"


def _grams(k: int, source: str, key: str) -> str:
    return f"""SELECT {key}, pos, list_aggregate(w[pos + 1 : pos + {k}], 'string_agg', ' ') AS gram
  FROM (SELECT {key}, w, unnest(range(len(w) - {k - 1})) AS pos FROM (SELECT {key}, {_RUN} AS w FROM {source}) WHERE len(w) >= {k})"""


_SENT = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({{}}, '(?i)(^|[^A-Za-z0-9_])({T.ABBREVIATIONS})\.', '\1\2' || chr(1), 'g'), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(2), 'g'), chr(2)),
  lambda s: replace(trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g')), chr(1), '.')), lambda s: s <> '')"""
_ALPHA = r"list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z\-]{{3,}}'), lambda w: lower(w)))"
_SUFFIX = "regexp_replace({}, '^(.{{4,}}?)(?:" + "|".join(T.SUFFIXES) + r")$', '\1')"
_ENDING = "regexp_replace({}, '^(.{{3,}}?)(?:" + "|".join(T.ENDINGS) + r")$', '\1')"


def _folded(w: str) -> str:
    """The stem of a column, in a subquery-free chain."""
    a = f"regexp_replace(lower({w}), '[-/]', '', 'g')"
    a = f"(CASE {a} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in T.IRREGULAR.items())} ELSE {a} END)"
    b = f"CASE WHEN length({a}) > 4 AND {a} LIKE '%ies' THEN substr({a}, 1, length({a}) - 3) || 'y' ELSE {a} END"
    return b


_FOLD = f"""SELECT @KEY w, CASE WHEN length(f4) > 3 AND f4 LIKE '%e' THEN substr(f4, 1, length(f4) - 1) ELSE f4 END AS f FROM (
  SELECT *, {_ENDING.format('f3')} AS f4 FROM (SELECT *, {_SUFFIX.format('f2')} AS f3 FROM (
  SELECT *, CASE WHEN length(f1) > 6 AND (f1 LIKE '%ably' OR f1 LIKE '%ibly') THEN substr(f1, 1, length(f1) - 1) || 'e' ELSE f1 END AS f2 FROM (
  SELECT *, {_folded('w')} AS f1 FROM @SOURCE))))"""

_QUOTE = "trim(regexp_replace(lower(translate({}, '’‘', '''''')), '" + T.QUOTE_GAP.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"

SQL = {
    "unsourced_values": f"""WITH d AS ({_values(_D, f"source <> '{SOURCE}'")}), s AS ({_values(_SD, f"source = '{SOURCE}'")})
SELECT doc_id, count(*) AS n_unsourced FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.value = d.value) GROUP BY doc_id""",
    "unsourced_integers": f"""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_flat('text')}, '(?:^|[^A-Za-z0-9_.,])([0-9]{{2,}})', 1)) AS value FROM documents WHERE source <> '{SOURCE}'),
s AS (SELECT DISTINCT unnest(regexp_extract_all({_flat('text')}, '(?:^|[^0-9.])([0-9]{{2,}})', 1)) AS value FROM documents WHERE source = '{SOURCE}')
SELECT doc_id, count(*) AS n_unsourced FROM d WHERE value <> '2024' AND value NOT IN (SELECT value FROM s) GROUP BY doc_id""",
    "dropped_values": f"""SELECT DISTINCT value FROM ({_values(_D, f"source = '{SOURCE}'")}) WHERE value NOT IN (SELECT value FROM ({_values(_SD, f"source <> '{SOURCE}'")}))""",
    "value_membership": f"""SELECT coalesce(s.value, d.value) AS value, CASE WHEN d.value IS NULL THEN 'source only' WHEN s.value IS NULL THEN 'derived only' ELSE 'both' END AS side
FROM (SELECT DISTINCT value FROM ({_values(_D, f"source = '{SOURCE}'")})) s FULL JOIN (SELECT DISTINCT value FROM ({_values(_D, f"source <> '{SOURCE}'")})) d ON s.value = d.value""",
    "two_sided_value_diff": f"""SELECT * FROM (SELECT coalesce(s.value, d.value) AS value, CASE WHEN d.value IS NULL THEN 'source only' WHEN s.value IS NULL THEN 'derived only' ELSE 'both' END AS side
FROM (SELECT DISTINCT value FROM ({_values(_D, "lang = 'en'")})) s FULL JOIN (SELECT DISTINCT value FROM ({_values(_D, "lang <> 'en'")})) d ON s.value = d.value) WHERE side <> 'both'""",
    "claim_presence": " UNION ALL ".join(f"SELECT '{l}' AS label, '{v}' AS value, {_claim(v)} AS n_found, {_claim(v)} = 1 AS unique" for l, v in CLAIMS),
    "banned_words": " UNION ALL ".join(rf"SELECT doc_id, '{b}' AS pattern, n::BIGINT AS n FROM (SELECT doc_id, {_ban(b)} AS n FROM (SELECT doc_id, text, regexp_replace(text, '([^A-Za-z0-9_])', '\1\1', 'g') AS d FROM documents)) WHERE n > 0" for b in BANNED),
    "ngram_containment": f"""WITH a AS ({_grams(5, 'documents', 'doc_id')}), b AS ({_grams(5, 'benchmark', 'item_id')}),
h AS (SELECT doc_id, item_id, gram, b.pos AS p, a.pos - b.pos AS d FROM a JOIN b USING (gram)),
i AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY p) AS g FROM h),
r AS (SELECT doc_id, item_id, d, g, count(*) + 4 AS run FROM i GROUP BY ALL)
SELECT doc_id, item_id, (SELECT count(DISTINCT gram) FROM h WHERE h.doc_id = r.doc_id AND h.item_id = r.item_id) AS n_common, max(run) AS max_run FROM r GROUP BY doc_id, item_id""",
    "coined_terms": rf"""WITH m AS (SELECT word, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-/][A-Za-z0-9]+)*'))) AS word FROM documents)
  WHERE (length(word) >= 4 OR regexp_matches(word, '[-/0-9]')) AND word NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) GROUP BY word HAVING count(*) >= 3),
s AS (SELECT regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-/][A-Za-z0-9]+)*') AS a FROM benchmark),
k AS (SELECT DISTINCT w FROM (SELECT unnest(a) AS w FROM s UNION ALL SELECT a[i] || a[i + 1] FROM (SELECT a, unnest(range(1, len(a))) AS i FROM s)
  UNION ALL SELECT p FROM (SELECT unnest(regexp_split_to_array(w, '[-/]')) AS p FROM (SELECT unnest(a) AS w FROM s) WHERE regexp_matches(w, '[-/]')) WHERE length(p) >= 3)),
kf AS (SELECT DISTINCT f FROM ({_FOLD.replace('@KEY', '').replace('@SOURCE', 'k')})),
mf AS ({_FOLD.replace('@KEY', 'n,').replace('@SOURCE', '(SELECT word AS w, n FROM m)')})
SELECT w AS word, n FROM mf WHERE f NOT IN (SELECT f FROM kf)""",
    "quote_containment": f"""WITH q AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '“”', '""'), '"([^"]{{8,400}})"', 1)) AS q FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(q, '{T.CUT}'), lambda x: {_QUOTE.format('x')}), lambda x: contains(x, ' ')) AS p FROM q),
s AS (SELECT {_QUOTE.format('text')} AS s FROM benchmark),
l AS (SELECT * FROM p WHERE len(p) > 0 AND len(string_split(array_to_string(p, ' '), ' ')) >= 5)
SELECT doc_id, count(*) AS n_quotes, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s WHERE regexp_matches(s.s, array_to_string(p, '.*')))) AS n_missing FROM l GROUP BY doc_id""",
    "fragment_arrival": f"""WITH f AS (SELECT item_id, {_RUN} AS w, regexp_matches(text, '{P.MATH}') AS math FROM benchmark), o AS (SELECT row_number() OVER () AS o, {_RUN} AS w FROM documents),
t AS (SELECT o, w, ' ' || array_to_string(w, ' ') || ' ' AS t, array_to_string(w, '') AS flat FROM o), m AS (SELECT *, list_distinct(list_filter(w, lambda x: regexp_matches(x, '^[a-z]{{3,}}$'))) AS m FROM f)
SELECT m.item_id, count(DISTINCT t.o) AS n_arrived FROM m LEFT JOIN t ON len(m.w) = 0 OR contains(t.t, ' ' || array_to_string(m.w[1:6], ' ') || ' ') OR contains(t.flat, array_to_string(m.w[1:6], ''))
OR (m.math AND len(m.m) > 0 AND len(list_intersect(m.m, t.w)) = len(m.m)) GROUP BY m.item_id""",
    "page_match_jaccard": f"""WITH t AS (SELECT DISTINCT list_sort({_ALPHA.format("coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '')")}) AS s FROM documents),
u AS (SELECT s, list_aggregate(s, 'string_agg', ' ') AS id FROM t WHERE len(s) > 0)
SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS common, len(list_distinct(a.s || b.s)) AS united FROM u a JOIN u b ON a.id < b.id AND list_has_any(a.s, b.s)
WHERE len(list_intersect(a.s, b.s)) * 2 >= len(list_distinct(a.s || b.s))""",
    "sentence_flags": f"""WITH s AS (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, {', '.join(f"count(*) FILTER (WHERE regexp_matches(s, '{whole(p)}')) AS {n}" for n, p in (("n_why", T.WHY), ("n_hedge", T.HEDGE), ("n_strong", T.STRONG), ("n_caveat", T.CAVEAT), ("n_negated", T.NEGATION)))} FROM s GROUP BY doc_id""",
    "up_to_dropped": rf"""WITH u AS (SELECT source = '{SOURCE}' AS src, unnest(regexp_extract_all(text, '(?i)(up to )?([0-9]+(?:\.[0-9]+)?) ?(%|x|times|fold)')) AS m FROM documents),
v AS (SELECT src, regexp_extract(m, '(?i)(up to )?([0-9]+(?:\.[0-9]+)?) ?(%|x|times|fold)', 2) AS value, lower(m) LIKE 'up to%' AS q FROM u)
SELECT value, count(*) AS n_uses FROM v WHERE NOT src AND value IN (SELECT value FROM v WHERE src GROUP BY value HAVING bool_and(q)) GROUP BY value HAVING NOT bool_or(q)""",
    "uncovered_sentences": f"""WITH s AS (SELECT doc_id, {_ALPHA.format('s')} AS w FROM (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents) WHERE regexp_matches(s, '{whole(T.WHY)}')),
k AS (SELECT list(DISTINCT x) AS k FROM (SELECT unnest({_ALPHA.format('text')}) AS x FROM benchmark))
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE len(list_intersect(w, k)) * 100 < len(w) * 34) AS n_uncovered FROM s, k WHERE len(w) >= 5 GROUP BY doc_id""",
    "markup_leaks": " UNION ALL ".join(f"SELECT page_id, '{n}' AS pattern, len(regexp_extract_all(html, '{p}'))::BIGINT AS n FROM pages WHERE len(regexp_extract_all(html, '{p}')) > 0" for n, p in LEAKS.items()),
    "contradicting_values": r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]{4,}) ([0-9]{1,3}(?:\.[0-9]+)?)')) AS m FROM documents),
r AS (SELECT doc_id, lower(regexp_extract(m, '([A-Za-z]{4,}) ', 1)) AS label, regexp_extract(m, ' ([0-9.]+)$', 1) AS value FROM m)
SELECT label, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_places FROM r GROUP BY label HAVING count(DISTINCT value) > 1 AND count(DISTINCT doc_id) > 1""",
    "recurring_labels": """SELECT label, count(DISTINCT doc_id) AS n_places, min(doc_id) AS first_place FROM (SELECT doc_id, string_split(line, ' | ')[1] AS label FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, ' | '))
GROUP BY label HAVING count(DISTINCT doc_id) >= 2""",
    "boilerplate_lines": """WITH l AS (SELECT doc_id, source, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''),
a AS (SELECT source, count(DISTINCT doc_id) AS n_all FROM l GROUP BY source)
SELECT source, line, n_places FROM (SELECT source, line, count(DISTINCT doc_id) AS n_places FROM l GROUP BY ALL) JOIN a USING (source) WHERE n_places >= 3 AND n_places * 100 >= n_all * 5""",
    "density_profile": """SELECT quality, count(*) AS n_rows, count(*) FILTER (WHERE contains(text, '?')) AS n_question, count(*) FILTER (WHERE contains(text, ' | ')) AS n_bars, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS n_digits,
count(*) FILTER (WHERE length(text) > 5000) AS n_long, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, sum(length(text))::BIGINT AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY quality""",
    "folded_vocabulary": f"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) SELECT f AS stem, count(*) AS n_forms FROM ({_FOLD.replace('@KEY', '').replace('@SOURCE', 'k')}) GROUP BY f""",
    "named_terms": f"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])(?:called|known as|denotes) ([a-z]{{3,}})', 1)) AS term FROM documents) WHERE term NOT IN (SELECT unnest({_RUN}) FROM benchmark) GROUP BY term""",
    "cited_years": r"""WITH c AS (SELECT DISTINCT regexp_extract(m, '([A-Z][a-z]{2,})', 1) AS name, regexp_extract(m, '([0-9]{4})$', 1) AS year FROM (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]{2,}),? \(?((?:19|20)[0-9]{2})')) AS m FROM documents)),
k AS (SELECT DISTINCT regexp_extract(m, '([A-Z][a-z]{2,})', 1) AS name, regexp_extract(m, '([0-9]{4})$', 1) AS year FROM (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]{2,}),? \(?((?:19|20)[0-9]{2})')) AS m FROM benchmark))
SELECT name, year, name IN (SELECT name FROM k) AS known_name FROM c WHERE (name, year) NOT IN (SELECT (name, year) FROM k)""",
    "initialisms": f"""WITH w AS (SELECT item_id, {_RUN} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, upper(array_to_string(list_transform(w[i : i + n - 1], lambda x: x[1]), '')) AS initials FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest(range(2, 7)) AS n) WHERE len(w) >= n)),
c AS (SELECT initials, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}'))) AS initials FROM documents) GROUP BY initials)
SELECT g.initials, count(*) AS n_items, any_value(n_docs) AS n_docs FROM g JOIN c USING (initials) GROUP BY g.initials""",
    "length_bands": r"""SELECT doc_id, regexp_extract(substr(text, 1, 60), '^([^\n]*[.!?])(?:[ \n]|$)', 1) AS clip, length(text) > 60 AS clipped FROM documents""",
    "page_titles": f"""SELECT title, count(*) AS n_pages, len({_ALPHA.format('title')})::BIGINT AS n_words, title LIKE '%?' AS question, regexp_matches(title, '{whole(T.STRONG)}') AS strong FROM (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) GROUP BY title""",
}
