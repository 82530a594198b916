"""Queries on wording, titles, cells and nested grammar, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cells as C, markup as M, text as T
from ..operators import claims as K
from ..sources import specs
from ..sources.tables import table

def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def jargon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words an audience may not know, and in how many documents they are."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9][A-Za-z0-9/+-]*"), F.lit(0)))
    rows = _docs(spark, sf_dir).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    return rows.where(C.is_jargon(F.col("word")))


def title_claims(spark, sf_dir):
    """Titles of pages by whether they say something, ask something, or only name something."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    rows = table(spark, sf_dir, "pages").select(title.alias("title"))
    return rows.select(C.is_claim(F.col("title")).alias("claim"), C.is_question(F.col("title")).alias("question")).groupBy("claim", "question").agg(F.count(F.lit(1)).alias("n"))


def announced_counts(spark, sf_dir):
    return K.announced_counts(_docs(spark, sf_dir), "doc_id")


def caveats_lost(spark, sf_dir):
    return K.caveats_lost(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id")


def _written(spark, sf_dir, *cases: str) -> DataFrame:
    """(p_partkey, text): a text for each part by its key, with the part's name in it."""
    p = table(spark, sf_dir, "part")
    text = F.element_at(F.array(*[F.lit(c) for c in cases]), (F.col("p_partkey") % len(cases) + 1).cast("int"))
    return p.select("p_partkey", F.replace(text, F.lit("@"), F.col("p_name")).alias("text"))


def overclaims(spark, sf_dir):
    """Talks (parts) that say always where their papers say may; some papers say always too, some talks hedge themselves."""
    said = _written(spark, sf_dir, *["The @ harvester always adjusts irrigation channels."] * 3, "The @ harvester perhaps always adjusts irrigation channels.", "Nothing to say. The @ harvester always adjusts irrigation channels.", "The @ harvester does not always adjust irrigation channels.")
    paper = _written(spark, sf_dir, "Rain fell. The harvester may adjust irrigation channels slowly.", "The harvester may adjust irrigation channels. It always adjusts irrigation by the harvester.", "The harvester adjusts irrigation channels.", *["The harvester may adjust irrigation channels slowly."] * 3)
    return K.overclaims(K.sentence_rows(said, "p_partkey"), K.sentence_rows(paper, "p_partkey"), "p_partkey")


def dropped_modals(spark, sf_dir):
    """Talks (parts) that say flatly what their papers say may be; no modal: a date, a place, advice, a flat sentence beside."""
    said = _written(spark, sf_dir, "The @ harvester adjusts irrigation channels beside orchards.")
    paper = _written(
        spark, sf_dir, "The harvester may adjust irrigation channels beside orchards.", "In may 2018 the harvester adjusted irrigation channels beside orchards.", "The harvester appears in irrigation channels beside orchards.",
        "The harvester seems stable, it adjusts irrigation channels beside orchards.", "We suggest adjusting irrigation channels beside orchards with the harvester.", "The harvester may adjust irrigation channels beside orchards. The harvester adjusts irrigation channels beside orchards.",
        "Perhaps the harvester adjusts irrigation channels beside orchards.",
    )
    return K.dropped_modals(K.sentence_rows(said, "p_partkey"), K.sentence_rows(paper, "p_partkey"), "p_partkey")


def script_languages(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang", C.language(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def uncountable_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(C.uncountable(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def line_widths(spark, sf_dir):
    """Documents whose widest line is wider than ten inches at 18 points, in thousandths of an inch."""
    longest = F.array_max(F.transform(F.split("text", "\n"), F.length))
    width = F.floor(longest.cast("long") * 18 * 55 * 1000 / 7200).cast("long")
    return _docs(spark, sf_dir).select("doc_id", width.alias("mils")).where("mils > 10000")


def cell_kinds(spark, sf_dir):
    """Names written as cells with marks, read back by kind."""
    k = F.col("p_partkey") % 4
    cell = F.when(k == 0, F.concat(F.lit("<hit>"), "p_name", F.lit("</hit>"))).when(k == 1, F.concat(F.lit("**"), "p_name", F.lit("**"))).when(k == 2, F.concat(F.lit("x <safe>"), "p_name", F.lit("</safe>"))).otherwise(F.col("p_name"))
    kind = C.cell_kind(F.col("cell"))
    return table(spark, sf_dir, "part").select(cell.alias("cell")).select(F.coalesce(kind["kind"], F.lit("plain")).alias("kind"), F.length(kind["text"]).alias("n")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_chars"))


def group_rows(spark, sf_dir):
    """Rows of parts as cells of which all but the first may be blank, by brand."""
    cells = F.array(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_brand")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(C.is_group_row(cells)).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))


def cap_heights(spark, sf_dir):
    """The least cap height for viewing ratios given by sizes, and how many parts ask for it."""
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n_parts")).select("p_size", "n_parts", C.least_cap_percent(F.col("p_size").cast("double")).alias("percent"))


def snapped_columns(spark, sf_dir):
    """Distinct left edges of each size's parts before and after near ones are made one."""
    edge = ((F.col("p_partkey") * 37) % 400).cast("double")
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_set(edge)).alias("x"))  # equal edges snap alike
    return rows.select("p_size", F.size("x").cast("long").alias("n_before"), F.size(F.array_distinct(C.snapped(F.col("x"), 3.0))).cast("long").alias("n_after"))


def spelled_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(C.spoken_forms(F.col("text")))).alias("form"))


def number_words(spark, sf_dir):
    """Parts with their keys below a thousand spelled out, beside words that are no numbers, read back as digits."""
    n = (F.col("p_partkey") % 1000).cast("int")
    word = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at + 1).cast("int"))
    small = lambda x: F.when(x < 20, word(M.UNITS, x)).otherwise(F.concat(word(list(M.TENS), F.floor(x / 10) - 2), F.when(x % 10 > 0, F.concat(F.when(n % 2 == 0, "-").otherwise(" "), word(M.UNITS, x % 10))).otherwise("")))
    large = F.concat(word(M.UNITS, F.floor(n / 100)), F.lit(" Hundred"), F.when(n % 100 > 0, F.concat(F.when(n % 3 == 0, " and ").otherwise(" "), small(n % 100))).otherwise(""))
    spelled = F.when(n < 100, small(F.least(n, F.lit(99)))).otherwise(large)
    text = F.concat(spelled, F.lit(" percent of someone, "), "p_name", F.lit(" and one two"))
    return table(spark, sf_dir, "part").select("p_partkey", M.digits_for_words(text).alias("text"))


def wrapped_titles(spark, sf_dir):
    """How many lines page titles need at 40 characters."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    lines = table(spark, sf_dir, "pages").select(M.wrap_count(title, 40).alias("n_lines"))
    return lines.groupBy("n_lines").agg(F.count(F.lit(1)).alias("n_pages"))


def overfull_pages(spark, sf_dir):
    """Events of a user as a build log: views ship pages, errors overflow by their value."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "page").when(F.col("event_type") == "error", "over")
    log = events.select("user_id", F.col("event_id").alias("pos"), kind.alias("kind"), F.when(kind == "page", F.floor(F.col("event_id") / 100).cast("double")).otherwise(F.col("value")).alias("v"))
    return specs.overfull(log, "user_id", floor=6.0)


QUERIES = {f.__name__: f for f in (jargon_terms, title_claims, announced_counts, caveats_lost, overclaims, dropped_modals, script_languages, uncountable_lines, line_widths, cell_kinds, group_rows, cap_heights, snapped_columns, spelled_forms, number_words, wrapped_titles, overfull_pages)}


def sql() -> dict[str, str]:
    from .text_queries import _ALPHA, _SENT, whole

    stop = ", ".join(repr(w) for w in [*C.STOP, "n/a", "w/o", "w/", "i.e", "e.g"])
    topic = f"list_filter({_ALPHA.format('s')}, lambda w: length(w) > 4 AND NOT list_contains([{', '.join(repr(x) for x in T.TOPIC_STOP)}], w))"
    forms = ", ".join(repr(f) for f in C.verb_set())
    return {
        "jargon_terms": f"""SELECT word, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9/+-]*')) AS word FROM documents)
WHERE length(word) >= 2 AND lower(word) NOT IN ({stop}) AND NOT regexp_matches(word, '^[IVX]{{2,4}}$') AND NOT regexp_matches(word, '(?i)^x?[0-9]+(?:x[0-9]+)*x?$') AND NOT regexp_matches(word, '^(?:[A-Za-z][-+]?[0-9]{{1,3}}|[0-9]{{1,3}}[-+]?[A-Za-z])$')
AND ((regexp_matches(word, '[0-9]') AND regexp_matches(word, '[A-Za-z]')) OR len(regexp_extract_all(word, '[A-Z]')) >= 2 OR (contains(word, '/') AND length(word) <= 6)) GROUP BY word""",
        "title_claims": rf"""WITH t AS (SELECT title, regexp_extract_all(title, '[A-Za-z][A-Za-z''\-]*') AS w FROM (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)),
h AS (SELECT title, w, len(w) AS n, list_filter(w, lambda x: lower(x) IN ({forms})) AS a, list_filter(w[1 : len(w) - 1], lambda x: lower(x) IN ({forms})) AS b FROM t)
SELECT n > 0 AND ((n >= 3 AND regexp_matches(title, '(?:^|[^A-Za-z0-9_])(?:{C.PRONOUNS})\s+[A-Za-z]')) OR (n > 1 AND len(b) > 0) OR (len(a) > 0 AND (n >= 3 OR regexp_matches(title, '[.!]\s*$'))) OR (len(a) = 0 AND n >= 6)) AS claim, rtrim(title) LIKE '%?' AS question, count(*) AS n FROM h GROUP BY ALL""",
        "announced_counts": f"""SELECT doc_id, count(DISTINCT s) AS n FROM (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents) WHERE length(s) < 400 AND regexp_matches(s, '{whole(K.ANNOUNCE)}') GROUP BY doc_id""",
        "caveats_lost": f"""WITH s AS (SELECT doc_id, {topic} AS t FROM (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents) WHERE regexp_matches(s, '{whole(T.CAVEAT)}')),
k AS (SELECT list(DISTINCT x) AS k FROM (SELECT unnest({_ALPHA.format('text')}) AS x FROM benchmark)), r AS (SELECT doc_id, len(t) AS z, len(list_intersect(t, k)) AS n FROM s, k)
SELECT doc_id, count(*) AS n_caveats, count(*) FILTER (WHERE n > 0 AND n * 2 < z) AS n_lost FROM r GROUP BY doc_id""",
        "script_languages": """WITH c AS (SELECT lang, len(regexp_extract_all(text, '[가-힣]')) AS h, len(regexp_extract_all(text, '[A-Za-z가-힣]')) AS l FROM documents) SELECT lang, CASE WHEN h * 2 > l OR l = 0 THEN 'ko' ELSE 'en' END AS script, count(*) AS n FROM c GROUP BY ALL""",
        "uncountable_lines": r"""SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, '\s', '', 'g') <> '' AND NOT regexp_matches(line, '[A-Za-z0-9가-힣぀-ヿ一-鿿]') GROUP BY doc_id""",
        "line_widths": "SELECT doc_id, m AS mils FROM (SELECT doc_id, (list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) * 18 * 55 * 1000 // 7200)::BIGINT AS m FROM documents) WHERE m > 10000",
        "cell_kinds": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'b' WHEN 2 THEN 'safe' ELSE 'plain' END AS kind, count(*) AS n_cells, sum(length(p_name) + CASE WHEN p_partkey % 4 = 2 THEN 2 ELSE 0 END)::BIGINT AS n_chars FROM part GROUP BY 1",
        "group_rows": "SELECT p_brand, count(*) FILTER (WHERE trim(p_name) <> '' AND (p_size <= 25 OR trim(p_type) = '') AND (p_partkey % 3 = 0 OR trim(p_brand) = '')) AS n_groups, count(*) AS n_rows FROM part GROUP BY p_brand",
        "cap_heights": "SELECT p_size, count(*) AS n_parts, 100.0::DOUBLE * p_size / 200.0 AS percent FROM part GROUP BY p_size",
        "overclaims": """SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN 1 ELSE 0 END::BIGINT AS unit, CASE p_partkey % 6 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS no, 'always' AS strong, 'may' AS hedge FROM part WHERE p_partkey % 6 IN (0, 4)""",
        "dropped_modals": "SELECT p_partkey, 0::BIGINT AS unit, 0::BIGINT AS no FROM part WHERE p_partkey % 7 IN (0, 6)",
        "number_words": "SELECT p_partkey, (p_partkey % 1000) || '% of someone, ' || p_name || ' and 1 2' AS text FROM part",
        "wrapped_titles": """WITH RECURSIVE t AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+'), lambda w: w <> '') AS w FROM pages),
r AS (SELECT page_id, w, 0 AS i, 0 AS n, 0 AS used FROM t
UNION ALL SELECT page_id, w, i + 1, CASE WHEN used > 0 AND used + 1 + length(w[i + 1]) <= 40 THEN n ELSE n + greatest(1, (length(w[i + 1]) + 39) // 40) END,
CASE WHEN used > 0 AND used + 1 + length(w[i + 1]) <= 40 THEN used + 1 + length(w[i + 1]) WHEN length(w[i + 1]) <= 40 THEN length(w[i + 1]) WHEN length(w[i + 1]) % 40 = 0 THEN 40 ELSE length(w[i + 1]) % 40 END FROM r WHERE i < len(w))
SELECT n::INT AS n_lines, count(*) AS n_pages FROM r WHERE i = len(w) GROUP BY n""",
        "snapped_columns": """WITH RECURSIVE p AS (SELECT p_size, list_sort(list(((p_partkey * 37) % 400)::DOUBLE)) AS x FROM part GROUP BY p_size),
r AS (SELECT p_size, x, 0 AS i, []::DOUBLE[] AS k FROM p
UNION ALL SELECT p_size, x, i + 1, CASE WHEN len(list_filter(k, lambda w: abs(w - x[i + 1]) < 3)) > 0 THEN k ELSE list_append(k, x[i + 1]) END FROM r WHERE i < len(x))
SELECT p_size, len(list_distinct(x))::BIGINT AS n_before, len(k)::BIGINT AS n_after FROM r WHERE i = len(x)""",
        "spelled_forms": r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_])([A-Za-z0-9]{1,4}\s+over\s+[A-Za-z0-9]{1,4})(?:$|[^A-Za-z0-9_])', 1)) AS x FROM documents),
b AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_])([A-Za-z]{1,4}\s+sub\s+[A-Za-z0-9]{1,4})(?:$|[^A-Za-z0-9_])', 1)) AS x FROM documents),
c AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z])', '\1\1', 'g'), '(?:^|[^A-Za-z])([A-Za-z](?:(?:--|\s\s)[A-Za-z]){1,7})(?:$|[^A-Za-z])', 1)) AS x FROM documents)
SELECT DISTINCT doc_id, form FROM (SELECT doc_id, regexp_replace(x, '(?i)\s+over\s+', '/') AS form FROM a UNION ALL SELECT doc_id, regexp_replace(x, '(?i)\s+sub\s+', '_') FROM b UNION ALL SELECT doc_id, regexp_replace(x, '[-\s]', '', 'g') FROM c)""",
        "overfull_pages": """WITH e AS (SELECT user_id, event_id, event_type, value, max(CASE WHEN event_type = 'view' THEN event_id // 100 END) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, (coalesce(p, 0) + 1)::INT AS page, max(value) AS pt FROM e WHERE event_type = 'error' AND value > 6.0 GROUP BY ALL""",
    }
