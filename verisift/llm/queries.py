"""The queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import bounded_batches, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), k=50)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests

    return digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import edited_pairs

    return edited_pairs(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_hot_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_hot_lines(docs, min_docs=10, min_chars=1, digest=True)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    return score(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_components

    return near_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import base_failed, judge, measures

    measured = staged(measures(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "measures")  # texts are read once
    verdict = judge(measured, _table(spark, sf_dir, "labels"))
    out = measured.withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"))


def quality_rules_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's method where few labels must do: a stratum's good holdout documents may be 20, and a fifth of them may go. Shows
    rules that reject on small tables too: documents by stratum, how many the base rules reject and how many the cutoffs."""
    from .rules import base_failed, judge, measures

    measured = staged(measures(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "measures")
    verdict = judge(measured, _table(spark, sf_dir, "labels"), risk=0.2, min_good=20)
    rows = measured.select("lang", base_failed().alias("base_failed"), verdict.alias("passes"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_base_failed"), F.count_if(~F.col("base_failed") & ~F.col("passes")).alias("n_by_rules"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tries import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives, whole_vectors

    return hard_negatives(whole_vectors(_table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_html_extraction, op3_substring_dedup, op4_sentencepiece, op5_fingerprints, op6_line_dedup, op7_lm_scoring, op8_ngram_jaccard, op9_quality_rules, op10_url_filters, op11_prefix_trie, op12_quality_classifier, op13_hard_negatives, quality_rules_wide)}

_WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_sql() -> str:
    """op10: rules, then the models order by order and the threshold."""
    from . import urls as m

    rules = sorted(m.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    case = lambda at: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, v)[at]}'" for h, p, v in rules) + " END"
    gram = " + ".join(f"p[i + {m.ORDER - j + 1}]::BIGINT * {m.BASE**j}" for j in range(m.ORDER + 1))
    parts = []
    for k in range(m.ORDER - 1, -1, -1):
        parts.append(f"n{k} AS (SELECT x % {m.BASE ** (k + 1)} AS x, sum(a) AS a, sum(r) AS r FROM n{k + 1} GROUP BY 1)")
    parts.append("e AS (SELECT (sum(a) + sum(r))::DOUBLE / (2 * sum(a)) AS e_a, (sum(a) + sum(r))::DOUBLE / (2 * sum(r)) AS e_r FROM n0)")
    for k in range(m.ORDER + 1):
        below = f"JOIN q{k - 1} AS b ON b.x = n.x % {m.BASE**k}" if k else f"JOIN (SELECT {1 / m.BASE!r}::DOUBLE AS a, {1 / m.BASE!r}::DOUBLE AS r) AS b ON true"
        parts.append(f"""q{k} AS (SELECT n.x, (n.a * e_a + b.a) / (c.a * e_a + 1.0::DOUBLE) AS a, (n.r * e_r + b.r) / (c.r * e_r + 1.0::DOUBLE) AS r
FROM n{k} AS n JOIN (SELECT x // {m.BASE} AS c, sum(a) AS a, sum(r) AS r FROM n{k} GROUP BY 1) AS c ON c.c = n.x // {m.BASE} {below}, e)""")
    return f"""
WITH s AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
  translate(coalesce(regexp_replace(url, '^[^:/?#]*://', ''), ''), '{_UPPER}', '{_LOWER}') AS plain, ('0x' || substr(md5(coalesce(url, '')), 1, 8))::BIGINT % 5 = 0 AS held FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
g AS (SELECT *, {case(0)} AS rule, {case(1)} AS given FROM h),
u AS (SELECT plain, list_append(list_transform(list_filter(string_split(plain, ''), lambda c: c <> ''), lambda c: instr('{m.SIGNS}', c)), {m.END}) AS codes,
  coalesce(sum((NOT held AND given = 'allow')::INT), 0) AS a, coalesce(sum((NOT held AND given = 'block')::INT), 0) AS r FROM g GROUP BY plain),
t AS (SELECT plain, a, r, len(codes) AS n, {gram} AS x FROM (SELECT plain, a, r, codes, p, unnest(range(0, len(codes))) AS i FROM (SELECT *, list_concat({[m.START] * m.ORDER}, codes) AS p FROM u))),
n{m.ORDER} AS (SELECT x, sum(a) AS a, sum(r) AS r FROM t GROUP BY x),
{", ".join(parts)},
z AS (SELECT t.plain, sum(round((ln(q.a) - ln(q.r)) * {m.UNIT!r}::DOUBLE)::BIGINT)::DOUBLE / {m.UNIT!r}::DOUBLE / any_value(n) AS score FROM t JOIN q{m.ORDER} AS q USING (x) GROUP BY t.plain),
j AS (SELECT g.*, score, floor((greatest(least(score, {m.SPAN}::DOUBLE), -{m.SPAN}::DOUBLE) + {m.SPAN}) / {2 * m.SPAN} * {m.BINS})::INT AS cell FROM g JOIN z USING (plain)),
c AS (SELECT cell, count(*) FILTER (WHERE given = 'allow') AS a, count(*) FILTER (WHERE given = 'block') AS r FROM j WHERE held AND given IS NOT NULL GROUP BY cell),
b AS (SELECT cell, (sum(a) OVER () - coalesce(sum(a) OVER w, 0))::DOUBLE / sum(a) OVER () + coalesce(sum(r) OVER w, 0)::DOUBLE / sum(r) OVER () AS quality FROM c WINDOW w AS (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT (SELECT cell FROM b ORDER BY quality DESC, cell LIMIT 1)::DOUBLE / {m.BINS} * 2 * {m.SPAN} - {m.SPAN} AS cut)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM j, k"""


def _rules_sql(risk: float = 0.02, error: float = 0.05, min_good: int = 250, gain: float = 5.0, steps: int = 6) -> str:
    """op9: measures, cutoffs by the tuning half, steps certified by the holdout with exact binomial sums."""
    from . import rules as m

    n, chars = "greatest(n_words, 1)", "greatest(word_chars, 1)"
    shares = [f"n_symbols::DOUBLE / {chars}", "n_dup_lines::DOUBLE / greatest(n_lines, 1)", f"n_repeat_words::DOUBLE / {n}", f"n_upper::DOUBLE / {chars}", f"n_bars::DOUBLE / {n}", f"word_chars::DOUBLE / {n} / 100", "1.0::DOUBLE / (n_words + 1)"]
    bins = ", ".join(f"least(floor({x} * {m.GRID}), {m.GRID})::INT" for x in shares)
    allowed = [0.0, *[risk / 2 ** (steps - 2 - j) for j in range(steps - 1)]]
    return rf"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS d, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT d, i, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT d, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
c AS (SELECT d, count(DISTINCT i + o) AS n FROM (SELECT d, i FROM g JOIN (SELECT d, g FROM g GROUP BY d, g HAVING count(*) > 1) USING (d, g)), (SELECT unnest(range(0, 5)) AS o) GROUP BY d),
l AS (SELECT d, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT d, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ 	-
]') GROUP BY d),
m AS (SELECT d.d, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[|]')) AS n_bars
  FROM d LEFT JOIN l USING (d) LEFT JOIN c USING (d)),
r AS (SELECT *, [{bins}] AS bins, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
a AS (SELECT r.d, lang, bins, good, ('0x' || substr(md5('h' || doc_id), 1, 8))::BIGINT % 2 = 0 AS holdout FROM r JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE lang IS NOT NULL),
s AS (SELECT lang, count(*) AS n FROM a WHERE holdout AND good = 1 GROUP BY lang HAVING count(*) >= {min_good}),
b AS (SELECT lang, good, unnest(range(1, {len(m.RULES) + 1})) AS rule, unnest(bins) AS bin FROM a JOIN s USING (lang) WHERE NOT holdout),
k AS (SELECT b.lang, b.rule, cut, count(*) FILTER (WHERE good = 0 AND bin > cut)::DOUBLE / greatest(count(*) FILTER (WHERE good = 0), 1) AS hit, count(*) FILTER (WHERE good = 1 AND bin > cut)::DOUBLE / greatest(count(*) FILTER (WHERE good = 1), 1) AS miss
  FROM b, (SELECT DISTINCT lang, rule, unnest([0, bin]) AS cut FROM b) AS x WHERE b.lang = x.lang AND b.rule = x.rule GROUP BY b.lang, b.rule, cut),
p AS (SELECT lang, rule, j, min(least({m.GRID}, coalesce(cut, {m.GRID}))) OVER (PARTITION BY lang, rule ORDER BY j) AS cut FROM (
  SELECT q.lang, q.rule, q.j, min(k.cut) AS cut FROM (SELECT DISTINCT lang, rule, unnest(range(0, {steps})) AS j, unnest({allowed}) AS rate FROM b) AS q
  LEFT JOIN k ON k.lang = q.lang AND k.rule = q.rule AND hit >= 0.005 AND hit >= {gain} * miss AND miss <= rate GROUP BY ALL)),
f AS (SELECT p.lang, p.j, count(DISTINCT a.d) FILTER (WHERE a.bins[p.rule] > p.cut) AS lost FROM p JOIN a ON a.lang = p.lang AND a.holdout AND a.good = 1 GROUP BY p.lang, p.j),
v AS (SELECT f.lang, j, (SELECT sum(exp(lgamma(s.n + 1) - lgamma(i + 1) - lgamma(s.n - i + 1) + i * ln({risk}) + (s.n - i) * ln(1 - {risk}))) FROM (SELECT unnest(range(0, lost + 1)) AS i)) <= {error} / (SELECT count(*) FROM s) AS ok FROM f JOIN s USING (lang)),
y AS (SELECT lang, max(j) AS j FROM (SELECT lang, j, bool_and(ok) OVER (PARTITION BY lang ORDER BY j) AS ok FROM v) WHERE ok GROUP BY lang),
z AS (SELECT p.lang, list(cut ORDER BY rule) AS cuts FROM p JOIN y USING (lang, j) GROUP BY p.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (z.cuts IS NULL OR {" AND ".join(f"bins[{i}] <= z.cuts[{i}]" for i in range(1, len(m.RULES) + 1))}) AS kept FROM r LEFT JOIN z USING (lang)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)), lambda acc, b: {byte}), 4294967295)"


_TRIE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': length(r) || ':' || r || length(x) || ':' || x, 'n': length(x)}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS s FROM t GROUP BY conv_id),
h AS (SELECT conv_id, s, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(o.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, md5(array_to_string(list_transform(s[1:d], lambda x: x.k), '')) AS k, md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.k), '')) AS up, coalesce(s[d].n, 0) AS n, d = len(s) AS ends
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c)),
n AS (SELECT d, k, min(up) AS up, min(conv_id) AS owner, count(*) AS n_convs, min(n) * (count(*) - 1) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS e FROM p GROUP BY d, k),
b AS (SELECT n.*, u.owner AS parent, (SELECT count(*) FROM n AS m WHERE m.d = n.d + 1 AND m.up = n.k) AS n_children FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.k = n.up),
a AS (SELECT p.d, p.k, sum((b.n_children = 0)::INT) AS n_leaves, sum(b.saved) AS saved FROM b JOIN p ON p.conv_id = b.owner AND p.d <= b.d GROUP BY p.d, p.k)
SELECT owner AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, e AS ends_sha256 FROM b JOIN a USING (d, k)"""


_NEGATIVES_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e AS a JOIN e ON a.r <> e.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) AS p FROM s WHERE same QUALIFY p <= 5),
n AS (SELECT p.r, p.p, p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.p ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


SQL = {
    "quality_rules_wide": f"""SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE base_failed) AS n_base_failed, count(*) FILTER (WHERE NOT base_failed AND NOT kept) AS n_by_rules
FROM ({_rules_sql(risk=0.2, min_good=20).replace("SELECT doc_id, n_words, word_chars", "SELECT lang, doc_id, n_words, word_chars")}) GROUP BY lang""",
    "op11_prefix_trie": _TRIE_SQL,
    "op13_hard_negatives": _NEGATIVES_SQL,
    "op1_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT AS weight FROM s),
r AS (SELECT *, (3 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total::DOUBLE - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT (SELECT arg_min(level, ratio) FROM (SELECT level, ratio FROM l WHERE level < ratio ORDER BY ratio LIMIT 1)) AS free),
t AS (SELECT source, source_size, CASE WHEN level >= ratio THEN (3 * source_size)::DOUBLE ELSE free * weight END AS target FROM l, f),
c AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS copies FROM t),
b AS (SELECT *, target - copies * source_size AS left_over FROM c),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
u AS (SELECT g.source, g.h, g.words, sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS upto FROM g),
k AS (SELECT u.source, u.h, CASE WHEN u.upto <= b.left_over THEN b.left_over > 0
             WHEN u.upto - u.words < b.left_over THEN 2 * (b.left_over - u.upto + u.words) >= u.words ELSE false END AS more
      FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.copies + k.more::INT))::BIGINT AS taken, (b.copies + k.more::INT)::INT AS copies
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
h AS (SELECT r, i FROM g JOIN f USING (g) WHERE least < doc_id),
p AS (SELECT r, doc_id, j, w[j] AS word FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
c AS (SELECT p.*, coalesce(max(h.i) OVER (PARTITION BY p.r ORDER BY p.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM p LEFT JOIN h ON h.r = p.r AND h.i = p.j),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r""",
    "op8_ngram_jaccard": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                             WHEN len(w) > 0 THEN [md5('all ' || array_to_string(w, ' '))] ELSE []::VARCHAR[] END AS s FROM d),
k AS (SELECT r, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '')) AS c FROM s),
x AS (SELECT c, any_value(n) AS n, any_value(r) AS r FROM k WHERE n > 0 GROUP BY c),
t AS (SELECT x.c, x.n, unnest(s.s) AS t FROM x JOIN s USING (r)),
l AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c <> b.c AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.c, b.c
      HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
z(a, b) AS (SELECT c, c FROM x UNION SELECT z.a, l.b FROM z JOIN l ON z.b = l.a),
m AS (SELECT z.a AS c, min(k.doc_id) AS component_id FROM z JOIN k ON k.c = z.b AND k.n > 0 GROUP BY z.a)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, CASE WHEN k.n > 0 THEN m.component_id ELSE k.doc_id END AS component_id FROM k LEFT JOIN m ON k.c = m.c""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT d.doc_id, d.rowid AS r, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_number() OVER () AS rowid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       LATERAL (SELECT unnest(d.lines) AS line, generate_subscripts(d.lines, 1) AS i)),
hot AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.key = hot.key GROUP BY doc_id, r""",
    "op9_quality_rules": _rules_sql(),
    "op10_url_filters": _url_sql(),
}
