"""Claims stated more strongly than their source, caveats and counts that got lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cells as C, markup as M, text as T

# ---- fixed values --------------------------------------------------------------------------------
# lower case but for the first four; "may 2018" is a date, "suggest choosing" advice, "appears in Table 2" a place
MODAL = (
    r"(?:^|[\s(])(?:[Cc]ould|[Mm]ay(?!\s+[0-9])|[Mm]ight|[Pp]ossibly|[Pp]erhaps|potentially|likely|suggest(?:s|ed)?(?!\s+[A-Za-z]+ing\b)|plan(?:s|ned)?\s+to|intends?\s+to|"
    r"hopes?\s+to|exhibits?\s+(?:the\s+)?traits|(?:appears?|seems?)\s+(?!(?:in|on|at|as|when|where|while|if|below|above|last|first|only|once|twice|after|before|here|there|"
    r"again|with|alongside|throughout|under|between|near|next|both|together|and|or|for|from|of)\b)[a-z]+)\b"
)
TERM = r"[A-Za-z][A-Za-z0-9/+_-]*(?:(?<=[0-9])\.[0-9][A-Za-z0-9/+_-]*)*"
CLAUSE = r"[,;:()]|\s(?:and|but|while|whereas|which|who|that)\s"
ANNOUNCE = r"(?:two|three|four|five|several|[0-9]) (?:[A-Za-z]+ )?(?:reasons|causes|mechanisms|explanations|limits|limitations|factors|effects|things|ways|lessons)"
# --------------------------------------------------------------------------------------------------


def sentence_rows(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, no, s, w, t): sentences in order, their words and topic words, plurals folded."""
    rows = texts.select(group, F.posexplode(T.sentences(F.col(text))).alias("no", "s")).withColumn("no", F.col("no").cast("long"))
    fold = lambda ws: F.array_distinct(F.transform(ws, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))
    rows = rows.withColumn("a", T.alpha_words(F.col("s")))
    return rows.select(group, "no", "s", fold(F.col("a")).alias("w"), fold(T.topic_words(F.col("a"))).alias("t"))


def _pairs(units: DataFrame, paper: DataFrame, group: str, least: int, percent: int) -> DataFrame:
    """Units with the source sentences of their group that share enough topic words: (.., unit, u, z, no, s, shared).

    Candidates share one of a unit's first words in alphabetical order, as many as any match must leave in common.
    """
    need = F.greatest(F.lit(least), F.ceil(F.size("t") * percent / 100).cast("int"))
    u = units.select(group, F.col("no").alias("unit"), F.col("s").alias("u"), F.array_sort("t").alias("t")).where(F.size("t") >= least)
    u = u.withColumn("x", F.explode(F.slice("t", F.lit(1), F.greatest(F.size("t") - need + 1, F.lit(1)))))
    p = paper.select(group, "no", "s", "w").withColumn("x", F.explode("w"))
    # sorted on both sides: exploded rows are far more than a table's size tells, so neither is broadcast; a pair counts where it shares its first word
    hits = u.join(p.hint("merge"), [group, "x"]).withColumn("_both", F.array_intersect("t", "w")).where(F.col("x") == F.get("_both", F.lit(0)))
    hits = hits.withColumn("shared", F.size("_both")).drop("x", "_both")
    return hits.withColumn("z", F.size("t")).where((F.col("shared") >= least) & (F.col("shared") * 100 >= F.col("z") * percent))


def overclaims(units: DataFrame, paper: DataFrame, group: str) -> DataFrame:
    """(group, unit, no, strong, hedge): a strong, unhedged, unnegated unit whose best source sentence is hedged.

    Cleared where a source sentence that shares 40 % of the topic words uses the same strong word. Inputs: sentence_rows.
    """
    word = lambda c, p: F.lower(F.regexp_extract(c, T.whole_word(p).replace("(?:" + p, "(" + p, 1), 1))
    bold = units.where(F.col("s").rlike(T.whole_word(T.STRONG)) & ~F.col("s").rlike(T.whole_word(T.HEDGE)) & ~F.col("s").rlike(T.whole_word(T.NEGATION)))
    near = _pairs(bold, paper, group, 3, 40).withColumn("strong", word("u", T.STRONG))
    same = F.contains(F.lower("s"), F.col("strong"))
    over = W.partitionBy(group, "unit")
    ranked = near.withColumn("cleared", F.bool_or(same).over(over)).withColumn("k", F.row_number().over(over.orderBy(F.desc("shared"), "no")))
    best = ranked.where("k = 1 AND NOT cleared AND shared * 2 >= z").withColumn("hedge", word("s", T.HEDGE))
    return best.where("hedge <> ''").select(group, "unit", "no", "strong", "hedge")


def dropped_modals(units: DataFrame, paper: DataFrame, group: str) -> DataFrame:
    """(group, unit, no): a flat sentence whose nearest source sentence (four topic words, 60 %) is only a possibility.

    The modal must stand in a clause that shares two words, or whose neighbours with it share three; a source sentence
    nearly as near without a modal clears the unit.
    """
    flat = units.where(F.col("s").rlike(r"[.!][\"'”’)]*$") & ~F.col("s").rlike(T.whole_word(T.NEGATION)) & ~F.col("s").rlike(T.whole_word(T.HEDGE)))
    near = _pairs(flat, paper, group, 4, 60).withColumn("modal", F.col("s").rlike(MODAL))
    over = W.partitionBy(group, "unit")
    ranked = near.withColumn("top", F.max("shared").over(over)).withColumn("k", F.row_number().over(over.orderBy(F.desc("shared"), "no")))
    ranked = ranked.withColumn("cleared", F.bool_or(~F.col("modal") & (F.col("shared") * 10 >= F.col("top") * 8)).over(over))
    best = ranked.where("k = 1 AND modal AND NOT cleared").withColumn("c", F.split("s", CLAUSE))
    share = lambda text: F.size(F.array_intersect("t", T.alpha_words(text)))
    clause = F.exists(F.sequence(F.lit(1), F.size("c")), lambda i: F.element_at("c", i).rlike(MODAL) & (share(F.element_at("c", i)) >= 2) & (share(F.array_join(F.slice("c", F.greatest(i - 1, F.lit(1)), F.lit(3)), " ")) >= 3))
    return best.where(clause).select(group, "unit", "no")


def announced_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n): distinct short sentences that announce how many things follow."""
    rows = texts.select(key, F.explode(F.array_distinct(T.sentences(F.col(text)))).alias("s")).where((F.length("s") < 400) & F.col("s").rlike(T.whole_word(ANNOUNCE)))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def caveats_lost(paper: DataFrame, vocabulary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n_caveats, n_lost): caveat sentences whose topic the vocabulary has, but less than half of its words."""
    rows = paper.select(key, F.posexplode(T.sentences(F.col(text))).alias("no", "s")).where(F.col("s").rlike(T.whole_word(T.CAVEAT))).withColumn("t", T.topic_words(T.alpha_words(F.col("s"))))
    known = vocabulary.select(F.explode(T.alpha_words(F.col(text))).alias("x")).distinct().withColumn("hit", F.lit(1))
    each = rows.select(key, "no", F.size("t").alias("z"), F.explode_outer("t").alias("x")).join(known, "x", "left").groupBy(key, "no", "z").agg(F.count("hit").alias("n"))
    return each.groupBy(key).agg(F.count(F.lit(1)).alias("n_caveats"), F.count_if((F.col("n") > 0) & (F.col("n") * 2 < F.col("z"))).alias("n_lost"))


def said_late(shown: DataFrame, said: DataFrame, key: str, order: str, words: Column) -> DataFrame:
    """(key, word, shown, said): words that come on screen before they are said, or are never said."""
    first = lambda df, n: df.select(key, order, F.explode(words).alias("word")).groupBy(key, "word").agg(F.min(order).alias(n))
    return first(shown, "shown").join(first(said, "said"), [key, "word"], "left").where("said IS NULL OR said > shown")


def unspoken(slides: DataFrame, key: str = "path", no: str = "n", screen: str = "screen", say: str = "say", backup: str = "backup") -> DataFrame:
    """(key, n, term): terms that a talk shows and never says, by the slide that shows each first.

    A term counts as said by any of its keys: as it is, with or without a plural s, spelled out ("E-x-M-y", "b over c"),
    as initials of two to six neighbouring words, as a part of a longer term; or by all of its own parts. One anti-join on
    (talk, key): a term stays when all of its keys miss."""
    said = slides.select(key, F.explode(F.array(F.coalesce(F.col(say), F.lit("")))).alias("t"))
    words = F.regexp_extract_all("t", F.lit("[A-Za-z]+"), F.lit(0))
    initials = F.flatten(F.array(*[F.transform(T.shingles(F.transform(words, lambda w: F.substring(w, 1, 1)), n), lambda g: F.replace(g, F.lit(" "), F.lit(""))) for n in range(2, 7)]))
    whole = F.array_distinct(F.transform(F.concat(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), C.spoken_forms(F.col("t")), initials), F.lower))
    parts = F.filter(F.flatten(F.transform(whole, lambda w: F.split(w, "[-/_+]"))), lambda p: p != "")
    plain = F.transform(F.regexp_extract_all("t", F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), F.lower)
    keys = said.select(key, F.explode(F.concat(F.transform(F.concat(whole, parts), lambda w: F.struct(w.alias("k"), F.lit(True).alias("term"))), F.transform(plain, lambda w: F.struct(w.alias("k"), F.lit(False).alias("term"))))).alias("x"))
    keys = keys.groupBy(key, F.col("x.k").alias("k")).agg(F.bool_or("x.term").alias("term"))
    shown = slides.where(~F.coalesce(F.col(backup), F.lit(False))).select(key, no, F.explode(F.array_distinct(F.regexp_extract_all(screen, F.lit(TERM), F.lit(0)))).alias("term"))
    shown = shown.where(C.is_jargon(F.col("term"))).groupBy(key, "term").agg(F.min(no).alias(no))
    low = F.lower("term")
    own = F.filter(F.split(low, "[-/_+]"), lambda p: p != "")
    ask = lambda w, part: F.struct(w.alias("k"), F.lit(part).alias("part"))
    asked = shown.withColumn("n_parts", F.size(F.array_distinct(own))).withColumn("several", F.size(own) > 1)
    asked = asked.select(key, no, "term", "n_parts", "several", F.explode(F.concat(
        F.array(ask(low, False), ask(F.concat(low, F.lit("s")), False)), F.when(low.endswith("s"), F.array(ask(F.substring(low, F.lit(1), F.length(low) - 1), False))).otherwise(F.array().cast("array<struct<k:string,part:boolean>>")),
        F.transform(F.array_distinct(own), lambda p: ask(p, True)))).alias("a"))
    asked = asked.select(key, no, F.col("term").alias("shown"), "n_parts", "several", "a.k", "a.part")
    hit = asked.join(keys, [key, "k"], "left").groupBy(key, no, "shown", "n_parts", "several").agg(
        F.coalesce(F.bool_or(~F.col("part") & F.col("term")), F.lit(False)).alias("as_term"), F.count_if(F.col("part") & F.col("term").isNotNull()).alias("found"))
    return hit.where(~F.col("as_term") & ~(F.col("several") & (F.col("found") == F.col("n_parts")))).select(key, no, F.col("shown").alias("term"))


# ---- fixed values --------------------------------------------------------------------------------
UNIT_NOUNS = "bit bits byte bytes point points percent x times fold second seconds minute minutes hour hours step steps epoch epochs layer layers trial trials sample samples token tokens frame frames run runs seed seeds cell cells".split()
OBJECT_NUMBER = r"(?i)\b(fig(?:ure)?s?|tab(?:le)?s?)\.?\s*([0-9]{1,3})\b"
# --------------------------------------------------------------------------------------------------


def reciprocals(slides: DataFrame, key: str = "path", no: str = "n", screen: str = "screen", say: str = "say") -> DataFrame:
    """(key, n, a, b): decimals that are only on a slide's screen and only in what is said with it, and whose product is 1
    within 0.03: one quantity in two forms. Whole numbers do not count.

    Values meet by cells of their logarithms (an equi-join on slide and cell), not all with all."""
    numbers = lambda c: F.array_distinct(F.transform(T.source_decimals(F.coalesce(F.col(c), F.lit(""))), lambda v: v.cast("double")))
    rows = slides.select(key, no, numbers(screen).alias("s"), numbers(say).alias("p"))
    fine = lambda values: F.filter(values, lambda v: (v > 0) & (v != F.floor(v)))
    cell = lambda c: F.floor(F.log(c) / 0.05)
    a = rows.select(key, no, F.explode(fine(F.array_except("s", "p"))).alias("a")).withColumn("cell", cell(F.col("a")))
    b = rows.select(key, no, F.explode(fine(F.array_except("p", "s"))).alias("b")).withColumn("cell", F.explode(F.array(*[cell(1 / F.col("b")) + i for i in (-1, 0, 1)])))
    return a.join(b, [key, no, "cell"]).where(F.abs(F.col("a") * F.col("b") - 1) <= 0.03).select(key, no, "a", "b")


def counts_off(slides: DataFrame, key: str = "path", no: str = "n", head: str = "head", screen: str = "screen", counts: str = "counts") -> DataFrame:
    """(key, n, said, drawn, what): counts in words ("five cars") that are one to four off what a slide draws.

    `counts` maps what is drawn (bullets, grid rows, grid columns, ...) to its number. A word counts from three on, before a
    noun of three letters or more that is no unit; bullets are held only against `head` (title and lead); a grid agrees by
    its rows, its columns or their product."""
    words = F.create_map(*[F.lit(x) for kv in {**{w: i for i, w in enumerate(M.UNITS)}, **M.TENS}.items() for x in kv])
    pattern = r"(?i)\b(" + "|".join([*M.UNITS, *M.TENS]) + r")\s+([a-z]{1,14})"

    def said(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.named_struct(F.lit("w"), F.lower(F.regexp_extract(m, pattern, 1)), F.lit("noun"), F.lower(F.regexp_extract(m, pattern, 2))))
        fine = F.filter(found, lambda f: (F.length(f["noun"]) >= 3) & ~f["noun"].isin(UNIT_NOUNS))
        return F.array_distinct(F.transform(fine, lambda f: F.try_element_at(words, f["w"])))

    grid = F.array(F.try_element_at(counts, F.lit("grid rows")), F.try_element_at(counts, F.lit("grid columns")))
    rows = slides.select(key, no, said(F.col(head)).alias("in_head"), said(F.col(screen)).alias("in_all"), F.when(grid[0].isNotNull() & grid[1].isNotNull(), F.concat(grid, F.array(grid[0] * grid[1]))).otherwise(grid).alias("grid"), F.explode(counts).alias("what", "drawn"))
    rows = rows.select(key, no, "what", "drawn", "grid", F.explode(F.when(F.col("what") == "bullets", F.col("in_head")).otherwise(F.col("in_all"))).alias("said"))
    off = F.abs(F.col("said") - F.col("drawn")).between(1, 4) & (F.col("said") >= 3)
    agrees = F.col("what").startswith("grid") & F.coalesce(F.array_contains(F.filter("grid", lambda g: g.isNotNull()), F.col("said")), F.lit(False))
    return rows.where(off & ~agrees).select(key, no, "said", "drawn", "what")


def numbers_beyond(texts: DataFrame, limits: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, kind, number, held): figures and tables that texts name by a number beyond how many there are.

    `limits` (group, figures, tables); groups without figures (tables) say nothing about them."""
    named = texts.select(group, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(OBJECT_NUMBER), F.lit(0)))).alias("m"))
    named = named.select(group, F.when(F.lower("m").startswith("fig"), "figure").otherwise("table").alias("kind"), F.regexp_extract("m", OBJECT_NUMBER, 2).cast("int").alias("number")).distinct()
    held = limits.select(group, F.explode(F.map_from_arrays(F.array(F.lit("figure"), F.lit("table")), F.array(F.col("figures").cast("int"), F.col("tables").cast("int")))).alias("kind", "held"))
    return named.join(held, [group, "kind"]).where("held > 0 AND number > held").select(group, "kind", "number", "held")
