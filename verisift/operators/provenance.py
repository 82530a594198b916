"""Where derived text and its source differ in values, quotations, passages and wording."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .._staging import broadcast_if
from ..functions import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

SMALL = 200_000  # rows of a side that is broadcast
MATH = r"[\x{0300}-\x{03FF}√∑∏∫$\\^_⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ₀₁₂₃₄₅₆₇₈₉₊₋]"  # a fixed value: signs that a page's text layer puts elsewhere


def exploded(df: DataFrame, key: str, values: Column, name: str = "value") -> DataFrame:
    """(key, value) rows of an array column."""
    return df.select(F.col(key), F.explode(values).alias(name))


def unsourced(derived: DataFrame, source: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value) of derived decimals that the source does not have: a hash anti join on values as strings."""
    known = source.select(F.explode(T.source_decimals(F.col(text))).alias("value")).distinct()
    return exploded(derived, key, T.decimals(F.col(text))).join(known, "value", "left_anti").select(key, "value")


def unsourced_integers(derived: DataFrame, source: DataFrame, skip: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for whole numbers of two digits or more, thousands separators taken out on both sides."""
    known = source.select(F.explode(T.found(T.flat_thousands(F.col(text)), T.SOURCE_INTEGER)).alias("value")).distinct()
    rows = exploded(derived, key, T.integers(F.col(text)))
    return (rows.where(~F.col("value").isin(*skip)) if skip else rows).join(known, "value", "left_anti").select(key, "value")


def dropped(source: DataFrame, derived: DataFrame, text: str = "text") -> DataFrame:
    """Source values that no derived text uses."""
    return source.select(F.explode(T.decimals(F.col(text))).alias("value")).distinct().join(derived.select(F.explode(T.source_decimals(F.col(text))).alias("value")).distinct(), "value", "left_anti")


def membership(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """(value, side): both, or in one only. One aggregate over tagged values, no outer join."""
    tagged = left.select(F.explode(T.decimals(F.col(text))).alias("value"), F.lit(1).alias("side")).unionAll(right.select(F.explode(T.decimals(F.col(text))).alias("value"), F.lit(2).alias("side")))
    sides = tagged.groupBy("value").agg(F.bit_or("side").alias("s"))
    return sides.select("value", F.element_at(F.array(F.lit("source only"), F.lit("derived only"), F.lit("both")), F.col("s")).alias("side"))


def claims(texts: DataFrame, listed: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """(label, value, n_found, unique): a claim without context must occur exactly once. One pass for all claims."""
    counts = texts.agg(*[F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(r"(?<![0-9.])" + v.replace(".", r"\.") + "(?![0-9])"))), F.lit(0)).alias(f"n{i}") for i, (_, v) in enumerate(listed)])
    rows = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(v).alias("value"), F.col(f"n{i}").cast("long").alias("n_found")) for i, (l, v) in enumerate(listed)])
    return counts.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.n_found") == 1).alias("unique"))


def inflected(line: str) -> str:
    """A ban line as a pattern: `re:` verbatim in any case, else its words with their usual endings, as whole words in any
    case and not right behind not, never or n't. A verbatim pattern's leading ^ stands for the start of any paragraph.

    The first word is looked for before what stands behind it, so that most places of a text cost one comparison."""
    if line.startswith("re:"):
        pattern = line[3:].strip()
        return "(?i)" + (r"(?:^|(?<=\n\n))" + pattern[1:] if pattern.startswith("^") else pattern)
    out, first = [], ""
    for w in line.split():
        if "-" in w or len(w) <= 3:
            out.append(w.replace("-", r"\-"))
            first = first or out[0]
            continue
        base = w
        if not w.lower().endswith(("ss", "us", "is")):
            for ending in ("ing", "ed", "s"):
                if w.lower().endswith(ending) and len(w) > len(ending) + 1:
                    base = w[: -len(ending)]
                    break
            if len(base) > 3 and base.lower().endswith("e"):
                base = base[:-1]
        out.append(base + "(?:e|es|s|ed|d|ing|en|n)?")
        first = first or base
    return rf"(?i)(?={first})" + r"(?<!(?<![A-Za-z0-9_])not\s)(?<!(?<![A-Za-z0-9_])never\s)(?<!n't\s)" + T.whole_word(r"\s+".join(out)).removeprefix("(?i)")


def banned(texts: DataFrame, lines: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pattern, n): texts with a banned phrase; a phrase right behind not, never or n't does not count.

    The list is part of the plan: one scan of the text, one flag a pattern, no join.
    """
    flags = [F.struct(F.lit(line).alias("pattern"), F.regexp_count(F.col(text), F.lit(inflected(line))).cast("long").alias("n")) for line in lines]
    return texts.select(key, F.explode(F.filter(F.array(*flags), lambda f: f["n"] > 0)).alias("f")).select(key, "f.pattern", "f.n")


def banned_places(texts: DataFrame, lines: list[str], key: str = "doc_id", text: str = "text", before: int = 55, after: int = 35) -> DataFrame:
    """(key, pattern, at, context): every banned phrase with the place of its first sign (from 0) and what stands around
    it, white space as single spaces. Texts without any phrase are left out before places are worked out."""

    def places(line: str) -> Column:
        p = inflected(line)
        matches, gaps = F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), F.split(F.col(text), p)
        start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct(
            F.concat(s["at"], F.array(s["end"] + F.length(F.get(gaps, i)))).alias("at"), (s["end"] + F.length(F.get(gaps, i)) + F.length(F.get(matches, i))).alias("end"))
        at = F.aggregate(F.transform(matches, lambda _, i: i), start, step, lambda s: s["at"])
        context = lambda a, m: F.trim(F.regexp_replace(F.substring(F.col(text), F.greatest(a - before, F.lit(0)) + 1, F.least(a, F.lit(before)) + F.length(m) + after), r"\s+", " "))
        found = F.zip_with(at, matches, lambda a, m: F.struct(F.lit(line).alias("pattern"), a.alias("at"), context(a, m).alias("context")))
        return F.when(F.col(text).rlike(p), found).otherwise(F.array().cast("array<struct<pattern:string,at:int,context:string>>"))

    return texts.select(key, F.explode(F.concat(*map(places, lines))).alias("p")).select(key, "p.*")


def containment(texts: DataFrame, passages: DataFrame, k: int = 5, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, n_common, max_run): distinct k-word shingles of a passage in a text, and the longest copied run.

    An equi-join on shingles, broadcast while the passages have at most SMALL of them; positions on one diagonal that
    follow each other make a run (gaps and islands).
    """
    places = lambda df, i: df.select(i, F.posexplode(T.shingles(T.word_run(F.col(text)), k)).alias(f"{i}_pos", "gram"))
    hits = places(texts, key).join(broadcast_if(places(passages, item), SMALL), "gram")
    diagonal = hits.withColumn("d", F.col(f"{key}_pos") - F.col(f"{item}_pos"))
    over = W.partitionBy(key, item, "d").orderBy(f"{item}_pos")
    islands = diagonal.withColumn("g", F.col(f"{item}_pos") - F.row_number().over(over))
    runs = islands.groupBy(key, item, "d", "g").agg((F.count(F.lit(1)) + k - 1).alias("run"), F.collect_set("gram").alias("grams"))
    return runs.groupBy(key, item).agg(F.size(F.array_distinct(F.flatten(F.collect_list("grams")))).cast("long").alias("n_common"), F.max("run").cast("long").alias("max_run"))


def coined(derived: DataFrame, source: DataFrame, floor: int = 3, text: str = "text") -> DataFrame:
    """(word, n): words used `floor` times or more whose folded form the source lacks, alone, joined in pairs or in parts."""
    pattern = r"[A-Za-z][A-Za-z0-9]*(?:[-/][A-Za-z0-9]+)*"
    words = lambda df: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    mine = derived.select(F.explode(words(derived)).alias("w")).select(F.lower("w").alias("word"))
    mine = mine.where((F.length("word") >= 4) | F.col("word").rlike("[-/0-9]")).where(~F.col("word").isin(T.STOP_WORDS))
    mine = mine.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor)
    all_words = source.select(words(source).alias("a"))
    pairs = F.when(F.size("a") > 1, F.transform(F.sequence(F.lit(1), F.size("a") - 1), lambda i: F.concat(F.element_at("a", i), F.element_at("a", i + 1)))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.flatten(F.transform("a", lambda w: F.when(w.rlike("[-/]"), F.split(w, "[-/]")).otherwise(F.array().cast("array<string>")))), lambda p: F.length(p) >= 3)
    known = all_words.select(F.explode(F.array_distinct(F.concat("a", pairs, parts))).alias("w")).distinct().select(T.folded(F.col("w")).alias("f")).distinct()
    return mine.withColumn("f", T.folded(F.col("word"))).join(known, "f", "left_anti").select("word", "n")


def quotes(texts: DataFrame, sources: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5) -> DataFrame:
    """(key, n_quotes, n_missing): quotations of `least` words or more that no source has.

    A quotation that leaves something out (... or [...]) is cut there; its parts of two words or more must occur in one
    source, in order. Sources are looked up by the first words of the longest part (an equi-join on shingles of as many
    words as that part has, `least` at most), then the parts are matched in the texts found.
    """
    quoted = F.regexp_extract_all(F.translate(F.col(text), "“”", '""'), F.lit('"([^"]{8,400})"'), F.lit(1))
    parts = F.filter(F.transform(F.split("q", T.CUT), T.normal_quote), lambda p: F.contains(p, F.lit(" ")))
    n_words = lambda p: F.size(F.split(p, " "))
    rows = texts.select(key, F.explode(quoted).alias("q")).select(key, parts.alias("p")).where((F.size("p") > 0) & (n_words(F.array_join("p", " ")) >= least))
    longest = F.array_max(F.transform("p", lambda p: F.struct(n_words(p).alias("n"), p.alias("part"))))
    rows = rows.withColumn("n", F.least(longest["n"], F.lit(least))).withColumn("gram", F.array_join(F.slice(F.split(longest["part"], " "), F.lit(1), F.col("n")), " "))
    rows = rows.withColumn("q", F.array_join("p", ".*")).drop("p")  # a pattern: what is left are letters, digits and apostrophes
    normal = sources.select(T.normal_quote(F.col(text)).alias("s")).withColumn("w", F.split("s", " "))
    asked = rows.select("q", "n", "gram").distinct()
    grams = normal.select("s", F.explode(F.array_distinct(F.flatten(F.array(*[T.shingles(F.col("w"), n) for n in range(2, least + 1)])))).alias("gram"))
    found = asked.join(grams, "gram").where("s RLIKE q").select("q").distinct()
    marked = rows.join(found.withColumn("hit", F.lit(1)), "q", "left")
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(F.col("hit").isNull()).alias("n_missing"))


STEP, ODD, FILTER_BITS = 16, 0x9E3779B97F4A7C15, 22  # signs of a head that are looked up; a mixer; the size of a filter of heads


def _starts(flat: bytes, n: int) -> np.ndarray:
    """A filter's slot for each run of n signs (n up to STEP), by its first and last eight or all of them."""
    padded = np.frombuffer(flat + bytes(8), np.uint8)
    runs = np.lib.stride_tricks.sliding_window_view(padded, 8)[: max(len(flat) - n + 1, 0)].copy().view("<u8")[:, 0]
    if n < 8:
        mixed = runs & np.uint64((1 << 8 * n) - 1)
    else:
        mixed = runs * np.uint64(ODD | 2) ^ np.lib.stride_tricks.sliding_window_view(padded, 8)[n - 8 : len(flat) - 7].copy().view("<u8")[:, 0] if len(runs) else runs
    return (mixed * np.uint64(ODD)) >> np.uint64(64 - FILTER_BITS)


def _head_places(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(o, head): heads (ASCII) that stand in the flat text of a row (o, flat).

    One pass over the texts: a filter of bounded size, of the heads' first STEP signs (all of shorter ones), passes the
    places where one may begin; what stands there is joined to the heads and compared in full.
    """
    start = F.substring("head", 1, STEP)
    starts = heads.select(start.alias("start")).distinct()

    def slots(batches):
        for d in batches:
            yield pd.DataFrame([(len(s), int(_starts(s.encode(), len(s))[0])) for s in d["start"]], columns=["n", "slot"])

    # one word of 32 bits a row of the filter: at most 2^17 of them for each of STEP lengths
    words = starts.mapInPandas(slots, "n int, slot int").groupBy("n", F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 32)")).alias("bits")).toPandas()
    filters = {}
    for n, group in words.groupby("n"):
        bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        bits[group["word"].to_numpy()] = group["bits"].to_numpy().astype(np.uint32)
        filters[int(n)] = bits
    longest = heads.agg(F.max(F.length("head"))).first()[0] or 0
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def places(batches):
        for d in batches:
            out = []
            for o, flat in zip(d["o"], d["flat"]):
                raw = flat.encode()
                for n, bits in shared.value.items():
                    slot = _starts(raw, n)
                    at = np.flatnonzero(bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1))
                    long = longest if n == STEP else n
                    out += [(o, t[:n], t) for t in {flat[i : i + long] for i in at.tolist()}]
            yield pd.DataFrame(out, columns=["o", "start", "tail"])

    found = rows.where("flat <> ''").mapInPandas(places, "o long, start string, tail string")
    return found.join(heads.select(start.alias("start"), "head"), "start").where(F.startswith("tail", F.col("head"))).select("o", "head").distinct()


def arrived(fragments: DataFrame, outputs: DataFrame, item: str = "item_id", text: str = "text", lead: int = 6) -> DataFrame:
    """(item, n_arrived): in how many outputs a fragment arrives: its first `lead` words (all of a shorter one) as they
    are or with all spaces left out, or, where it holds mathematics, all its words of three letters or more in any order.
    A fragment without words arrives everywhere.

    Words as they are stand there without spaces too, so one pass over texts without spaces finds both. For mathematics,
    the words of each output that any such fragment has are kept, and compared where the fragment's rarest word is.
    """
    frag = fragments.select(item, F.col(text).rlike(MATH).alias("math"), T.word_run(F.col(text)).alias("w")).withColumn("head", F.array_join(F.slice("w", 1, lead), ""))
    rows = outputs.select(F.monotonically_increasing_id().alias("o"), T.word_run(F.col(text)).alias("w"))
    heads = frag.where("head <> ''").select(item, "head")
    found = _head_places(rows.select("o", F.array_join("w", "").alias("flat")), heads.select("head").distinct()).join(heads, "head").select(item, "o")
    words = F.array_distinct(F.filter("w", lambda x: x.rlike("^[a-z]{3,}$")))
    math = frag.where("math").select(item, words.alias("m")).where(F.size("m") > 0)
    if math.limit(1).count():
        asked = math.select(F.explode("m").alias("x")).distinct()
        # only words that are asked for are kept; null rows of an outer explode are not needed, as m is never empty
        hits = rows.select("o", F.explode(F.array_distinct("w")).alias("x")).join(broadcast_if(asked, SMALL), "x")
        rare = asked.join(hits.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x", "left")
        first = math.select(item, "m", F.explode("m").alias("x")).join(rare, "x").groupBy(item, "m").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "x")).alias("r")).select(item, "m", F.col("r.x").alias("x"))
        kept = hits.groupBy("o").agg(F.collect_set("x").alias("k")).select("o", "k", F.explode("k").alias("x"))
        found = found.unionAll(kept.join(first, "x").where(F.size(F.array_intersect("m", "k")) == F.size("m")).select(item, "o"))
    counts = found.groupBy(item).agg(F.count_distinct("o").alias("n"))
    empty = frag.where(F.size("w") == 0).select(item).distinct()
    if empty.limit(1).count():
        counts = counts.join(empty, item, "left_anti").unionByName(empty.withColumn("n", F.lit(outputs.count()).cast("long")))
    return fragments.select(item).join(counts, item, "left").select(item, F.coalesce("n", F.lit(0)).cast("long").alias("n_arrived"))


def markup_leaks(outputs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, pattern, n): literal markup left in an output."""
    flags = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("n")) for n, p in patterns.items()])
    return outputs.select(key, F.explode(F.filter(flags, lambda f: f["n"] > 0)).alias("f")).select(key, "f.pattern", "f.n")


def upsert_by_tag(existing: DataFrame, new: DataFrame, tag: str = "tag") -> DataFrame:
    """Replace by key: all lines of the tags in `new` give way to it."""
    return existing.join(new.select(tag).distinct(), tag, "left_anti").unionByName(new)
