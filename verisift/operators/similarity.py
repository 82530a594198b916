"""Matching pages, sentences and sets of words by what they share."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .._staging import broadcast_if
from ..functions import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package


LANES = 4  # words of 64 parity bits of a set


def _candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(i, j) of sets (id, s) that share a word of their prefixes and may have Jaccard num/den or more.

    Words that one set has and the other has not turn at most one parity bit each, so sets of which more bits differ than
    words may differ are left out where they meet, before anything of theirs is moved.
    """
    freq = sets.select(F.explode("s").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    h = F.xxhash64("w")
    parity = lambda k: F.bit_xor(F.when(F.pmod(h, F.lit(LANES)) == k, F.expr("shiftleft(1L, CAST(pmod(shiftright(xxhash64(w), 8), 64) AS INT))")).otherwise(F.lit(0).cast("long")))
    ranked = sets.select("id", F.explode("s").alias("w")).join(freq, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", h.alias("h")))).alias("r"), *[parity(k).alias(f"p{k}") for k in range(LANES)])
    size, bits = F.size("r"), [f"p{k}" for k in range(LANES)]
    # a rarer word first; sizes that may match fall into the same band of a factor den / num or the next one
    band = F.floor(F.log(size) / math.log(den / num)).cast("int")
    prefix = ranked.select("id", size.alias("z"), band.alias("band"), *bits, F.posexplode(F.slice("r", F.lit(1), size - F.ceil(size * num / den).cast("int") + 1)).alias("pos", "x"))
    prefix = prefix.select("id", "z", "band", *bits, "pos", "x.h")
    a, b = prefix.withColumn("at", F.col("band")).alias("a"), prefix.withColumn("at", F.explode(F.array(F.col("band") - 1, F.col("band")))).alias("b")
    near = f"a.h = b.h AND a.at = b.at AND (a.band < b.band OR a.id < b.id) AND {den} * least(a.z, b.z) >= {num} * greatest(a.z, b.z)"
    # what is left of both behind the shared word must be enough
    enough = f"least(a.z - a.pos, b.z - b.pos) * {den + num} >= {num} * (a.z + b.z)"
    alike = f"({' + '.join(f'bit_count(a.{p} ^ b.{p})' for p in bits)}) * {den + num} <= {den - num} * (a.z + b.z)"
    return a.join(b, F.expr(f"{near} AND {enough} AND {alike}")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).distinct()


def similar_sets(sets: DataFrame, words: str = "words", num: int = 1, den: int = 2) -> DataFrame:
    """(a, b, common, united) of distinct word sets with Jaccard num/den or more.

    Candidates share a word of their prefixes, rare words first (by their exact frequency), so frequent words bring
    nobody together, and agree in their parity bits as far as they must; each pair is verified once.
    """
    sets = sets.select(F.array_sort(F.array_distinct(words)).alias("s")).where(F.size("s") > 0).distinct().select(F.unhex(F.md5(F.array_join("s", "\n").cast("binary"))).alias("id"), "s")
    # words are fetched for candidates only
    pairs = _candidates(sets, num, den).join(sets.select(F.col("id").alias("i"), F.col("s").alias("x")), "i").join(sets.select(F.col("id").alias("j"), F.col("s").alias("y")), "j")
    both = pairs.withColumn("common", F.size(F.array_intersect("x", "y")).cast("long")).withColumn("united", F.size(F.array_union("x", "y")).cast("long"))
    name = lambda c: F.array_join(c, " ")
    return both.where(F.col("common") * den >= F.col("united") * num).select(F.least(name("x"), name("y")).alias("a"), F.greatest(name("x"), name("y")).alias("b"), "common", "united")


def greedy_pairs(left: DataFrame, right: DataFrame, group: str, order: str, words: str, floor: float = 0.5) -> DataFrame:
    """Within each group, every left row in order takes the unused right row with the highest Jaccard >= floor.

    Sequential by definition, so a group (a talk, a page pair) is one pandas call.
    """

    def run(key, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        lefts, rights = ([] if d.empty else [(o, frozenset(w)) for o, w in sorted(zip(d["o"], d["w"]), key=lambda x: x[0])] for d in (l, r))
        for o, mine in lefts:
            best, score = None, 0.0
            for p, v in rights:
                united = len(mine | v)
                s = len(mine & v) / united if united and p not in used else 0.0
                if s > score:
                    best, score = p, s
            if best is not None and score >= floor:
                used.add(best)
            else:
                best = None
            out.append((key[0], o, best))
        return pd.DataFrame(out, columns=["g", "l", "r"]).astype({"l": "int64", "r": "Int64"})

    kind = dict(left.dtypes)[group]
    side = lambda df: df.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(words).alias("w")).groupBy("g")
    got = side(left).cogroup(side(right)).applyInPandas(run, f"g {kind}, l long, r long")
    return got.select(F.col("g").alias(group), F.col("l").alias(order), F.col("r").alias("matched"))


def uncovered(texts: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, percent: int = 34) -> DataFrame:
    """(key, n_sentences, n_uncovered): sentences that give a reason, and those whose words the vocabulary hardly has.

    Words are looked up by a join on the distinct words of such sentences, broadcast while the vocabulary is small.
    """
    rows = texts.select(key, F.posexplode(T.sentences(F.col(text))).alias("no", "s")).where(F.col("s").rlike(T.whole_word(T.WHY)))
    rows = rows.withColumn("w", T.alpha_words(F.col("s"))).where(F.size("w") >= least)
    known = vocabulary.select(F.explode(T.alpha_words(F.col(text))).alias("x")).distinct()
    hits = rows.select(key, "no", F.size("w").alias("z"), F.explode("w").alias("x")).join(broadcast_if(known, 100_000).withColumn("hit", F.lit(1)), "x", "left")
    each = hits.groupBy(key, "no", "z").agg(F.count("hit").alias("n"))
    return each.groupBy(key).agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("n") * 100 < F.col("z") * percent).alias("n_uncovered"))


def best_support(units: DataFrame, paper: DataFrame, group: str, least: int = 3, percent: int = 50) -> DataFrame:
    """(group, unit, support, shared): each unit's best sentence of the source in its group; the first of equals.

    Rows (group, no, w): a sentence and its topic words. An equi-join on words, counted, and the arg-max by position.
    """
    u = units.select(group, F.col("no").alias("unit"), F.size("w").alias("z"), F.explode("w").alias("x"))
    p = paper.select(group, F.col("no").alias("support"), F.explode("w").alias("x"))
    shared = u.join(p, [group, "x"]).groupBy(group, "unit", "z", "support").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy(group, "unit", "z").agg(F.max(F.struct("shared", (-F.col("support")).alias("s"))).alias("b"))
    return best.where((F.col("b.shared") >= least) & (F.col("b.shared") * 100 >= F.col("z") * percent)).select(group, "unit", (-F.col("b.s")).alias("support"), F.col("b.shared").alias("shared"))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the second."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0)


def untouched(source: DataFrame, derived: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 34) -> DataFrame:
    """(key, n_sentences, n_untouched): sentences that state values, and those of which the derived texts have neither all
    values nor a fair share of the words.

    Relational division by counting: a sentence's values and words are looked up in the derived texts' distinct ones by one
    join, then counted. Values begin with a digit and words with a letter, so one array of strings holds both: distinct
    structs would be found by comparing all with all."""
    # a dot between digits may be a held one of an abbreviation; texts and sentences without any are not looked at further
    parts = source.where(F.col(text).rlike(r"[0-9][.\x01][0-9]")).select(key, F.explode(T.sentences(F.col(text))).alias("s")).where(F.col("s").rlike(T.DECIMAL))
    rows = parts.select(F.monotonically_increasing_id().alias("row"), key, T.decimals(F.col("s")).alias("v"), T.alpha_words(F.col("s")).alias("w"))
    rows = rows.where((F.size("v") > 0) & (F.size("w") > 0)).select("row", key, F.size("v").alias("n_v"), F.size("w").alias("n_w"), F.explode(F.concat("v", "w")).alias("x"))
    used = derived.select(F.explode(F.concat(T.source_decimals(F.col(text)), T.alpha_words(F.col(text)))).alias("x")).distinct().withColumn("hit", F.lit(1))
    value = F.substring("x", 1, 1) <= "9"
    each = rows.join(used, "x", "left").groupBy(key, "row", "n_v", "n_w").agg(F.count(F.when(value, F.col("hit"))).alias("h_v"), F.count(F.when(~value, F.col("hit"))).alias("h_w"))
    left = (F.col("h_v") < F.col("n_v")) & (F.col("h_w") * 100 < F.col("n_w") * percent)
    return each.groupBy(key).agg(F.count("*").alias("n_sentences"), F.count_if(left).alias("n_untouched"))
