"""URL filters: allow and block rules first, then a ratio of two character language models, DataFrame expressions only.

Rules name a host (and its subdomains) and the start of a path; the longest that fits decides. URLs that rules decide
also teach two smoothed variable-order Markov models, of accepted and of rejected URLs: a character's probability is
interpolated from order 0 up to ORDER, each order with `weight` virtual observations of the order below, so contexts
that were never seen fall back by themselves. Counts are exact: a row for each (context, sign) that occurs. What the
last ORDER + 1 signs add to the score is worked out once for each such gram that any URL has, by joins of these
counts order by order (a gram has at most BASE neighbours of one context or suffix, so no key is hot). URLs fetch it
by a join on their grams: broadcast up to BROADCAST grams, shuffled beyond but for hot grams; so are scores by URL.

The score is the difference of the two log-likelihoods divided by the length. One in five of the decided URLs is held
out of the counts; on them the threshold with the best balanced accuracy is chosen from a histogram of fixed size.

A null url, or one without ://, has an empty host and path; the models judge what there is, an empty string at worst,
which has the score of a string's end alone. Without accepted or rejected URLs the verdict is allow. Repeated rows are judged alike; of rules of one length
the first in order of host and path decides, a score at the threshold is accepted. Very long URLs are read whole: one row
for each sign while grams are counted. An empty table stays empty. Names of the input's columns cannot clash: all but the
columns in `keep` and the url are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import join_hot, part_of, release, staged, staged_so_far

#: (host, path, verdict); a list of rules is short enough to be part of the plan.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789:/.-_?=&#%+~@"  # other characters are one sign more
BASE = len(SIGNS) + 3  # and a start and an end sign
START, END = len(SIGNS) + 1, len(SIGNS) + 2
ORDER = 4
BROADCAST = 1 << 18  # grams
UNIT = 2.0**36  # of the scores that grams add: sums of whole numbers do not depend on their order
BINS, SPAN = 2000, 4.0  # of scores
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = (F.when if name is None else name.when)(fits, F.lit(h + p))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(v))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def _codes(column: str) -> Column:
    """A plain URL's characters as small numbers, an end sign last."""
    return F.expr(f"concat(transform(filter(split(coalesce({column}, ''), ''), c -> c <> ''), c -> instr('{SIGNS}', c)), array({END}))")


def _plain(url: str) -> Column:
    """The URL behind ://, letters in lower case."""
    rest = F.coalesce(F.regexp_replace(F.col(url), r"^[^:/?#]*://", ""), F.lit(""))
    return F.translate(rest, _UPPER, _LOWER)


def _places(urls: DataFrame, *keep: str) -> DataFrame:
    """The columns in `keep` and g, the last ORDER + 1 signs at each place of `codes` as one number."""
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), F.col("codes"))
    gram = " + ".join(f"bigint(p[i + {ORDER - j}]) * {BASE**j}L" for j in range(ORDER + 1))
    return urls.select(*keep, padded.alias("p")).selectExpr(*keep, f"explode(transform(sequence(0, size(p) - {ORDER + 1}), i -> {gram})) AS g")


def gram_scores(urls: DataFrame, weight: float = 1.0) -> DataFrame:
    """(g, s): the difference of log-likelihoods that each gram of `urls` adds.

    `urls`: codes, and how many accepted (a) and rejected (r) URLs to count they stand for, 0 for those only to judge.
    """
    sums = lambda df, key: df.groupBy(key.alias("x")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    grams = staged(sums(_places(urls, "a", "r"), F.col("g")), "url-grams")
    counts = {ORDER: grams}
    for k in range(ORDER - 1, -1, -1):
        counts[k] = sums(counts[k + 1], F.expr(f"pmod(x, {BASE ** (k + 1)}L)"))
    total = counts[0].agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_r")).first()
    # as if both classes had equally many characters: else the larger one would find all that is new less likely
    even = {"a": (total.n_a + total.n_r) / (2 * total.n_a) if total.n_a else 0.0, "r": (total.n_a + total.n_r) / (2 * total.n_r) if total.n_r else 0.0}
    below = None
    for k in range(ORDER + 1):
        rows = counts[k].withColumn("c", F.expr(f"x div {BASE}L"))
        contexts = rows.groupBy("c").agg(F.sum("a").alias("c_a"), F.sum("r").alias("c_r"))
        rows = rows.join(contexts, "c").withColumn("y", F.expr(f"pmod(x, {BASE**k}L)"))
        rows = rows.withColumn("q_a", F.lit(1.0 / BASE)).withColumn("q_r", F.lit(1.0 / BASE)) if below is None else rows.join(below, "y")
        p = {side: (F.col(side) * even[side] + weight * F.col(f"q_{side}")) / (F.col(f"c_{side}") * even[side] + weight) for side in "ar"}
        below = rows.select(F.col("x").alias("y"), p["a"].alias("q_a"), p["r"].alias("q_r"))
    return below.select(F.col("y").alias("g"), (F.log("q_a") - F.log("q_r")).alias("s"))


def scores(urls: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(plain, score): the length-normalised difference of log-likelihoods of each row of `urls` (plain, codes, a, r)."""
    urls = staged(urls.withColumn("id", F.monotonically_increasing_id()), "urls")  # written, so that ids stay
    table = staged(gram_scores(urls).select("g", F.round(F.col("s") * UNIT).cast("long").alias("s")), "url-model")
    places = _places(urls, "id")
    placed = places.join(F.broadcast(table), "g") if table.count() <= broadcast else join_hot(places, table, "g")
    sums = placed.groupBy("id").agg(F.sum("s").alias("s"))
    return staged(urls.join(sums, "id").select("plain", (F.col("s") / UNIT / F.size("codes")).alias("score")), "url-scores")


def judge(pages: DataFrame, url: str = "url", rules=RULES, keep: tuple[str, ...] = ("page_id",), broadcast: int = BROADCAST) -> DataFrame:
    """The columns in `keep`, then host, path, rule and verdict, and the models' score of each URL."""
    mark = staged_so_far()
    host, path = split_url(F.col("u"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{url}`").cast("string").alias("u"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict).withColumn("plain", _plain("u"))
    held = part_of(F.col("u"), 5) == 0
    learnt = lambda v: F.sum((~held & (F.col("given") == v)).cast("long"))
    urls = rows.groupBy("plain").agg(F.coalesce(learnt("allow"), F.lit(0)).alias("a"), F.coalesce(learnt("block"), F.lit(0)).alias("r"))
    scored = join_hot(rows, scores(urls.withColumn("codes", _codes("plain")), broadcast), "plain")
    cell = F.floor((F.greatest(F.least("score", F.lit(SPAN)), F.lit(-SPAN)) + SPAN) / (2 * SPAN) * BINS).cast("int")
    seen = scored.where(F.col("given").isNotNull() & held).groupBy(cell.alias("cell")).agg(F.sum((F.col("given") == "allow").cast("long")).alias("a"), F.sum((F.col("given") != "allow").cast("long")).alias("r")).collect()
    cut = threshold([(x.cell, x.a, x.r) for x in seen])
    verdict = F.when(F.col("score") >= cut, "allow").otherwise("block") if cut is not None else F.lit("allow")
    out = scored.select("row.*", "host", "path", "rule", F.coalesce("given", verdict).alias("verdict"), "score")
    release(mark, out)
    return out


def threshold(cells: list[tuple[int, int, int]]) -> float | None:
    """The score with the best balanced accuracy on held-out counts (cell, accepted, rejected); the lowest of equals."""
    accepted, rejected = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not accepted or not rejected:
        return None
    best, cut, below_a, below_r = -1.0, 0, 0, 0
    for cell, a, r in sorted(cells):
        if (quality := (accepted - below_a) / accepted + below_r / rejected) > best:
            best, cut = quality, cell
        below_a, below_r = below_a + a, below_r + r
    return cut / BINS * 2 * SPAN - SPAN
