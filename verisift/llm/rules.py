"""Quality rules with risk-controlled thresholds.

Measures of a text become rules "reject above the cutoff". Labelled documents (quality 1: good) are dealt by a hash
into a tuning half and a holdout. The tuning half lays out, for each stratum, a path of cutoffs for all rules from loose
to tight (a rule takes part only where it rejects low-quality documents clearly more often than good ones). The holdout
decides how far to go: at each step the exact binomial (Clopper-Pearson) upper bound of the false-rejection rate of all
rules together must not exceed `risk`. The walk stops at the first failure (fixed-sequence testing, so the steps of one
walk need no correction); over strata the error probability is split by Bonferroni. With probability 1 - `error` no
stratum loses more than `risk` of its good documents to these rules.

A stratum has rules only by its own labels: null strata, strata without labels and those with fewer than `min_good` good
holdout documents have none. There is no limit on the number of strata. Histograms come to the driver one stratum at a
time; what it keeps is a few numbers a stratum that has enough labels.

Nulls: a null text counts as empty, a null stratum has no rules, a null doc_id has no label. Texts without words, very
long ones, repeated rows (each a document) and an empty table need no special case; several labels of one id count as
good if one is; equal shares are on the same side of a cutoff. Without labels no rule is on. Columns of the input that
are called like a measure are replaced by it in `measures`; `passing` returns the input's columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from math import exp, lgamma, log, log1p
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import bloom_has, bloom_of, filter_bits, part_of, staged
from ._words import U, Words, chunks

RULES = ("symbols", "dup_lines", "repeats", "upper", "bars", "long_words", "short")
GRID = 1000  # a measure is a share in thousandths
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_bars long, n_lines long"


def _repeat_words(g: np.ndarray, n: int, k: int = 5) -> int:
    """Words covered by windows whose hash g occurs twice or more."""
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def measure_batch(column) -> pa.RecordBatch:
    out = [[] for _ in range(8)]
    for _, data, offsets in chunks(column):
        w = Words(data, offsets)
        space = np.zeros(len(data) + 1, np.int64)
        totals = []
        word_byte = np.zeros(len(data) + 1, np.int8)
        np.add.at(word_byte, w.start, 1)
        np.add.at(word_byte, w.end, -1)
        inside = np.cumsum(word_byte, dtype=np.int8)[: len(data)].astype(bool)
        first_byte = (data & 0xC0) != 0x80
        for mask in (inside & first_byte, _SYMBOL[data], (data >= 65) & (data <= 90), data == 124):
            np.cumsum(mask, out=space[1:])
            totals.append(space[offsets[1:]] - space[offsets[:-1]])
        g, raw = w.windows(5), data.tobytes()
        for i in range(len(offsets) - 1):
            a, b = int(w.first[i]), int(w.first[i + 1])
            dup, lines = _dup_lines(raw[offsets[i] : offsets[i + 1]])
            out[0].append(b - a)
            out[3].append(dup)
            out[4].append(_repeat_words(g[a : b - 4], b - a) if b - a > 5 else 0)
            out[7].append(lines)
        for k, j in ((1, 0), (2, 1), (5, 2), (6, 3)):
            out[k].extend(totals[j].tolist())
    return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in MEASURES.split(", ")])


def measures(docs: DataFrame, text: str = "text", among: DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """The input's other columns and the measures of each row's whole text; with `among`, of the rows whose id may be
    in its column doc_id (a Bloom filter picks them; it may let others through)."""
    made = [x.split()[0] for x in MEASURES.split(", ")]
    rest = [c for c in docs.columns if c != text and c not in made]
    names = [f"c{i}" for i in range(len(rest))]
    df = docs.select(F.col(f"`{text}`").alias("t"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)])
    bits, wanted = 0, None
    if among is not None:
        bits, key = filter_bits(among.count()), rest.index(doc_id) + 1
        wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(among, "doc_id", bits, 3))

    def run(batches):
        for batch in batches:
            if wanted is not None:
                ids = batch.column(key).cast(pa.int64())
                known = pa.compute.fill_null(ids, 0).to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(bloom_has(wanted.value, known, bits, 3) & ids.is_valid().to_numpy(zero_copy_only=False)))
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m = measure_batch(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *m.columns], names=[*names, *m.schema.names])

    kinds = dict(df.dtypes)
    out = df.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], MEASURES]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, rest)], *made)


def _rule_columns() -> list[Column]:
    """Each measure as a share in thousandths; a text without words has 0 everywhere."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    shares = {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "upper": F.col("n_upper") / chars,
        "bars": F.col("n_bars") / n,
        "long_words": F.col("word_chars") / n / 100,
        "short": F.lit(1.0) / (F.col("n_words") + 1),
    }
    return [F.least(F.floor(shares[r] * GRID), F.lit(GRID)).cast("int").alias(r) for r in RULES]


def _at_most(k: int, n: int, p: float) -> float:
    """The probability of at most k of n at a rate of p: an incomplete beta function, as a continued fraction (Lentz)."""
    if k >= n or p <= 0:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, p
    tiny, front = 1e-300, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f, m = d, 0
    while True:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14 or m > 1_000_000:
            return 1 - front * f if swap else front * f


def _upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest p under which at most k of n have a probability of `error`."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if 0 < mid < 1 and _at_most(k, n, mid) > error:
            lo = mid
        else:
            hi = mid
    return hi


def _histograms(labelled: DataFrame, by: list[str], n: int):
    """(stratum, {columns between: counts by the last column, a number below n}), one stratum at a time."""
    rows = labelled.groupBy("stratum", *by).count().orderBy("stratum").toLocalIterator()
    for stratum, part in groupby(rows, lambda r: r.stratum):
        out: dict = {}
        for r in part:
            out.setdefault(tuple(r)[1:-2], np.zeros(n, np.int64))[r[-2]] += r["count"]
        yield stratum, out


def _path(hist: dict, allowed: list[float], gain: float) -> dict[str, list[int]]:
    """A stratum's cutoffs from loose to tight of each rule that takes part, from its tuning histograms."""
    path, zero = {}, np.zeros(GRID + 2, np.int64)
    for i, rule in enumerate(RULES):
        over = {good: np.cumsum(hist.get((good, i), zero)[::-1])[::-1] for good in (0, 1)}
        hit, miss = over[0][1:] / max(over[0][0], 1), over[1][1:] / max(over[1][0], 1)
        useful = (hit >= 0.005) & (hit >= gain * miss)
        cuts: list[int] = []
        for rate in allowed:
            at = np.flatnonzero(useful & (miss <= rate))
            cuts.append(min([GRID, *cuts[-1:], *at[:1].tolist()]))
        if cuts[-1] < GRID:
            path[rule] = cuts
    return path


def cutoffs(labelled: DataFrame, risk: float = 0.02, error: float = 0.05, min_good: int = 250, gain: float = 5.0, steps: int = 6) -> dict[str | None, dict[str, int]]:
    """Cutoffs of each stratum with enough labels, from rows (stratum, good 0/1, holdout boolean, a column a rule).

    None stands for all others and has no rules. Only counts leave the executors: rules x 2 x GRID of a stratum, then steps.
    """
    spark = labelled.sparkSession
    sizes = labelled.where("holdout AND good = 1 AND stratum IS NOT NULL").groupBy("stratum").count().where(F.col("count") >= min_good)
    strata = sorted(r.stratum for r in sizes.collect())
    out: dict = {None: {}}
    if not strata:
        return out
    rows = labelled.join(F.broadcast(spark.createDataFrame([(s,) for s in strata], "stratum string")), "stratum")
    long = rows.where("NOT holdout").select("stratum", "good", F.expr(f"stack({len(RULES)}, {', '.join(f'{i}, `{r}`' for i, r in enumerate(RULES))}) AS (rule, bin)"))
    # tuning: at step j a rule is as tight as a false-rejection rate of allowed[j] among tuning documents lets it be
    allowed = [0.0, *[risk / 2 ** (steps - 2 - j) for j in range(steps - 1)]]
    path = dict.fromkeys(strata, {}) | {s: _path(hist, allowed, gain) for s, hist in _histograms(long, ["good", "rule", "bin"], GRID + 2)}
    # holdout: walk down the path while the bound for all rules together holds
    table = spark.createDataFrame([(s, [p.get(r, [GRID] * steps) for r in RULES]) for s, p in path.items()], "stratum string, cuts array<array<int>>")
    tests = [F.expr(f"size(filter(cuts[{i}], c -> `{r}` <= c))") for i, r in enumerate(RULES)]
    tested = rows.where("holdout AND good = 1").join(F.broadcast(table), "stratum").select("stratum", F.least(*tests).alias("step"))
    for s, lost in _histograms(tested, ["step"], steps + 1):
        counts = lost[()]
        n, passed = int(counts.sum()), -1
        for j in range(steps):
            if _upper_bound(int(counts[: j + 1].sum()), n, error / len(strata)) > risk:
                break
            passed = j
        out[s] = {r: cuts[passed] for r, cuts in path[s].items() if cuts[passed] < GRID} if passed >= 0 else {}
    return out


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))


def judge(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", **how) -> Column:
    """A boolean column over rows with measures: whether every rule of the row's stratum lets it pass. `measured` has
    the rows with labels at least."""
    lab = _labelled(labels).select(F.col("doc_id").alias("l_id"), "good")
    rows = measured.select(F.col(f"`{doc_id}`").alias("m_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), *_rule_columns())
    rows = rows.join(lab, F.col("m_id") == F.col("l_id")).select("stratum", "good", (part_of(F.concat(F.lit("h"), F.col("m_id").cast("string")), 2) == 0).alias("holdout"), *RULES)
    found = cutoffs(staged(rows, "labelled"), **how)  # few columns of labelled rows: texts are read once for them
    table = [x for s, cut in found.items() if cut for x in (F.lit(s), F.array(*[F.lit(cut.get(r, GRID)) for r in RULES]))]
    if not table:
        return F.lit(True)
    cuts = F.try_element_at(F.create_map(*table), F.col(f"`{stratum}`").cast("string"))  # a constant, looked up by the row's stratum
    passes = reduce(and_, [c <= cuts[i] for i, c in enumerate(_rule_columns())])
    return F.coalesce(passes, F.lit(True))  # no cutoffs: no rules


def passing(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang", **how) -> DataFrame:
    """The rows of `docs` that neither the base rules nor the cutoffs reject, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{stratum}`").alias("lang"))
    verdict = judge(measures(rows.drop("row"), "t", _labelled(labels).select("doc_id")), labels, **how)
    return measures(rows, "t").where(~base_failed() & verdict).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
