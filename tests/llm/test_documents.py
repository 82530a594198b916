"""Operators on documents against brute force, with the cases of conftest.small_docs."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1, 0)  # a null id's place in the order
place = lambda i: LAST if i is None else (0, i)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def sizes(rows):
    return [len(W.findall(r[1] or "")) for r in rows]


def test_mix(docs, rows, no_docs):
    from verisift.llm.mixing import mix

    got = mix(docs).collect()
    assert len(got) == len(rows) and mix(no_docs).count() == 0
    per = Counter()
    for r, n in zip(rows, sizes(rows)):
        per[r[3]] += n
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(per.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * per[s] for s in full)
        target = {s: 3 * per[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * per[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    ids = {r[0]: r for r in rows}
    twice = {i for i, n in Counter(r[0] for r in rows).items() if n > 1}
    for g in got:
        source = ids[g.doc_id][3] if g.doc_id is not None else None
        if g.doc_id not in twice:
            assert g.size == len(W.findall(ids[g.doc_id][1] or "")) and g.source_size == per[source]
            assert g.target == pytest.approx(target[source])
            assert g.taken <= 3 * g.size and g.taken % max(g.size, 1) == 0
            taken[source] += g.taken
    for s in names[:-1]:
        unsure = sum(3 * n for n, r in zip(sizes(rows), rows) if r[3] == s and r[0] in twice)
        assert abs(taken[s] - target[s]) <= max(x for x, r in zip(sizes(rows), rows) if r[3] == s) + unsure
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) == sorted(map(str, mix(docs, few_sources=0).collect()))  # the way beyond a broadcast
    kept = mix(docs, keep=True)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(g.doc_id for g in got for _ in range(g.copies))


def removed(rows, k):
    first = {}
    for r in rows:
        w = W.findall(r[1] or "")
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, LAST), place(r[0]))
    out = []
    for r in rows:
        w, gone = W.findall(r[1] or ""), set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < place(r[0]):
                gone.update(range(j, j + k))
        out.append((r[0], len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


@pytest.mark.parametrize("k,batches", [(50, 2), (5, 3), (1, 1)])
def test_substrings(docs, rows, k, batches):
    from verisift.llm.substrings import remove_repeats

    assert sorted(map(tuple, remove_repeats(docs, k, batches=batches).collect()), key=str) == sorted(removed(rows, k), key=str)


def test_substrings_repeated_and_empty(spark, docs, rows, no_docs):
    from verisift.llm.substrings import WindowIndex, remove_repeats, window_rows

    assert remove_repeats(no_docs).count() == 0
    assert sorted(map(tuple, remove_repeats(docs, 20, filter_keys=7).collect()), key=str) == sorted(removed(rows, 20), key=str)  # many shards
    twice = docs.unionAll(docs)
    assert sorted(map(tuple, remove_repeats(twice, 20).collect()), key=str) == sorted(removed(rows, 20) * 2, key=str)
    # an index that is filled batch by batch and compacted finds what a single pass finds
    source = docs.selectExpr("coalesce(text, '') AS t", "doc_id AS i")
    index = WindowIndex(spark, buckets=3, fanout=2)
    hits = 0
    for part in ("i <= 60", "i > 60 AND i <= 120", "i > 120", "i IS NULL"):
        windows = window_rows(source.where(part), 20)
        hits += index.repeats(windows).count()
        index.append(windows)
        index.compact()
    windows = window_rows(source, 20)
    whole = WindowIndex(spark, buckets=3)
    assert hits == whole.repeats(windows).count() > 0
    assert len(index.runs) == 1 and index.runs[0][0] == 2 and index.history().groupBy("g1", "g2").count().count() == windows.select("g1", "g2").distinct().count()
    index.drop()


def test_deduplicated_texts(spark, docs, rows):
    from verisift.llm.substrings import WindowIndex, deduplicated

    out = deduplicated(docs, 5, batches=3)
    want = removed(rows, 5)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, sha(" ".join(W.findall(r.text or "")))) for r in out.collect()) == sorted((w[0] is None, w[0], w[3]) for w in want)
    # with an index that is kept, a later table loses what an earlier one has
    index = WindowIndex(spark, buckets=3)
    first, later = docs.where("doc_id < 90"), docs.where("doc_id >= 90 OR doc_id IS NULL")
    parts = [r for part in (first, later) for r in deduplicated(part, 5, batches=2, index=index).collect()]
    assert sorted((r.doc_id is None, r.doc_id, sha(" ".join(W.findall(r.text or "")))) for r in parts) == sorted((w[0] is None, w[0], w[3]) for w in want)
    index.drop()


def test_texts_that_cancel_in_polynomials(spark):
    """Different texts of two words, or of two letters, are not taken for the same."""
    import math

    from conftest import cancelling

    from verisift.llm.jaccard import near_components
    from verisift.llm.pieces import digests
    from verisift.llm.ppm import score
    from verisift.llm.substrings import remove_repeats

    texts = [*cancelling(4096, "a", "b", " "), *cancelling(2048, "a", "b", ""), *cancelling(1024, "x", "y", "")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t + " " + t) for i, t in enumerate(texts[2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, remove_repeats(docs, 50).collect())) == sorted(removed(rows, 50))
    assert sorted(map(tuple, near_components(docs).collect())) == sorted(near(rows, 3, 90))
    got = digests(docs).collect()
    assert all(g.lossless and g.decoded_sha256 == sha(rows_[g.doc_id]) for rows_ in [dict(rows)] for g in got)
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 5 != 1 for t in [*x.split(), "end"])
    for g in score(docs).collect():
        assert g.n_known == sum(train[t] > 0 for t in [*dict(rows)[g.doc_id].split(), "end"]) and math.isfinite(g.score)


def near(rows, k, percent):
    sets = []
    for r in rows:
        w = W.findall((r[1] or "").translate(LOWER))
        sets.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    ids = [place(r[0]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for x in range(len(rows)):
        least[find(x)] = min(least.get(find(x), LAST), ids[x])
    known = lambda x: None if x == LAST else x[1]
    return [(r[0], len(s), known(least[find(x)])) for x, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(docs, rows, no_docs, k, percent):
    from verisift.llm.jaccard import near_components, one_of_each

    assert sorted(map(tuple, near_components(docs, k, percent).collect()), key=str) == sorted(near(rows, k, percent), key=str)
    if k == 3:
        assert near_components(no_docs).count() == 0
        left = one_of_each(docs, k, percent)
        want = {r[0] for r in near(rows, k, percent) if r[0] is not None and r[0] == r[2]}
        assert left.columns == docs.columns and {r.doc_id for r in left.collect() if r.doc_id is not None} == want
        # crowded buckets are split by a second token, and different sets of one node told apart
        for how in ({"crowd": 1}, {"node_bits": 4}):
            assert sorted(map(tuple, near_components(docs, k, percent, **how).collect()), key=str) == sorted(near(rows, k, percent), key=str)


def test_components(spark):
    from verisift.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (300, 200), (200, 250), (250, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(docs, rows, no_docs):
    from verisift.llm.lines import drop_hot_lines

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count, first = Counter(), {}
    for r in rows:
        for x in {key(x) for x in (r[1] or "").split("\n")}:
            count[x] += 1
            first[x] = min(first.get(x, LAST), place(r[0]))
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 1 or count[key(x)] < 10]
        want.append((r[0], len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    assert sum(w[2] for w in want) >= 24
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert pick(drop_hot_lines(docs, digest=True)) == sorted(want, key=str)
    assert pick(drop_hot_lines(docs, digest=True, max_broadcast=0)) == sorted(want, key=str)  # the way beyond broadcasts
    assert pick(drop_hot_lines(docs, digest=True, log2_bits=20)) == sorted(want, key=str)  # a full filter
    assert drop_hot_lines(no_docs).count() == 0
    kept = drop_hot_lines(docs, keep_first=True)
    assert set(kept.columns) == {*docs.columns, "n_lines", "n_dropped"}
    ids = [r.doc_id for r in kept.collect() if "common line" in (r.text or "").lower()]
    assert ids == [first["common line"][1]]
    same = drop_hot_lines(docs, counts=False)
    assert same.columns == docs.columns and sorted((r.doc_id is None, r.doc_id, sha(r.text)) for r in same.collect()) == sorted((w[0] is None, w[0], w[3]) for w in want)


def test_rules(spark, docs, rows, no_docs):
    import math
    from fractions import Fraction

    from verisift.llm.rules import RULES, _at_most, _upper_bound, base_failed, cutoffs, judge, measures

    want = []
    for r in rows:
        t, w = r[1] or "", W.findall(r[1] or "")
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        count, cover = Counter(grams), set()
        for j, g in enumerate(grams):
            if count[g] > 1:
                cover.update(range(j, j + 5))
        lines = [x for x in t.split("\n") if W.search(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)))
    m = measures(docs)
    assert sorted(map(tuple, m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str) == sorted(want, key=str)
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert m.select(judge(m, labels).alias("v")).where("v").count() == len(rows)  # too few labels: no rule
    empty = measures(no_docs)
    assert empty.select(judge(empty, labels).alias("v"), base_failed()).count() == 0
    # the exact bound: at most k of n have probability `error` at it
    assert _upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert _upper_bound(5, 5, 0.05) == 1.0
    for k, n in ((3, 50), (0, 7), (40, 3000), (999, 1000)):
        for p in (0.001, 0.02, 0.4, 0.97):
            assert _at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)), rel=1e-9, abs=1e-13)
    assert _at_most(20_000_000, 10**9, 0.02) == pytest.approx(0.5, abs=1e-3)
    # symbols of bad documents are told apart; one good stratum has bad luck and keeps more
    data = []
    for j in range(6000):
        good, stratum = int(j % 4 > 0), "x" if j % 3 else "y"
        share = 300 if not good else 250 if stratum == "y" and j % 9 == 0 else 10
        data.append((stratum, good, j // 4 % 2 == 0, *[share if rule == "symbols" else 0 for rule in RULES]))
    found = cutoffs(spark.createDataFrame(data, "stratum string, good int, holdout boolean, " + ", ".join(f"{r} int" for r in RULES)))
    assert 10 <= found["x"]["symbols"] < 300 and 250 <= found["y"]["symbols"] < 300 and found[None] == {}


def test_rules_by_own_labels_only(spark):
    """Strata with few labels, none or no name have no rules, and no number of strata is too large."""
    from verisift.llm.rules import MEASURES, RULES, cutoffs, judge

    data = []
    for s in range(90):
        for j in range(1200 if s < 70 else 100):
            good = int(j % 8 > 0)
            data.append((f"s{s}", good, j // 8 % 2 == 0, *[300 * (1 - good) if rule == "symbols" else 0 for rule in RULES]))
    found = cutoffs(spark.createDataFrame(data, "stratum string, good int, holdout boolean, " + ", ".join(f"{r} int" for r in RULES)))
    assert set(found) == {None, *[f"s{s}" for s in range(70)]} and all(c.get("symbols", 1000) < 300 for s, c in found.items() if s)
    # one language has labels; documents of others that look like its bad ones stay
    names = [x.split()[0] for x in MEASURES.split(", ")]
    row = lambda i, lang, n: (i, lang, *[{"n_words": 100, "word_chars": 500, "n_symbols": n, "n_lines": 10}.get(x, 0) for x in names])
    rows = [row(i, "en", 0 if i % 4 else 250) for i in range(4000)]
    rows += [row(4000 + i, "few", 0 if i % 4 else 250) for i in range(100)]
    rows += [row(5000, None, 250), row(5001, "none", 250), row(5002, "en", 250), row(5003, "en", 0)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(4100)], "doc_id long, quality int")
    measured = spark.createDataFrame(rows, f"doc_id long, lang string, {MEASURES}")
    kept = {r.doc_id for r in measured.where(judge(measured, labels)).select("doc_id").collect()}
    assert kept == {i for i in range(4000) if i % 4} | set(range(4000, 4100)) | {5000, 5001, 5003}


def test_rules_on_planted_labels(spark):
    """What the query keeps, with certified cutoffs, against a plain version: exact binomial sums, cutoffs by search."""
    import math
    import random
    from fractions import Fraction

    from verisift.llm import rules as m

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(300)]

    def text(good):
        w = [rng.choice(words) for _ in range(rng.randint(12, 30))]
        for j in range(len(w)):
            if rng.random() < (0.01 if good else 0.3):
                w[j] += rng.choice(["###", "$$", "&*"])
            elif rng.random() < (0.02 if good else 0.2):
                w[j] = w[j].upper()
        return " ".join(w)

    rows, labels = [], []
    for i in range(9000):
        lang, good = ("en", "de", "xx", None)[0 if i % 10 < 5 else 1 if i % 10 < 8 else 2 if i % 10 < 9 else 3], int(rng.random() < 0.7)
        rows.append((i, text(good), lang))
        if lang != "xx" or i % 30 == 8:
            labels.append((i, good, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    risk, error, min_good, gain, steps = 0.02, 0.05, 250, 5.0, 6

    def shares(t):
        w = W.findall(t)
        n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
        lines = [x for x in t.split("\n") if x.strip()]
        upper, bars = sum(c.isascii() and c.isupper() for c in t), t.count("|")
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {x for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for x in range(j, j + 5)}
        raw = (sum(c in "#*$%&|<>" for c in t) / chars, (len(lines) - len(set(lines))) / max(len(lines), 1), len(cover) / n, upper / chars, bars / n, chars / n / 100, 1 / (len(w) + 1))
        return [min(math.floor(x * 1000), 1000) for x in raw], len(w) < 10 or 100 * len(cover) > 20 * len(w)

    measured = {i: (*shares(t), lang) for i, t, lang in rows}
    parts = {}
    for i, good, _ in labels:
        share, _, lang = measured[i]
        if lang is not None:
            held = int(hashlib.md5(f"h{i}".encode()).hexdigest()[:8], 16) % 2 == 0
            parts.setdefault(lang, {(h, g): [] for h in (True, False) for g in (0, 1)})[held, good].append(share)
    cuts, strata = {}, [s for s, p in parts.items() if len(p[True, 1]) >= min_good]
    for s in strata:
        tune, good = parts[s], parts[s][True, 1]
        path = []
        for rule in range(7):
            steps_of, last = [], 1000
            for rate in [0.0, *[risk / 2 ** (steps - 2 - j) for j in range(steps - 1)]]:
                for cut in range(1001):
                    hit = sum(x[rule] > cut for x in tune[False, 0]) / max(len(tune[False, 0]), 1)
                    miss = sum(x[rule] > cut for x in tune[False, 1]) / max(len(tune[False, 1]), 1)
                    if hit >= 0.005 and hit >= gain * miss and miss <= rate:
                        last = min(last, cut)
                        break
                steps_of.append(last)
            path.append(steps_of)
        passed = None
        for j in range(steps):
            lost = sum(any(x[r] > path[r][j] for r in range(7)) for x in good)
            p = Fraction(risk)
            if sum(math.comb(len(good), i) * p**i * (1 - p) ** (len(good) - i) for i in range(lost + 1)) > error / len(strata):
                break
            passed = [c[j] for c in path]
        cuts[s] = passed
    assert strata == ["en", "de"] and all(cuts[s] for s in strata)
    want = {i: not failed and all(x <= c for x, c in zip(share, cuts.get(lang) or [1000] * 7)) for i, (share, failed, lang) in measured.items()}
    got = m.measures(docs)
    got = {r.doc_id: r.k for r in got.select("doc_id", (~m.base_failed() & m.judge(got, lab)).alias("k")).collect()}
    assert got == want and 1500 < sum(not k for k in want.values()) < 2600
    assert {r.doc_id for r in m.passing(docs, lab).select("doc_id").collect()} == {i for i, k in want.items() if k}


def test_fingerprints(spark, docs, rows, no_docs):
    from verisift.llm.syncmers import K, S, edited_pairs, with_anchors

    got = edited_pairs(docs).collect()
    known = sorted((r for r in rows if r[0] is not None and r[0] < 2**63 - 1), key=lambda r: -r[0])
    by_id = {g.doc_id: g for g in got if g.doc_id is not None}
    assert len(got) == len(rows)
    for r, nxt in zip(known, known[1:]):
        t, n = r[1] or "", len(r[1] or "") // 3
        assert by_id[r[0]].edited_sha256 == sha(t[: len(t) - n] + (nxt[1] or "")[:n]) and by_id[r[0]].n_chars == len(t)
    prints = {}
    for r in known:
        assert prints.setdefault(r[1] or "", by_id[r[0]].fingerprint) == by_id[r[0]].fingerprint
    for g in got:
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert edited_pairs(no_docs).count() == 0
    lone = edited_pairs(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == sha("abc dab")
    # closed syncmers by their definition
    text = " ".join(f"w{i * i % 97}" for i in range(300))
    row = with_anchors(spark.createDataFrame([(text,)], "text string"), "text", "a", "p").selectExpr("*").first()
    tokens = spark.createDataFrame([(w,) for w in text.split()], "w string").selectExpr("xxhash64(w) AS h").collect()
    from verisift.llm.syncmers import inner_hashes, token_hashes

    import pyspark.sql.functions as F

    inner = spark.createDataFrame([(text,)], "text string").select(token_hashes(F.col("text")).alias("t")).select("t", inner_hashes("t").alias("s")).first()
    assert [x.h for x in tokens] == inner.t[K - 1 : -(K - 1)]
    width = K - S + 1
    places = [i for i in range(len(inner.s) - width + 1) if min(inner.s[i : i + width]) in (inner.s[i], inner.s[i + width - 1])]
    assert places == row.p and len(row.a) == len(places)


def test_fingerprints_by_hand(docs, rows):
    """Fingerprints and likenesses of all documents against a plain version with the library's hash."""
    import xxhash

    from verisift.llm.syncmers import _ALONE, K, S, edited_pairs

    spread = {"\\x{20000}-\\x{3FFFF}": "\U00020000-\U0003FFFF"}
    alone = _ALONE
    for a, b in spread.items():
        alone = alone.replace(a, b)
    token = re.compile(rf"[^\x20\x09-\x0D{alone}]{{1,24}}|[{alone}]")

    def of_text(w):
        return xxhash.xxh64_intdigest(w.encode(), 42)

    def of_many(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return seed

    signed = lambda x: x - 2**64 if x >> 63 else x

    def anchors(text):
        tokens = [of_text(w) for w in token.findall(text)]
        if not tokens:
            return []
        tokens = [of_text(f"<{i}") for i in range(K - 1)] + tokens + [of_text(f">{i}") for i in range(K - 1)]
        inner = [of_many(tokens[i : i + S]) for i in range(len(tokens) - S + 1)]
        out = []
        for p in range(len(tokens) - K + 1):
            window = [signed(x) for x in inner[p : p + K - S + 1]]
            if min(window) in (window[0], window[-1]):
                out.append(of_many([inner[p + j] for j in range(0, K - S + 1, S)]) >> 32)
        return out

    like = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    key = lambda t: signed(of_text(t))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key(r[1] or "")))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", nxt[1] or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = anchors(t), anchors(e), anchors(u)
        hexes = lambda x: "".join(f"{v:08x}" for v in x)
        want.append((r[0], len(t), sha(e), hexes(a), hexes(b), like(a, b), like(a, c)))
    got = [tuple(g) for g in edited_pairs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprint_ranges(spark):
    from verisift.llm.syncmers import edited_pairs

    ids = [i * i for i in range(900)] + [2**40 + i for i in range(300)] + [-5, -(2**62)]
    df = spark.createDataFrame([(i, f"text{i} " * 3) for i in ids] + [(None, f"n{i} b c") for i in range(700)], "doc_id long, text string")
    got = {r.doc_id: r for r in edited_pairs(df).where("doc_id IS NOT NULL").collect()}
    order = sorted(ids, reverse=True)
    for a, b in zip(order, order[1:]):
        t, n = f"text{a} " * 3, len(f"text{a} " * 3) // 3
        assert got[a].edited_sha256 == sha(t[: len(t) - n] + (f"text{b} " * 3)[:n]), (a, b)


def test_fingerprints_of_one_id(spark):
    """Ids that hold most rows are cut into parts, and each row still has its own next one."""
    from verisift.llm.syncmers import with_next

    import pyspark.sql.functions as F
    from pyspark.sql import Window

    rows = [(7 if i % 3 else i, f"text {i} of some") for i in range(9000)] + [(None, f"null {i}") for i in range(50)]
    got = with_next(spark.createDataFrame(rows, "doc_id long, t string"), per_range=64)
    order = Window.partitionBy("bucket", "part").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    after = {r.t: r.after for r in got.withColumn("after", F.lead("t").over(order)).where("NOT guest").collect()}
    own = got.where("NOT guest").select("doc_id", "t", "h").collect()
    want = [r.t for r in sorted(own, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    assert all(after[a] == b for a, b in zip(want, want[1:] + want[:1]))
    assert got.groupBy("bucket", "part").count().agg(F.max("count")).first()[0] < 900


def test_pieces(spark, docs, rows, no_docs):
    from verisift.llm.pieces import Codec, decode, digests, encode, vocabulary

    import numpy as np

    got = digests(docs).collect()
    assert len(got) == len(rows) and all(g.lossless for g in got) and digests(no_docs).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, digests(docs.repartition(5)).collect()))
    hard = ["", None, "▁", " ▁▁ x", "  a  b \n\n\t", "\x00\x01", "日本語 텍스트 🎉🏽", "a" * 500, "▁▁▁", "  ", " " * 70]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(hard)], "doc_id long, text string")
    rows_ = encode(df).orderBy("doc_id").collect()
    back = decode(encode(df)).orderBy("doc_id").collect()
    assert [b.text for b in back] == [x or "" for x in hard]
    vocab = vocabulary()
    codec = Codec(vocab)
    # a long segment is filtered by itself and has the same pieces
    import verisift.llm.pieces as m

    seeds = np.arange(len(hard), dtype=np.uint64)
    short = codec.encode([x or "" for x in hard], seeds)
    was, m.LONG, block, m.BLOCK = m.LONG, 4, m.BLOCK, 16
    try:
        long = codec.encode([x or "" for x in hard], seeds)
    finally:
        m.LONG, m.BLOCK = was, block
    assert short[0].tolist() == long[0].tolist() and short[1].tolist() == long[1].tolist()
    assert all(0 <= p < vocab["size"] for r in rows_ for p in r.pieces)
    # sampled segmentations have the lattice's probabilities
    weight = {p: -np.log(i) for i, p in vocab["pieces"]}
    word = "▁then"

    def ways(at):
        if at == len(word):
            return [((), 0.0)]
        return [((word[at:end], *rest), weight[word[at:end]] + w) for end in range(at + 1, len(word) + 1) if word[at:end] in weight for rest, w in ways(end)]

    every = {k: np.exp(w) for k, w in ways(0)}
    total, n = sum(every.values()), 40_000
    ids, offsets = codec.encode(["then"] * n, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    name = dict(vocab["pieces"])
    seen = Counter(tuple(name[i] for i in ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
    assert set(seen) <= set(every)
    for k, w in every.items():
        p = w / total
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


class Ppm:
    """Prediction by partial matching as it is told, one byte at a time."""

    def __init__(self, streams, order):
        self.order, self.count = order, {}
        for s in streams:
            for j in range(order, len(s)):
                for k in range(order + 1):
                    self.count.setdefault(s[j - k : j], Counter())[s[j]] += 1

    def p(self, context, byte):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = {b: n for b, n in self.count.get(context[len(context) - k :], {}).items() if b not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                return out * seen[byte] / total
            out *= len(seen) / total
            excluded |= set(seen)
        return out / (256 - len(excluded))


@pytest.mark.parametrize("order,nodes", [(3, 10**6), (5, 800)])
def test_ppm(docs, rows, no_docs, order, nodes):
    import math

    from verisift.llm.ppm import score

    plain = lambda t: " ".join(W.findall((t or "").translate(LOWER))).encode()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    pad = b"\n" * order
    model = Ppm([pad + plain(r[1]) + b"\n" for r in rows if not held(r[0])], order)
    words = Counter()
    for r in rows:
        if not held(r[0]):
            words.update([*plain(r[1]).split(b" "), "end"] if plain(r[1]) else ["end"])
    n, v = sum(words.values()), len(words)
    got = score(docs, order=order, max_nodes=nodes, max_words=10**6 if nodes > 800 else 150).collect()
    assert len(got) == len(rows)
    mine = {g.doc_id: g for g in got if g.doc_id is not None}
    for r in rows:
        if r[0] is None or r[0] == 2**63 - 1 or len(r[1] or "") > 30_000:
            continue
        g, s = mine[r[0]], pad + plain(r[1]) + b"\n"
        tokens = [*(plain(r[1]).split(b" ") if plain(r[1]) else []), "end"]
        assert (g.held_out, g.n_tokens, g.train_tokens, g.n_known) == (held(r[0]), len(tokens), n, sum(words[t] > 0 for t in tokens))
        assert g.base_score == pytest.approx(sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel=1e-6)
        assert g.score == pytest.approx(sum(math.log10(model.p(s[j - order : j], s[j])) for j in range(order, len(s))), rel=1e-4)
    assert abs(sum(model.p(b"abcde"[:order], b) for b in range(256)) - 1) < 1e-9
    assert score(no_docs).count() == 0
