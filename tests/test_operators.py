"""Operators: clean input passes, the planted row is caught."""

import itertools
import random

import pyspark.sql.functions as F

from verisift.operators import geometry as G, profile, provenance as P, sequence as Q, similarity as S


def docs(spark, *texts, key="doc_id"):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_unsourced_and_dropped(spark):
    source = docs(spark, "We got 92.4 and 0.3 and v1.2.", "Also 1.4")
    assert rows(P.unsourced(docs(spark, "They got 92.4.", "as 1.2"), source)) == []
    assert rows(P.unsourced(docs(spark, "They got 77.7 and 92.40.", None), source)) == [(0, "77.7"), (0, "92.40")]
    assert rows(P.dropped(source, docs(spark, "92.4"))) == [("0.3",), ("1.4",)]
    assert rows(P.membership(docs(spark, "1.5 2.5"), docs(spark, "2.5 3.5"))) == [("1.5", "source only"), ("2.5", "both"), ("3.5", "derived only")]
    assert rows(P.unsourced_integers(docs(spark, "19,559 cases, 42 and 2024"), docs(spark, "19559 in x42"), skip=("2024",))) == []


def test_claims(spark):
    got = {r.label: (r.n_found, r.unique) for r in P.claims(docs(spark, "a 3.1 b 3.1", "c 4.2 13.1"), [("twice", "3.1"), ("once", "4.2"), ("never", "9.9")]).collect()}
    assert got == {"twice": (2, False), "once": (1, True), "never": (0, False)}


def test_banned(spark):
    df = docs(spark, "It proves all", "not proven", "It proved, proving", "state-of-the-art x", "an art", None)
    assert rows(P.banned(df, ["prove", "state-of-the-art"])) == [(0, "prove", 1), (2, "prove", 2), (3, "state-of-the-art", 1)]


def test_containment(spark):
    passage = "one two three four five six seven"
    got = rows(P.containment(docs(spark, "x " + passage + " y", "one two three four z five", "One, two; three four FIVE"), docs(spark, passage, key="item_id")))
    assert got == [(0, 0, 3, 7), (2, 0, 1, 5)]


def test_coined(spark):
    derived = docs(spark, "zorble zorble zorble tokens tokens tokens twice twice datasets datasets datasets well-known well-known well-known")
    assert rows(P.coined(derived, docs(spark, "a token of data sets that is well known"))) == [("zorble", 3)]


def test_quotes(spark):
    source = docs(spark, "He said that this is the very best of all worlds.", key="item_id")
    got = rows(P.quotes(docs(spark, 'As "this is the very best of" and “this is not the very best of”, "too short"', "none"), source))
    assert got == [(0, 2, 1)]


def test_arrived(spark):
    frags = docs(spark, "alpha beta gamma delta epsilon zeta eta", "short one", "never said at all in any text", key="item_id")
    assert rows(P.arrived(frags, docs(spark, "x Alpha, beta gamma delta epsilon zeta!", "a short one", "short, one"))) == [(0, 1), (1, 2), (2, 0)]


def test_upsert_and_leaks(spark):
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "tag string, line string")
    new = spark.createDataFrame([("a", "9")], "tag string, line string")
    assert rows(P.upsert_by_tag(old, new)) == [("a", "9"), ("b", "3")] == rows(P.upsert_by_tag(P.upsert_by_tag(old, new), new))
    assert rows(P.markup_leaks(docs(spark, "a ** b **", "ok"), "doc_id", "text", {"strong": r"\*\*"})) == [(0, "strong", 2)]


def test_similar_sets(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["b", "c", "d"],), (["x"],), (["x", "y", "z"],), ([],), (["c", "b", "a"],)], "words array<string>")
    assert rows(S.similar_sets(df)) == [("a b c", "b c d", 2, 4)]


def test_similar_sets_against_all_pairs(spark):
    # sets that share a rare word and else only frequent ones; every sixth is a near copy of the one before
    rng, words = random.Random(5), [f"w{i}" for i in range(60)]
    sets = []
    for i in range(240):
        sets.append(sorted({*sets[-1][3:], f"n{i}"}) if i % 6 == 5 else sorted({f"g{i % 10}", *rng.sample(words, rng.choice([3, 8, 19, 30]))}))
    df = spark.createDataFrame([(w,) for w in sets], "words array<string>")
    for num, den in ((1, 2), (2, 3), (4, 5)):
        want = {tuple(sorted((" ".join(a), " ".join(b)))) + (len({*a} & {*b}), len({*a} | {*b})) for a, b in itertools.combinations(sets, 2) if a != b and len({*a} & {*b}) * den >= len({*a} | {*b}) * num}
        got = S.similar_sets(df, num=num, den=den).collect()
        assert len(want) > 10 and len(got) == len(want) and set(map(tuple, got)) == want
    ids = df.select(F.hex(F.array_join("words", " ")).alias("id"), F.col("words").alias("s")).distinct()
    n_found = S.similar_sets(df).count()
    assert n_found <= S._candidates(ids, 1, 2).count() <= 3 * n_found  # sharing a rare word is not enough


def test_greedy(spark):
    left = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "b", "c"]), (1, 3, ["q"])], "g long, o long, w array<string>")
    right = spark.createDataFrame([(1, 5, ["a", "b", "c"]), (1, 6, ["a", "b"])], "g long, o long, w array<string>")
    assert rows(S.greedy_pairs(left, right, "g", "o", "w")) == [(1, 1, 6), (1, 2, 5), (1, 3, None)]


def test_best_support(spark):
    units = spark.createDataFrame([(1, 0, ["a", "b", "c", "d"]), (1, 1, ["a", "x", "y"])], "g long, no long, w array<string>")
    paper = spark.createDataFrame([(1, 10, ["a", "b", "c"]), (1, 11, ["b", "c", "d"]), (2, 12, ["a", "b", "c", "d"])], "g long, no long, w array<string>")
    assert rows(S.best_support(units, paper, "g")) == [(1, 0, 10, 3)]


def test_uncovered(spark):
    df = docs(spark, "The insulation reduces heat because walls retain warmth. Nothing here.", "Because metrics improve, models generalise somewhat better.")
    got = rows(S.uncovered(df, docs(spark, "insulation reduces heat walls retain warmth")))
    assert got == [(0, 1, 0), (1, 1, 1)]


def test_sequence(spark):
    ev = spark.createDataFrame([(1, 1, "v"), (1, 2, "e"), (1, 3, "v"), (2, 4, "e")], "u long, t long, k string")
    assert rows(ev.withColumn("a", Q.as_of(ev, F.col("k") == "v", "u", ["t"], "t")).select("t", "a")) == [(1, 1), (2, 1), (3, 3), (4, None)]
    assert rows(Q.gaps(spark.createDataFrame([(1, 0), (1, 3), (2, 1)], "g long, n long"), "g", "n")) == [(1, 1), (1, 2), (2, 0)]
    turns = spark.createDataFrame([(1, 0, "b"), (1, 1, "m"), (1, 2, "t")], "g long, n long, k string")
    got = rows(Q.renumbered(turns, "g", "n", F.col("k") == "b", F.col("k") == "m").select("n", "place", "page"))
    assert got == [(0, 3, None), (1, 1, 1), (2, 2, None)]


def test_profile(spark):
    df = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2)] + [("b", 7), ("b", None)], "g string, v long")
    assert rows(profile.upper_median_of(df, "g", "v")) == [("a", 3), ("b", 7)]
    assert rows(df.where("v IS NOT NULL").groupBy("g").agg(profile.upper_median(F.col("v")))) == [("a", 3), ("b", 7)]
    cells = spark.createDataFrame([("c", "1"), ("c", "2%"), ("c", "x"), ("c", " "), ("d", "1"), ("d", "y")], "col string, text string")
    assert rows(profile.numeric_columns(cells, ["col"], "text").select("col", "align")) == [("c", "right"), ("d", "left")]
    lab = spark.createDataFrame([("loss", "1.0", 1), ("loss", "2.0", 2), ("gain", "1.0", 1), ("gain", "1.0", 2)], "l string, v string, p long")
    assert rows(profile.contradictions(lab, "l", "v", "p")) == [("loss", 2, 2)]
    assert rows(profile.mode(lab, ["l"], "v")) == [("gain", "1.0", 2, 2), ("loss", "1.0", 1, 2)]
    assert rows(profile.roll_up([("x", lab), ("y", lab.where("p = 1"))])) == [("x", 4), ("y", 2), (None, 6)]


def test_geometry(spark):
    box = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 50.0, 50.0, 90.0, 90.0), (1, 3, 100.0, 0.0, 120.0, 20.0), (2, 4, 0.0, 0.0, 100.0, 100.0)], "page long, box long, x0 double, y0 double, x1 double, y1 double")
    assert rows(G.overlap_pairs(box)) == [(1, 1, 2, 1600.0)]  # touching is not overlapping
    one = spark.range(1).select(F.round(G.contrast(G.luminance(F.lit(255), F.lit(255), F.lit(255)), G.luminance(F.lit(0), F.lit(0), F.lit(0))), 6).alias("c"))
    assert one.first().c == 21.0


def test_canaries_raise_the_count(spark):
    """Each check must count more once a row it should catch is planted."""
    source = docs(spark, "The yield was 92.4 in all.")
    clean = docs(spark, "The yield was 92.4.")
    planted = docs(spark, "The yield was 92.4.", "The yield was 55.5 and utterly proven **bold**.")
    checks = {
        "unsourced": lambda d: P.unsourced(d, source),
        "banned": lambda d: P.banned(d, ["prove"]),
        "leaks": lambda d: P.markup_leaks(d, "doc_id", "text", {"strong": r"\*\*"}),
    }
    for check in checks.values():
        assert check(clean).count() == 0 < check(planted).count()


def test_fingerprint_duplicates(spark, tmp_path):
    """Vectors that differ in any component are no duplicates."""
    from verisift.plans.table_queries import fingerprint_duplicates

    base = [((i * 7) % 31 - 15) / 16 for i in range(64)]
    same, late = [x + 0.001 for x in base], base[:60] + [0.9] + base[61:]
    spark.createDataFrame([(1, base), (2, same), (3, late)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    (got,) = fingerprint_duplicates(spark, str(tmp_path)).collect()
    assert (len(got.print), got.n, got.first_id) == (64, 2, 1)


def test_arrived_in_every_way(spark):
    """As it is, by its first words, without spaces, by its words where there is mathematics; empty ones everywhere."""
    from verisift.operators.provenance import arrived

    bodies = ["The valve opens at dawn and closes at noon each day", "thevalveopensatdawnandclosesatnoon", "each noon the valve, then opens", "x", "β-decay rate over time grows"]
    fragments = {1: "valve opens", 2: "valve opens at dawn and closes at midnight", 3: "thevalve", 4: "", 5: "rate of √β decay grows", 6: "rate of beta decay grows", 7: "x", 8: "nothing like it"}
    words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
    want = {}
    for i, f in fragments.items():
        n, w = 0, words(f)
        for b in bodies:
            v, head = words(b), w[:6]
            plain = any(v[j : j + len(head)] == head for j in range(len(v)))
            n += not w or plain or "".join(head) in "".join(v) or ("√" in f and all(x in v for x in w if len(x) > 2 and x.isalpha()))
        want[i] = n
    got = arrived(spark.createDataFrame(list(fragments.items()), "item_id int, text string"), spark.createDataFrame([(b,) for b in bodies], "text string"))
    assert {r.item_id: r.n_arrived for r in got.collect()} == want and want[2] == 2 and want[5] == 1 and want[6] == 0
