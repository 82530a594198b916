"""Scalar text functions on planted values, against small restatements of their rules."""

import re

import pyspark.sql.functions as F
import pytest

from verisift.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def test_decimals(spark):
    got = column(spark, ["a 12.3, 12.30 and 12.3; v1.2 x.5 1.2.3 12345.6 7.", None, "", "0.5"], T.decimals)
    assert got == [["12.3", "12.30", "1.2"], [], [], ["0.5"]]
    assert column(spark, ["v1.2 e9.5 3.4"], T.source_decimals) == [["1.2", "9.5", "3.4"]]


def test_thousands(spark):
    assert column(spark, ["19,559 1,234,567 1,23 12,3456 a"], T.flat_thousands) == ["19559 1234567 1,23 12,3456 a"]
    assert column(spark, ["19,559 and 7 and 42"], T.integers) == [["19559", "42"]]


def test_sentences(spark):
    text = "We saw it, e.g. here. So it is!  Dr. Who came? Yes"
    assert column(spark, [text, "", None], T.sentences) == [["We saw it, e.g. here.", "So it is!", "Dr. Who came?", "Yes"], [], None]


def test_words(spark):
    assert column(spark, ["The well-known The CAT sat downtown"], T.alpha_words) == [["well-known", "downtown"]]
    assert column(spark, ["A b2 Ä c"], T.word_run) == [["a", "b2", "c"]]
    assert column(spark, [["a", "b", "c"], ["a"], []], lambda c: T.shingles(c, 2), "array<string>") == [["a b", "b c"], [], []]
    assert column(spark, ["\n  \n Title \n x", "", "\n"], T.first_line) == ["Title", "", ""]


@pytest.mark.parametrize("word,stem", [("families", "fami"), ("parties", "party"), ("comparably", "comparabl"), ("existence", "exist"), ("irrigated", "irrigat"), ("irrigate", "irrigat"), ("per-bed", "perb"), ("Tokens", "token"), ("the", "the")])
def test_folded(spark, word, stem):
    assert column(spark, [word], T.folded) == [stem]


def int_words(n):
    if n < 100:
        return 1
    if n < 1000:
        return 3
    if 1000 <= n <= 2099 and n % 100:
        return 2
    if n < 10000 and n % 100 == 0 and n % 1000:
        return 2
    unit = next(u for u in (10**9, 10**6, 10**3) if n >= u)
    return int_words(n // unit) + 1 + (int_words(n % unit) if n % unit else 0)


def test_integer_words(spark):
    values = [0, 7, 99, 100, 505, 1000, 1500, 1916, 2000, 2099, 2100, 3000, 3005, 9900, 10000, 19559, 203000, 1_001_916, 12_345_678, 999_999_999_999, 5_000_000_100]
    assert column(spark, values, T.integer_words, "long") == [int_words(v) for v in values]


def test_cells(spark):
    values = ["1,234", "−3.5", "12k", "2 million", "3e2", "5%", "n/a", None, "7 G", "abc", "1.5×10^3"]
    assert column(spark, values, T.cell_number) == [1234.0, -3.5, 12000.0, 2e6, 300.0, 5.0, None, None, 7e9, None, 1500.0]
    assert column(spark, ["", " - ", "n/a", None, "0"], T.is_blank) == [True, True, True, True, False]


def test_spoken(spark):
    assert column(spark, ["up 5% ± 2", None], T.spoken_words) == [3.0 + 1 + 3, 0.0]
    assert column(spark, [0, 59, 60, 699], T.clock, "long") == ["0:00", "0:59", "1:00", "11:39"]
    assert column(spark, ["안녕 abc 漢"], T.syllables) == [3]


def test_whole_word(spark):
    p = re.compile(T.whole_word("may|up to"))
    for s in ("it may be", "Up to ten", "maybe", "dismay", "may"):
        assert column(spark, [s], lambda c: c.rlike(T.whole_word("may|up to"))) == [bool(p.search(s))]


def plain_words(text, table=None):
    """The rules of spoken_words token by token."""
    table, n = table or {}, 0.0
    n += sum(1 for i, c in enumerate(text) if c in "-−" and text[i + 1 : i + 2].isdigit() and not (i and (text[i - 1].isalnum() or text[i - 1] in "_.")))
    n += sum(1 for c in text if "Α" <= c <= "Ω" or "α" <= c <= "ω") + sum(k * text.count(c) for c, k in T.SYMBOL_WORDS.items())

    def number(x):
        whole, _, rest = x.partition(".")
        return int_words(int(whole)) + (1 + len(rest) if rest else 0)

    for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9'’.\-]*", text):
        core = m.group().strip(".")
        units = [core] if core in table else [u for u in (re.sub(r"^[.'’]+", "", x).strip(".") for x in core.split("-")) if u]
        for u in units:
            unit = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)([A-Za-z]{1,3})", u)
            if re.fullmatch(r"[0-9]+(\.[0-9]+)?", u):
                n += number(u)
            elif u in table:
                n += table[u]
            elif unit:
                n += number(unit[1]) + (0 if unit[2].lower() in ("st", "nd", "rd", "th") else table.get(unit[2], 1))
            else:
                n += 1
    return n


SAID = [
    "-12.3 dB", "it's -5 and x-5, 3−4", "8.65M at 350GB, 175B", "the 1st, 22nd and 3RD", "ISO-8601 and GPU-days", "ZZTOP runs", "12.5", "203000 of 19559", "Δ T ≤ 5%", "", "…", "a.b.c 1.2.3",
    "12345678901234567890", "1000000000000 and 000", "x-.5-'y'", "don’t re-use e.g. U.S.", "1e5 5kHz 7abcd", "−−3", "é-5", "2099 2100 1500",
]


@pytest.mark.parametrize("table", [None, {"ZZTOP": 5.0, "GB": 2.0, "ISO-8601": 6.0, "GPU": 0.5}])
def test_spoken_words_against_plain(spark, table):
    acronyms = None if table is None else F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    assert column(spark, SAID, lambda c: T.spoken_words(c, acronyms)) == [plain_words(x, table) for x in SAID]


def test_spoken_words_of_long_runs(spark):
    """The stripping of dots took the square of a run's length; digits were read over and over."""
    said = ["a" + "." * 300000 + "x", "12" + "." * 300000 + "5", "1" * 9000 + "'", "9-" * 5000, "12.5th " * 5000]
    assert column(spark, said, T.spoken_words) == [1.0, 1.0, 1.0, 5000.0, 15000.0]


@pytest.mark.parametrize("table", [{"5GB": 7.0, "ab": 0.0, "gb": 2.0, "12M": 5.0, "5": 9.0}, {"ISO-5GB": 1.5, "GPU-days": 4.0, "GB": 3.0, "7th": 2.5, "th": 6.0, "ISO": 0.5}])
def test_spoken_words_where_the_table_has_numbers(spark, table):
    said = [*SAID, "ISO-5GB, ISO-5gb. GPU-days-5GB 7th 8th 8TH 5sth 12.5M 12M-5 ab-5 5 5. 5.5GB... 123456GB 7nd. 5stxrd 5sthrd 5Mth 5thM"]
    acronyms = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    assert column(spark, said, lambda c: T.spoken_words(c, acronyms)) == [plain_words(x, table) for x in said]


def test_spoken_words_of_all_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("text", T.spoken_words("text").alias("n")).collect()
    assert len(rows) > 500 and all(r.n == plain_words(r.text or "") for r in rows)


def test_thousands(spark):
    values = ["7,900,123,456", "203 000", r"203\,000", "19\u2009559", "1\u202f234\u202f567", "1,2345", "Table 2 150", "12 345 678", "3.12 345", "12 345.6", "1234,567", "a 1,000, 2,000", "555 1234", None]
    want = ["7900123456", "203000", "203000", "19559", "1234567", "1,2345", "Table 2 150", "12345678", "3.12 345", "12 345.6", "1234567", "a 1000, 2000", "555 1234", None]
    assert column(spark, values, T.flat_thousands) == want
    assert column(spark, ["203 000 and 7,900,123,456"], T.integers) == [["203000", "7900123456"]]


def test_neighbours_do_not_hide_each_other(spark):
    from verisift.operators import provenance as P

    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r) for r in P.claims(df("3.14/3.14"), [("pi", "3.14")]).collect()] == [("pi", "3.14", 2, False)]
    assert [r.n for r in P.banned(df("worthless worthless worthless"), ["worthless"]).collect()] == [3]
    assert column(spark, ["1.5 2.5/3.5"], T.decimals) == [["1.5", "2.5", "3.5"]]


def test_banned_places(spark):
    from verisift.operators import provenance as P

    text = "Utterly worthless.\n\nNot worthless, never worthless; it isn't worthless. Worthless worthless\tand more " + "x" * 60
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing"), (4, "always\n\nalways it")], "doc_id long, text string")
    lines = ["worthless", "re:^always", "re:CLOWNS?"]
    got = [tuple(r) for r in P.banned_places(df, lines).collect()]
    want = []
    for i, t in ((1, text), (4, "always\n\nalways it")):
        for line, p in (("worthless", r"(?i)(?<!\bnot\s)(?<!\bnever\s)(?<!n't\s)\bworthless(?:e|es|s|ed|d|ing|en|n)?\b"), ("re:^always", r"(?:^|(?<=\n\n))always")):
            want += [(i, line, m.start(), re.sub(r"\s+", " ", t[max(0, m.start() - 55) : m.end() + 35]).strip()) for m in re.finditer(p, t)]
    assert sorted(got) == sorted(want) and len(got) == 5
    assert {(r.doc_id, r.pattern, r.n) for r in P.banned(df, lines).collect()} == {(1, "worthless", 3), (4, "re:^always", 2)}
