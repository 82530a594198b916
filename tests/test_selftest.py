"""Examples from patterns, and sections whose canaries must be seen."""

import re

import pytest
from pyspark.sql import functions as F

from verisift.operators import provenance as P, selftest as X

PATTERNS = [
    r"worthless(?:e|es)?", r"[0-9]{2,4}\.[0-9]+", r"(?i)up to [0-9]+ ?(?:%|x)", r"^Note: [^,]+", r"\bfoo\s+bar\b", r"(a|b)\1", r"[^a-z]x", r"\d\D\w\W\s\S", r"x{3}y*z+?", r"(?<![A-Za-z])No\.(?= )", r".", r"[\]\\-]", r"(?P<n>q+)(?P=n)", r"",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_examples_match(pattern):
    text = X.example(pattern)
    assert text is not None and re.search(pattern, text)


def test_no_example_for_what_cannot_be():
    assert X.example(r"a(?!a)(?=a)") is None


def test_canaries_are_seen_and_dead_sections_found(spark):
    docs = spark.createDataFrame([(i, "worthless text" if i == 4 else None if i == 7 else "plain text") for i in range(40)] + [(None, "no key")], "doc_id long, text string")
    count = lambda p: lambda c: F.regexp_count(c, F.lit(p))
    sections = {"ban": (X.example(P.inflected("worthless")), count(P.inflected("worthless"))), "leak": ("<hit>", count("</?hit>")), "dead": ("anything", count("never there")), "value": ("12.5", count(r"(?<![0-9.])12\.5(?![0-9])"))}
    got = {(r.mutant, r.section): (r.n_texts, r.before, r.after) for r in X.mutation_counts(docs, sections).collect()}
    assert len(got) == 16 and got["ban", "ban"] == (10, 1, 11) and got["leak", "leak"] == (10, 0, 10) and got["value", "ban"] == (10, 0, 0)
    assert sum(n for (m, s), (n, _, _) in got.items() if s == "ban") == 40
    assert [r.section for r in X.silent(X.mutation_counts(docs, sections)).collect()] == ["dead"]
