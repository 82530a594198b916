"""Checks that are checked themselves: a canary is planted for each section, and its count must rise."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

_PARSE, _C = re._parser.parse, re._constants  # the library's own reader of patterns

#: signs that are tried where a pattern only says what a sign is not
SIGNS = "ax1 .-_Z,"


def _sign(kinds: list) -> str:
    """A sign that a class of a pattern allows."""

    def holds(c: str) -> bool:
        for op, of in kinds:
            if op is _C.LITERAL and ord(c) == of or op is _C.RANGE and of[0] <= ord(c) <= of[1]:
                return True
            if op is _C.CATEGORY:
                name = str(of).rsplit("_", 1)[-1].lower()
                test = {"digit": str.isdigit, "space": str.isspace, "word": lambda x: x.isalnum() or x == "_"}[name](c)
                if test != ("NOT_" in str(of)):
                    return True
        return False

    turned = kinds[0][0] is _C.NEGATE
    named = [chr(of if op is _C.LITERAL else of[0]) for op, of in kinds if op in (_C.LITERAL, _C.RANGE)]
    tried = SIGNS if turned else [*named, *SIGNS]
    return next((c for c in tried if holds(c) != turned), "")


def _write(tree, groups: dict[int, str]) -> str:
    out = ""
    for op, of in tree:
        if op is _C.LITERAL:
            out += chr(of)
        elif op is _C.NOT_LITERAL:
            out += next(c for c in SIGNS if ord(c) != of)
        elif op is _C.ANY:
            out += "a"
        elif op is _C.IN:
            out += _sign(of)
        elif op is _C.BRANCH:
            out += _write(of[1][0], groups)
        elif op is _C.SUBPATTERN:
            text = _write(of[-1], groups)
            groups[of[0]] = text
            out += text
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT, _C.POSSESSIVE_REPEAT):
            out += "".join(_write(of[2], groups) for _ in range(of[0]))
        elif op is _C.ATOMIC_GROUP:
            out += _write(of, groups)
        elif op is _C.GROUPREF:
            out += groups.get(of, "")
        # places and assertions take no signs
    return out


def example(pattern: str) -> str | None:
    """A short text that a pattern finds, from its syntax tree: first alternatives, least repeats; None where that text
    does not satisfy what the pattern asserts around it."""
    text = _write(_PARSE(pattern), {})
    for candidate in (text, f" {text} ", f"{text} ", f" {text}"):
        if re.search(pattern, candidate):
            return candidate
    return None


def mutation_counts(texts: DataFrame, sections: dict[str, tuple[str, Callable[[Column], Column]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(mutant, section, n_texts, before, after): what each section counts in texts before and after a canary is planted.

    Sections are (canary, count of a text). Each text gets the canary of one section, by its key, behind a blank line; one
    pass counts all sections on both forms. A section works if its own mutant's count rises; `silent` sections do not."""
    names = sorted(sections)
    mutant = F.pmod(F.col(key).cast("long"), F.lit(len(names))).cast("int")
    rows = texts.where(F.col(key).isNotNull()).select(mutant.alias("m"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("u", F.concat("t", F.lit("\n\n"), F.get(F.array(*[F.lit(sections[n][0]) for n in names]), F.col("m"))))
    counts = rows.groupBy("m").agg(F.count("*").alias("n_texts"), *[F.sum(F.coalesce(sections[n][1](F.col(c)), F.lit(0)).cast("long")).alias(f"{c}{i}") for i, n in enumerate(names) for c in "tu"])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(f"t{i}").alias("before"), F.col(f"u{i}").alias("after")) for i, n in enumerate(names)]))
    return counts.select(F.get(F.array(*map(F.lit, names)), F.col("m")).alias("mutant"), "n_texts", each.alias("s")).select("mutant", "s.section", "n_texts", "s.before", "s.after")


def silent(counts: DataFrame) -> DataFrame:
    """(section): sections whose own canary raised their count by less than one a text: checks that see nothing."""
    return counts.where("mutant = section AND after - before < n_texts").select("section")
