import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, c0 string, i long, copies int, t string, n_lines long, n_dropped int, gone_id long, kept_sha256 string, taken long, row int, x long, node long"


EXTRA = (5, 6, "c", 7, 8, "t", 9, 1, 2, "k", 3, 4, 5, 6)  # columns of names that operators use themselves


def small_docs(seed: int = 7) -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, copies, near copies, shared lines and passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßxyz漢") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(70), prose(120).split(" ")
    texts = [None, "", " \t\n ", "one", "A b", "Word, WORD word", prose(4000), "x" * 3000, "\n".join(["same line"] * 30), "tab\tand\x0bvt \x0c ff\r\n end "]
    texts += [prose(rng.randint(5, 150)) for _ in range(30)]
    texts += [prose(20) + " " + passage + "\n" + prose(15) for _ in range(6)]
    for k in (1, 2, 3, 9, 20):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 4 + [" ".join(base).upper()]
    texts += ["  Common Line \n" + prose(8) + "\ncommon line\n" + prose(3) for _ in range(12)]
    rows = [(i * 3, x, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None, "a", "a"]), None if x is None else len(x), *EXTRA) for i, x in enumerate(texts)]
    rows.append((None, prose(60), None, None, None, *[None] * len(EXTRA)))
    rows.append((None, "null id", "en", "b", 7, *EXTRA))
    rows.append((2**63 - 1, prose(12) + " " + passage, "en", "b", 7, *EXTRA))
    rows.append((None, prose(9) + " " + passage + " " + prose(2), "en", "b", 7, *EXTRA))
    rows.append((None, " ".join(base), "en", "b", 7, *EXTRA))
    rows.append((2**63 - 1, rows[-3][1], "en", "a", 7, *EXTRA))
    rng.shuffle(rows)
    return rows


def cancelling(n: int, a: str, b: str, sep: str) -> tuple[str, str]:
    """Two texts of n of two signs, each the other's complement, whose differences cancel in polynomials modulo 2^64."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return sep.join((a, b)[x] for x in odd), sep.join((b, a)[x] for x in odd)


@pytest.fixture(scope="session")
def rows():
    return small_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
