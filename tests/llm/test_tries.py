"""The conversation trie against a plain one, with nulls, ties, copies and a very long conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, pos long, owner long, chunk string"
EXTRA = ("n", 1, 2, 3, "c")


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), turn_key(role, text), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    trunc = lambda c: c - int(abs(c) % 100) * (1 if c >= 0 else -1)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(trunc(c), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0)
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == s)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed=3):
    rng = random.Random(seed)
    say = ["", "hi", "ünï", "漢字", "a longer turn " * 5, None]
    rows = []
    for c in [*range(0, 140), -7, -100, 2**40, 2**40 + 1, 555, 556]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(say)))
    rows += [(c, t, "user", f"copied {t}") for c in range(700, 740) for t in range(9)]  # copies end and go on together
    rows += [(c, t, "user", f"copied {t}") for c in range(740, 760) for t in range(c - 738)]  # each one turn longer
    rows += [rows[0], rows[0], (None, 1, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [4096, 3])
def test_against_plain(spark, monkeypatch, block):
    from verisift.llm import tries

    monkeypatch.setattr(tries, "BLOCK", block)
    rows = some_rows()
    df = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(5)
    got = tries.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert result(got) == plain_trie(rows)


def test_chunks_of_ends(spark, monkeypatch):
    """Ends of a node that fill several chunks are hashed in the order of their ids."""
    from verisift.llm import tries

    monkeypatch.setattr(tries, "CHUNK_BITS", 2)
    rows = [(c, t, "u", "same") for c in range(1000, 1090) for t in range(6)]
    assert result(tries.prefix_trie(spark.createDataFrame([r + EXTRA for r in rows], SCHEMA))) == plain_trie(rows)


def test_empty_and_one(spark):
    from verisift.llm.tries import prefix_trie

    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, None, None, None)]
    assert result(prefix_trie(spark.createDataFrame([r + EXTRA for r in rows], SCHEMA))) == plain_trie(rows)


def test_query_equals_plain(spark):
    from verisift.llm.queries import op11_prefix_trie

    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert result(op11_prefix_trie(spark, "/root/testdata/sf0.01")) == plain_trie([tuple(r) for r in table.collect()])
