"""Hard negatives against brute force, with nulls, ties, copies, unequal lengths and very large components."""

import math
import random

import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row string, norm int, at long, vector string"
EXTRA = (1, "r", 2, 3, "v")
LAST = 2**63 - 1


def brute(rows, every=50):
    import numpy as np

    ok = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), LAST if j is None else j, m == label) for b, (j, w, m) in enumerate(ok) if b != a)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            inside = [(t, n) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, None if j == LAST else j, r + 1, None if n == LAST else n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    from verisift.llm.negatives import hard_negatives, whole_vectors

    df = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives(whole_vectors(df), **options).collect()), key=str)


def some_rows(n=400, size=6, seed=2, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.3, 1) * spread for _ in range(size)], rng.randrange(10)) for i in range(n)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)]  # a vector that many rows share: ties
    rows += [(50, rows[50][1], 3), (50, rows[50][1], 4), (None, rows[3][1], 2), (None, rows[50][1], 3)]
    rows += [(2001, None, 1), (2002, [1.0] * size, None), (2003, [1.0, None, 2.0], 1), (2004, [float("nan")] * size, 1), (2005, [float("inf")] * size, 1), (2050, None, None)]
    rows += [(2100, [], 1), (2101, [], 2), (2102, [2.0], 1), (2150, [1.0, 2.0], 1), (2200, [0.0] * size, 1), (2201, [0.0] * size, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket,block", [(1024, 8 << 20), (16, 500)])
def test_against_brute_force(spark, monkeypatch, bucket, block):
    from verisift.llm import negatives

    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "SLICE", bucket)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    rows = some_rows()
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_large_components(spark):
    """Beyond 2^53 scores are whole numbers all the same; beyond a long they stay at its ends."""
    rows = some_rows(120, 4, 5, 1e5)[:120] + [(50 * i, [1e6 + i, 2e5, -3e5, 1.0], i % 2) for i in range(5)]
    assert mined(spark, rows) == brute(rows)
    rows += [(9000 + i, [3e38, 1.0], i % 3) for i in range(4)]
    assert mined(spark, rows) == brute(rows)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1), (50, [1.0], 2)]) == []


def test_pruned_buckets_are_not_read(spark, monkeypatch):
    """Candidates that are sorted by norm let most buckets go unread."""
    import numpy as np
    import pyarrow as pa

    from verisift.llm import negatives

    monkeypatch.setattr(negatives, "BUCKET", 10)
    seen = []
    real = negatives._scores
    monkeypatch.setattr(negatives, "_scores", lambda a, c: seen.append(len(c)) or real(a, c))
    c = np.array([[2.0**(12 - i // 10), 1.0] for i in range(120)])
    batch = pa.record_batch({"id": np.arange(120), "row": np.arange(120), "label": np.zeros(120, np.int64), "norm": np.sqrt((c**2).sum(1)), "vector": pa.array(c.tolist(), pa.list_(pa.float64()))})
    a = {"vector": np.array([[5.0, 0.0]]), "label": np.zeros(1, np.int64), "row": np.array([500]), "norm": np.array([5.0]), "owner": np.arange(1), "low": np.full(1, -np.inf)}
    found = [r for b in negatives._search(a, True, 5, 2)([batch]) for r in b.to_pylist()]
    assert [r["id"] for r in found] == [0, 1, 2, 3, 4] and sum(seen) == 10


def test_query_equals_brute_force(spark):
    from verisift.llm.queries import op13_hard_negatives

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    got = sorted(map(tuple, op13_hard_negatives(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute([tuple(r) for r in table.collect()])
