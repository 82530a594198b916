"""The pipeline's stages against the brute-force versions of their operators, and run() from end to end."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_documents import LOWER, W, near, sizes  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    """Documents with null and repeated ids, and columns of names that operators use themselves."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def repeated(words):
    grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
    count, cover = Counter(grams), set()
    for j, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(j, j + 5))
    return len(cover)


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    # quality rules: with hardly any labels only the base rules reject; all columns stay as they are
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    good = [r for r in rows if len(w := W.findall(r[1] or "")) >= 10 and 100 * repeated(w) <= 20 * len(w)]
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(good) and None in {r[0] for r in good}
    # line dedup
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter(k for r in good for k in {key(x) for x in r[1].split("\n")} if k)
    lines = []
    for r in good:
        text = "\n".join(x for x in r[1].split("\n") if count[key(x)] < 10)
        lines.append((r[0], text, *r[2:4], len(text), *r[5:]))
    out = corpus_pipeline.line_dedup(spark, kept, sf_dir)
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(lines)
    assert any(len(a[1]) < len(b[1]) for a, b in zip(lines, good))
    # one document of each group of near copies: its smallest id, or any one of those without
    left = corpus_pipeline.near_duplicates(spark, out, sf_dir)
    stay = [tuple(r) for r in left.collect()]
    assert left.columns == docs.columns and not Counter(stay) - Counter(lines) and len(stay) < len(lines)
    groups = near(stay, 5, 80)
    assert Counter(r[2] for r in groups) == Counter(r[0] for r in stay)  # nothing left is linked
    known = {r[0] for r in near(lines, 5, 80) if r[0] == r[2] and r[0] is not None}
    assert {r[0] for r in stay if r[0] is not None} == known
    # the mix
    mixed = corpus_pipeline.mixture(spark, left, sf_dir)
    took = [tuple(r) for r in mixed.collect()]
    taken, per, most = Counter(), Counter(), Counter(stay)
    for r, n in zip(took, sizes(took)):
        taken[r[3]] += n
    for r, n in zip(stay, sizes(stay)):
        per[r[3]] += n
    assert mixed.columns == docs.columns and sum(taken.values()) == pytest.approx(sum(per.values()), abs=len(per) * max(sizes(stay)))
    assert all(taken[s] <= 3 * per[s] for s in per) and all(n <= 3 * most[r] for r, n in Counter(took).items())
    # the encoding is lossless
    from verisift.llm.pieces import decode

    encoded = corpus_pipeline.encoding(spark, mixed, sf_dir)
    assert Counter(r.text for r in decode(encoded).collect()) == Counter(r[1] for r in took)


def test_run(spark, sf_dir):
    first, again = (sorted((r.doc_id is None, r.doc_id, r.n_pieces, tuple(r.pieces)) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert first == again and first


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_near_duplicates_by_row(spark, sf_dir):
    """Rows with a null or a repeated id go or stay by their own texts."""
    import random

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(9)]
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [
        (1, texts[0]), (None, near(texts[0])),  # a null id's row goes for a copy with an id
        (None, texts[1]),  # a clean one stays
        (None, texts[2]), (None, near(texts[2])), (None, texts[2]),  # one of a group without ids
        (5, texts[3]), (5, texts[3]), (5, texts[3]),  # one of repeated rows
        (6, texts[4]), (7, near(texts[4])), (7, texts[5]),  # an id goes with one text and stays with another
        (8, texts[6]), (8, near(texts[6])), (9, near(texts[6])),
        (10, texts[7]), (10, texts[8]),  # nothing goes
        (None, None), (None, ""), (11, ""), (11, ""), (5, None),  # without words nothing is a copy
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    either = [(None, texts[2], near(texts[2])), (8, texts[6], near(texts[6]))]
    for i, a, b in either:
        assert got.pop((i, a), 0) + got.pop((i, b), 0) == 1
    want = [(1, texts[0]), (None, texts[1]), (5, texts[3]), (6, texts[4]), (7, texts[5]), (10, texts[7]), (10, texts[8]), (None, None), (None, ""), (11, ""), (11, ""), (5, None)]
    assert out.columns == docs.columns and got == Counter(want)
