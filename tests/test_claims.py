"""Claims: the dropped hedge is caught, what the source says itself is not."""

import pyspark.sql.functions as F

from verisift.operators import claims as C


def sents(spark, *texts):
    return C.sentence_rows(spark.createDataFrame([(1, " ".join(texts))], "g long, text string"), "g")


def test_overclaims(spark):
    paper = sents(spark, "The sensor network often reduces energy losses in greenhouse buildings.", "Pumps always deliver water towards distant fields.")
    strong = sents(spark, "The sensor network always reduces energy losses in greenhouse buildings.")
    assert [tuple(r) for r in C.overclaims(strong, paper, "g").collect()] == [(1, 0, 0, "always", "often")]
    kept = sents(spark, "The sensor network often reduces energy losses in greenhouse buildings.", "Pumps always deliver water towards distant fields.", "The sensor network does not always reduce energy losses in greenhouse buildings.")
    assert C.overclaims(kept, paper, "g").count() == 0


def test_dropped_modal(spark):
    paper = sents(spark, "Battery capacity could decline after repeated winter charging, and owners notice.", "Solar panels produce power during cloudy mornings.")
    flat = sents(spark, "Battery capacity declines: decline after repeated winter charging.", "Solar panels produce power during cloudy mornings.")
    assert [(r.unit, r.no) for r in C.dropped_modals(flat, paper, "g").collect()] == [(0, 0)]
    assert C.dropped_modals(sents(spark, "Battery capacity could decline after repeated winter charging."), paper, "g").count() == 0


def test_counts_and_caveats(spark):
    df = spark.createDataFrame([(1, "Queues grow for two reasons. Queues grow for two reasons. Two cars."), (2, "None.")], "doc_id long, text string")
    assert [tuple(r) for r in C.announced_counts(df, "doc_id").collect()] == [(1, 1)]
    paper = spark.createDataFrame([(1, "Winter readings cannot be compared with earlier laboratory measurements.")], "doc_id long, text string")
    lost = C.caveats_lost(paper, spark.createDataFrame([("winter readings",)], "text string"), "doc_id").first()
    kept = C.caveats_lost(paper, paper.select("text"), "doc_id").first()
    assert (lost.n_caveats, lost.n_lost, kept.n_lost) == (1, 1, 0)


def test_said_late(spark):
    shown = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma")], "g long, n long, text string")
    said = spark.createDataFrame([(1, 1, "alpha"), (1, 3, "gamma")], "g long, n long, text string")
    got = sorted((r.word, r.shown, r.said) for r in C.said_late(shown, said, "g", "n", F.split("text", " ")).collect())
    assert got == [("beta", 1, None), ("gamma", 2, 3)]
