"""Many equal shapes, and rows that a join or a clock could treat otherwise than the SQL."""

import datetime as dt
import random

import pyspark.sql.functions as F

from verisift.operators import claims as K, geometry as G, layout as L, provenance as P
from verisift.plans import table_queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bundles_are_bounded_and_whole(spark):
    df = spark.range(1000).select(F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.col("id").alias("box"))
    got = [r.members for r in G.bundles(df, ["page", "x"], "box", most=100).collect()]
    assert sorted(x for m in got for x in m) == list(range(1000)) and max(map(len, got)) < 200


def test_overlap_pairs_of_equal_boxes(spark):
    random.seed(5)
    boxes = [(1, i, float(x), float(y), x + 30.0, y + 20.0 + 10 * (i % 3)) for i in range(90) for x, y in [random.choice([(0, 0), (10, 5), (60, 70), (45, 45)])]]
    want = []
    for _, a, ax0, ay0, ax1, ay1 in boxes:
        for _, b, bx0, by0, bx1, by1 in boxes:
            w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
            if a < b and w > 0 and h > 0 and w * h * 100 >= 25 * min((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0)):
                want.append((1, a, b, w * h))
    assert rows(G.overlap_pairs(spark.createDataFrame(boxes, "page long, box long, x0 double, y0 double, x1 double, y1 double"))) == sorted(want, key=str)


def test_crossed_boxes_of_equal_and_of_several_rows(spark):
    paths = spark.createDataFrame([(1, i, 0.0, 5.0, 100.0, 5.0) for i in range(5)] + [(1, 9, 0.0, 5.0, 100.0, 5.0), (1, 9, 0.0, 500.0, 100.0, 500.0), (1, 9, 0.0, 5.0, 100.0, 5.0)], "page long, path long, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, i, 20.0, 0.0, 80.0, 10.0) for i in range(7)] + [(2, 8, 20.0, 0.0, 80.0, 10.0)], "page long, box long, x0 double, y0 double, x1 double, y1 double")
    got = L.crossed_boxes(paths, boxes, steps=10)
    assert "bundles" in dir(L)
    assert rows(got) == sorted([(1, p, b, 5 * (2 if p == 9 else 1)) for p in [0, 1, 2, 3, 4, 9] for b in range(7)], key=str)


def test_islands_round_to_the_nearest_second(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    later = [dt.timedelta(), dt.timedelta(seconds=3600, milliseconds=600), dt.timedelta(seconds=7201, milliseconds=400)]  # 0, 3601, 7201 as the SQL casts
    spark.createDataFrame([(i, at + d, 1) for i, d in enumerate(later)], "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(table_queries.event_islands(spark, str(tmp_path))) == [(1, 1, 1, 0, 0), (1, 2, 2, 1, 2)]


def test_claim_pairs_are_never_broadcast(spark):
    units = K.sentence_rows(spark.createDataFrame([(1, "The harvester always adjusts irrigation channels.")], "g long, text string"), "g")
    paper = K.sentence_rows(spark.createDataFrame([(1, "The harvester may adjust irrigation channels slowly. Nothing else. Irrigation channels of a harvester."), (2, "The harvester may adjust irrigation channels.")], "g long, text string"), "g")
    pairs = K._pairs(units, paper, "g", 3, 40)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert rows(pairs.select("unit", "no", "shared")) == [(0, 0, 4), (0, 2, 3)]  # harvester, adjust, irrigation, channel


def test_heads_of_all_lengths_are_found(spark):
    random.seed(3)
    text = "".join(random.choice("ab1") for _ in range(400))
    flats = [text, text[::-1], "a", "ab1ab1ab", "x" * 40]
    heads = {text[i : i + n] for n in (1, 2, 7, 8, 9, 15, 16, 17, 40) for i in (0, 123, 400 - n)} | {"x" * 15, "x" * 17, "nowhere", "zz" * 20}
    got = P._head_places(spark.createDataFrame(list(enumerate(flats)), "o long, flat string"), spark.createDataFrame([(h,) for h in heads], "head string"))
    assert rows(got) == sorted(((o, h) for o, f in enumerate(flats) for h in heads if h in f), key=str)


def test_mathematics_arrives_by_its_rarest_word(spark):
    fragments = spark.createDataFrame([(0, "the energy x^2 grows with the mass over here"), (1, "x^2 unheard and the mass"), (2, "∑ 1"), (3, "")], "item_id long, text string")
    outputs = spark.createDataFrame([(0, "grows the mass over there energy with here"), (1, "the mass grows"), (2, None)], "doc_id long, text string")
    assert rows(P.arrived(fragments, outputs)) == [(0, 1), (1, 0), (2, 0), (3, 3)]


def test_well_formed_json_does_not_reach_python(spark, tmp_path):
    from verisift.sources import trees

    seen = spark.sparkContext.accumulator(0)
    real = trees.as_json

    def counted(text):
        if text is not None:
            seen.add(1)
        return real(text)

    trees.as_json = counted
    try:
        got = trees.json_texts(spark.createDataFrame([("a", '[{"title": "x"}]'), ("b", "not json [")], "path string, text string"))
        assert rows(got) == [("a", '[{"title": "x"}]'), ("b", None)]
    finally:
        trees.as_json = real
    assert seen.value == 1  # the text that is no JSON


def test_snapped_columns_hold_distinct_edges(spark, tmp_path):
    from verisift.functions import cells as C
    from verisift.plans import prose_queries

    got = spark.createDataFrame([([5.0, 1.0, None, 5.0, 3.5, 1.0, 2.5],)], "x array<double>").select(C.snapped(F.col("x"), 2.0)).first()[0]
    assert got == [5.0, 1.0, None, 5.0, 5.0, 1.0, 1.0]
    spark.range(100).select((F.col("id") * 400).alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    df = prose_queries.snapped_columns(spark, str(tmp_path))
    assert rows(df) == [(1, 1, 1)] and "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_are_counted_before_they_are_read(spark, tmp_path):
    from verisift.plans import report_queries, table_queries

    parts = [(f"name {i % 3}", f"type {i % 2}") for i in range(60)]
    spark.createDataFrame(parts, "p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    df = report_queries.prose_of_markup(spark, str(tmp_path))
    assert sorted(r.n for r in df.collect()) == [10] * 6
    assert _plan(df).rindex("Aggregate") > _plan(df).rindex("ArrowEvalPython")  # plans are written from the top
    items = [(i, i % 7 + 1, float(i % 4 + 1)) for i in range(100)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = table_queries.cell_number_parse(spark, str(tmp_path))
    scale = {0: 1000, 1: -1, 2: 1_000_000, 3: 100, 4: 0}
    want = {k: (sum((o + n) % 5 == k == 4 for o, n, _ in items), float(sum(scale[k] * q for o, n, q in items if (o + n) % 5 == k))) for k in scale}
    assert {r.kind: (r.n_blank, r.total) for r in df.collect()} == want
    assert _plan(df).count("Aggregate [") == 2  # by cell, then by kind


def test_banned_words_are_looked_for_before_what_stands_behind(spark):
    from verisift.operators import provenance as P

    assert P.inflected("worthless").startswith("(?i)(?=worthless)") and P.inflected("utterly disgusting").startswith("(?i)(?=utterly)")
    assert P.inflected("re:clowns?") == "(?i)clowns?"
    df = spark.createDataFrame([(0, "Worthless; not worthless, never WORTHLESS; it isn't worthless xworthless worthlessness"), (1, "a well-made Making; not makes, and so on"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.pattern): r.n for r in P.banned(df, ["worthless", "well-made make", "make", "so on"]).collect()}
    assert got == {(0, "worthless"): 1, (1, "well-made make"): 1, (1, "make"): 1, (1, "so on"): 1}
