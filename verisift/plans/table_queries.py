"""Queries on talks, events, cells and boxes, with the SQL that gives the same rows.

A talk is a conversation, a slide a turn; users' turns stand for the screen, assistants' for the script, system turns
for backup slides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..operators import geometry as G, profile, provenance as P, sequence as Q, similarity as S
from ..sources.tables import table

LIMIT_SECONDS = 60


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _timed(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", T.slide_seconds(F.col("text")).alias("seconds"))


def running_talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir)
    total = Q.running(F.col("seconds"), "conv_id", ["turn"])
    return rows.withColumn("upto", total).select("conv_id", "turn", "seconds", "upto", T.clock(F.col("upto")).alias("clock"))


def budget_gate(spark, sf_dir):
    talks = _timed(spark, sf_dir).groupBy("conv_id").agg(F.sum("seconds").alias("seconds"))
    state = F.when(F.col("seconds") > LIMIT_SECONDS, "over").when(F.col("seconds") * 10 > LIMIT_SECONDS * 9, "tight").otherwise("fits")
    return talks.withColumn("state", state)


def spoken_only_lag(spark, sf_dir):
    """Words of an assistant's turn that neither the turn before it nor the one before that has shown, by turn."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "role", F.array_distinct(T.word_run(F.col("text"))).alias("w"))
    over = W.partitionBy("conv_id").orderBy("turn")
    shown = lambda k: F.coalesce(F.lag("w", k).over(over), F.array().cast("array<string>"))
    rows = rows.select("conv_id", "turn", "role", F.size(F.array_except(F.array_except("w", shown(1)), shown(2))).cast("long").alias("n_new"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", "n_new")


def first_screen_vs_spoken(spark, sf_dir):
    """Words said before they are shown, or never shown, in each talk."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "role", F.explode(F.array_distinct(T.word_run(F.col("text")))).alias("word"))
    firsts = rows.groupBy("conv_id", "word").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("shown"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("said"))
    return firsts.where("said IS NOT NULL AND (shown IS NULL OR said < shown)").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_early"), F.min("said").alias("first_said"))


def renumber_and_pages(spark, sf_dir):
    rows = Q.renumbered(_turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "system", F.col("role") == "user")
    return rows.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.coalesce("page", F.lit(0)).alias("page"))


def turn_gaps(spark, sf_dir):
    return Q.gaps(_turns(spark, sf_dir).where("role <> 'system'"), "conv_id", "turn")


def as_of_event(spark, sf_dir):
    """Each error with the user's last view before it; -1 where there is none."""
    events = table(spark, sf_dir, "events")
    last = Q.as_of(events, F.col("event_type") == "view", "user_id", ["ts", "event_id"], "event_id")
    return events.withColumn("view_id", F.coalesce(last, F.lit(-1))).where("event_type = 'error'").select("event_id", "user_id", "view_id")


def event_islands(spark, sf_dir):
    """Runs of a user's events that follow each other within an hour."""
    events = table(spark, sf_dir, "events").withColumn("s", F.rint(F.col("ts").cast("timestamp").cast("double")).cast("long"))  # to the nearest second, as the SQL casts
    before = F.lag("s").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = Q.islands(events.withColumn("p", before), "user_id", ["ts", "event_id"], (F.col("s") - F.col("p")) > 3600)
    return rows.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("least_id"), F.max("event_id").alias("most_id"))


def greedy_turns(spark, sf_dir):
    """Users' turns matched one to one with assistants' by their words."""
    rows = _turns(spark, sf_dir).withColumn("words", T.alpha_words(F.col("text")))
    return S.greedy_pairs(rows.where("role = 'user'"), rows.where("role = 'assistant'"), "conv_id", "turn", "words", floor=0.05)


def best_support(spark, sf_dir):
    """Each assistant turn's best supporting user turn by topic words."""
    rows = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("no"), "role", T.topic_words(T.alpha_words(F.col("text"))).alias("w")).where(F.size("w") >= 3)
    return S.best_support(rows.where("role = 'assistant'"), rows.where("role = 'user'"), "conv_id", least=2, percent=5)


def topic_overlap(spark, sf_dir):
    """Words of each turn's first sentence that the turn before has, over those of the sentence."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", T.alpha_words(F.coalesce(F.get(T.sentences(F.col("text")), F.lit(0)), F.lit(""))).alias("f"), T.alpha_words(F.col("text")).alias("w"))
    before = F.lag("w").over(W.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("p", before).where("p IS NOT NULL").select("conv_id", "turn", F.size(F.array_intersect("f", "p")).cast("long").alias("n_shared"), F.size("f").cast("long").alias("n_words"))


def upper_medians(spark, sf_dir):
    return profile.upper_median_of(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


def column_alignment(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    cells = parts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in ("p_name", "p_brand", "p_size", "p_type")])).alias("c")).select("c.*")
    return profile.numeric_columns(cells, ["col"], "text").select("col", "n_numeric", "n_cells", "align")


def unpivot_cells(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = nation.unpivot([F.lit("nation").alias("tag"), F.col("n_nationkey").cast("string").alias("row")], [F.col("n_name"), F.col("n_regionkey").cast("string").alias("n_regionkey")], "col", "value")
    r = region.unpivot([F.lit("region").alias("tag"), F.col("r_regionkey").cast("string").alias("row")], [F.col("r_name")], "col", "value")
    return n.unionAll(r)


def sidecar_upsert(spark, sf_dir):
    """Cells of nations, those of the tags that regions name replaced by one line each."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    old = nation.select(F.col("n_regionkey").cast("string").alias("tag"), F.col("n_name").alias("value"))
    new = region.where("r_regionkey < 2").select(F.col("r_regionkey").cast("string").alias("tag"), F.col("r_name").alias("value"))
    return P.upsert_by_tag(old, new).orderBy("tag", "value")


def fingerprint_duplicates(spark, sf_dir):
    """Vectors whose components all agree at 16 levels: a hexadecimal key and an exact match on it."""
    level = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1.0) * 8.0), F.lit(0)), F.lit(15))
    key = F.array_join(F.transform("embedding", lambda x: F.lower(F.hex(level(x).cast("long")))), "")
    return table(spark, sf_dir, "embeddings").groupBy(key.alias("print")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")).where("n > 1")


def cell_number_parse(spark, sf_dir):
    """Numbers written as cells and read back, summed by how they were written; equal cells are counted, then read once."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    q = F.col("l_quantity").cast("int").cast("string")
    cell = F.when(k == 0, F.concat(q, F.lit("k"))).when(k == 1, F.concat(F.lit("−"), q)).when(k == 2, F.concat(q, F.lit(" million"))).when(k == 3, F.concat(q, F.lit("e2"))).otherwise(F.lit("n/a"))
    rows = table(spark, sf_dir, "lineitem").groupBy(k.alias("kind"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    read = rows.select("kind", "n", T.is_blank(F.col("cell")).alias("blank"), F.coalesce(T.cell_number(F.col("cell")), F.lit(0.0)).cast("decimal(18,0)").alias("x"))
    return read.groupBy("kind").agg(F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).cast("long").alias("n_blank"), F.sum(F.col("x") * F.col("n")).cast("double").alias("total"))


def _boxes(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select((key % 40).alias("page"), key.alias("box"), ((key * 37) % 400).cast("double").alias("x0"), ((key * 53) % 300).cast("double").alias("y0"), ((key * 37) % 400 + 10 + size).cast("double").alias("x1"), ((key * 53) % 300 + 8 + size % 20).cast("double").alias("y1"))


def box_overlap_pairs(spark, sf_dir):
    return G.overlap_pairs(_boxes(spark, sf_dir), percent=25)


def caption_regions(spark, sf_dir):
    """For each supplier as a caption the nearest box edge above it."""
    key = F.col("s_suppkey")
    captions = table(spark, sf_dir, "supplier").select((key % 40).alias("page"), key.alias("caption"), ((key * 31) % 300).cast("double").alias("at"))
    return G.nearest_above(captions, _boxes(spark, sf_dir).select("page", F.col("y1").alias("edge")))


def contrast_ratios(spark, sf_dir):
    key = F.col("p_partkey")
    a = G.luminance(key * 7 % 256, key * 11 % 256, key * 13 % 256)
    b = G.luminance(key * 3 % 256, key * 5 % 256, key * 17 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.contrast(a, b), 6).alias("ratio"))


def reciprocal_pairs(spark, sf_dir):
    """Lines of an order where one's tenth of quantity and another's tenfold discount are reciprocal within 3 %."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity")).cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    a, b = rows.alias("a"), rows.alias("b")
    near = F.expr("a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.q % 10 <> 0 AND b.d % 10 <> 0 AND abs(a.q * b.d - 100) <= 3")
    return a.join(b, near).groupBy("a.l_orderkey").agg(F.count(F.lit(1)).alias("n_pairs"))


def count_mismatch(spark, sf_dir):
    """Orders whose stated number of lines (a digit of the key) is off by one to four."""
    said = F.col("o_orderkey") % 7 + 1
    drawn = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("drawn"))
    rows = table(spark, sf_dir, "orders").join(drawn, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", said.alias("said"), "drawn")
    return rows.where((F.col("said") >= 3) & (F.col("said") != F.col("drawn")) & (F.abs(F.col("said") - F.col("drawn")) <= 4))


def merged_columns(spark, sf_dir):
    """Brands whose parts' names begin with a few repeated words."""
    cells = table(spark, sf_dir, "part").select("p_brand", F.element_at(F.split("p_type", " "), 1).alias("head"))
    return profile.merged_heads(cells, ["p_brand"], "head")


def table_widths(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    cells = parts.select("p_brand", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in ("p_name", "p_type", "p_size")])).alias("c")).select("p_brand", "c.*")
    return profile.widths(cells, "p_brand", "col", "text")


def modal_values(spark, sf_dir):
    """The most frequent priority of each customer's orders, where it is half of them or more (all but two count)."""
    best = profile.mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", F.col("n") * 2 >= F.greatest(F.lit(1), F.col("total") - 2))
    return best.select("o_custkey", "o_orderpriority", "n")


def deck_values(spark, sf_dir):
    """Types that 30 % of a manufacturer's sizes carry, two at least."""
    return profile.supported(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_size", percent=5, least=2)


def unexplained_blanks(spark, sf_dir):
    """Blank cells (no discount, no tax) by order, rows that are blank throughout left out."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") == 0).cast("int").alias("a"), (F.col("l_tax") == 0).cast("int").alias("b"))
    return rows.where("a + b < 2").groupBy("l_orderkey").agg(F.sum(F.col("a") + F.col("b")).alias("n_blank")).where("n_blank > 0")


def bar_axes(spark, sf_dir):
    """Axis span and sign of each nation's balances; what is missing counts as 0 but is remembered."""
    v = F.when(F.col("c_custkey") % 11 != 0, F.round(F.col("c_acctbal") * 100).cast("long"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", v.alias("v"))
    z = F.coalesce("v", F.lit(0))
    return rows.groupBy("c_nationkey").agg(F.min(z).alias("low"), F.max(z).alias("high"), F.count_if(F.col("v").isNull()).alias("n_missing"), (F.count_if(z < 0) >= F.count_if(z > 0)).alias("down"))


def log_points(spark, sf_dir):
    """Points on a logarithmic axis by segment: what is not above zero is dropped and counted."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("v"))
    return rows.groupBy("c_mktsegment").agg(F.count_if(F.col("v") > 0).alias("n_points"), F.count_if(F.col("v") <= 0).alias("n_dropped"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("low"), F.max("v").alias("high"))


def series_polylines(spark, sf_dir):
    """Each market segment's customers as a polyline in order of their key: its length in points and its turns."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("y"))
    over = W.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")
    steps = rows.withColumn("p", F.lag("y").over(over)).withColumn("n", F.lead("y").over(over))
    turn = (F.col("p").isNotNull()) & (F.col("n").isNotNull()) & (F.sign(F.col("y") - F.col("p")) * F.sign(F.col("n") - F.col("y")) < 0)
    return steps.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(turn).alias("n_turns"))


def edge_endpoints(spark, sf_dir):
    """Edges (orders) by whether both their ends are nodes: customers above a balance, orders of a status."""
    nodes = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    edges = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    marked = edges.join(nodes.withColumn("known", F.lit(True)), F.col("o_custkey") == F.col("id"), "left")
    return marked.groupBy("o_orderstatus").agg(F.count_if(F.col("known").isNotNull()).alias("n_kept"), F.count_if(F.col("known").isNull()).alias("n_rejected"))


def spoken_numbers(spark, sf_dir):
    """Words that order keys and prices take when read aloud."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.floor("o_totalprice").cast("long").alias("p"), "o_orderkey")
    return rows.groupBy("o_orderstatus").agg(F.sum(T.integer_words(F.col("p"))).alias("price_words"), F.sum(T.integer_words(F.col("o_orderkey"))).alias("key_words"))


def _amounts(spark, sf_dir):
    """Lines of order items as someone would say them, with signs, decimals, units, ordinals and hyphens."""
    n = F.col("l_quantity").cast("int")
    text = F.concat(F.lit("No. "), F.col("l_linenumber").cast("string"), F.lit("th: "), F.round("l_extendedprice", 2).cast("string"), F.lit("M at -"), F.round("l_discount", 2).cast("string"), F.lit("% ("), n.cast("string"), F.lit("GB, ISO-"), F.col("l_orderkey").cast("string"), F.lit(", ΔT ≤ "), n.cast("string"), F.lit(".5) GPU-days."))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", text.alias("text"))


def spoken_lines(spark, sf_dir):
    """Words of amounts read aloud; GPU takes three, GB two."""
    acronyms = F.create_map(F.lit("GPU"), F.lit(3.0), F.lit("GB"), F.lit(2.0))
    rows = _amounts(spark, sf_dir).select("l_returnflag", T.spoken_words(F.col("text")).alias("plain"), T.spoken_words(F.col("text"), acronyms).alias("named"))
    return rows.groupBy("l_returnflag").agg(F.sum("plain").cast("long").alias("n_plain"), F.sum("named").cast("long").alias("n_named"))


def axis_ticks(spark, sf_dir):
    """Five ticks of every nation's balance axis, in whole cents."""
    span = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min(F.round(F.col("c_acctbal") * 100).cast("long")).alias("low"), F.max(F.round(F.col("c_acctbal") * 100).cast("long")).alias("high"))
    return span.select("c_nationkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.cast("long").alias("tick"), F.floor((F.col("low") * (4 - i) + F.col("high") * i) / 4).cast("long").alias("at")))).alias("t")).select("c_nationkey", "t.*")


def section_heads(spark, sf_dir):
    """Lines of documents under the last line before them that has no full stop, counted by head."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    under = Q.sections(lines, "doc_id", "pos", ~F.contains("line", F.lit(".")), "line")
    return under.groupBy("doc_id").agg(F.count_distinct("head").alias("n_heads"), F.count_if(F.col("head").isNull()).alias("n_headless"))


def violations_rollup(spark, sf_dir):
    from . import text_queries as X

    sections = [(n, X.QUERIES[n](spark, sf_dir)) for n in ("unsourced_values", "banned_words", "markup_leaks", "contradicting_values")]
    return profile.roll_up(sections).select(F.coalesce("section", F.lit("total")).alias("section"), "n")


QUERIES = {
    f.__name__: f
    for f in (running_talk_time, budget_gate, spoken_only_lag, first_screen_vs_spoken, renumber_and_pages, turn_gaps, as_of_event, event_islands, greedy_turns, best_support, topic_overlap, upper_medians, column_alignment, unpivot_cells, sidecar_upsert, fingerprint_duplicates, cell_number_parse, box_overlap_pairs, caption_regions, contrast_ratios, reciprocal_pairs, count_mismatch, merged_columns, table_widths, modal_values, deck_values, unexplained_blanks, bar_axes, log_points, series_polylines, edge_endpoints, spoken_numbers, spoken_lines, axis_ticks, section_heads, violations_rollup)
}

_SECONDS = "round_even(_W * 60.0::DOUBLE / 135 + len(regexp_extract_all(coalesce(text, ''), '" + T.CJK + "')) / 5.0::DOUBLE, 0)::BIGINT"
_RUN = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_ALPHA = r"list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z\-]{{3,}}'), lambda w: lower(w)))"
_BOX = """(SELECT p_partkey % 40 AS page, p_partkey AS box, ((p_partkey * 37) % 400)::DOUBLE AS x0, ((p_partkey * 53) % 300)::DOUBLE AS y0,
  ((p_partkey * 37) % 400 + 10 + p_size)::DOUBLE AS x1, ((p_partkey * 53) % 300 + 8 + p_size % 20)::DOUBLE AS y1 FROM part)"""
_LUM = lambda r, g, b: " + ".join(f"{k} * CASE WHEN ({c} % 256) / 255.0 <= 0.03928 THEN ({c} % 256) / 255.0 / 12.92 ELSE pow((({c} % 256) / 255.0 + 0.055) / 1.055, 2.4) END" for k, c in ((0.2126, r), (0.7152, g), (0.0722, b)))


def _int_words(n: str) -> str:
    """Recursion told as a table: the same rule, group by group."""
    g = lambda unit, name: f"CASE WHEN ({n}) // {unit} % 1000 > 0 THEN CASE WHEN ({n}) // {unit} % 1000 < 100 THEN 1 ELSE 3 END + {name} ELSE 0 END"
    low = f"(({n}) % 1000000)"
    short = f"(({low} BETWEEN 1000 AND 2099 AND {low} % 100 <> 0) OR ({low} >= 1000 AND {low} < 10000 AND {low} % 100 = 0 AND {low} % 1000 <> 0))"
    return f"CASE WHEN {n} < 100 THEN 1 WHEN {n} < 1000 THEN 3 ELSE {g(10**9, 1)} + {g(10**6, 1)} + CASE WHEN {short} THEN 2 ELSE {g(1000, 1)} + {g(1, 0)} END END"


def spoken_sql(text: str) -> str:
    """Words of a text read aloud, by lists: tokens, then their parts, then each part's words."""
    strip = lambda x: rf"regexp_replace({x}, '^[.\x27’]+|\.+$', '', 'g')"
    tokens = rf"list_transform(regexp_extract_all({text}, '[A-Za-z0-9][A-Za-z0-9\x27’.\-]*'), lambda t: {strip('t')})"
    parts = f"list_filter(flatten(list_transform({tokens}, lambda t: string_split(t, '-'))), lambda p: {strip('p')} <> '')"
    whole = "coalesce(TRY_CAST(regexp_extract(n, '^[0-9]+') AS BIGINT), 0)"
    number = f"({_int_words(whole)} + coalesce(nullif(length(regexp_extract(n, '[.][0-9]+$')), 0), 0))"
    measure = r"regexp_extract({}, '^([0-9]+(?:\.[0-9]+)?)([A-Za-z]{{1,3}})$', {})"
    one = f"""CASE WHEN regexp_full_match(p, '[0-9]+(\\.[0-9]+)?') THEN (SELECT {number} FROM (SELECT p AS n)) WHEN {measure.format('p', 1)} <> ''
  THEN (SELECT {number} FROM (SELECT {measure.format('p', 1)} AS n)) + (lower({measure.format('p', 2)}) NOT IN ('st', 'nd', 'rd', 'th'))::INT ELSE 1 END"""
    signs = " + ".join(f"{k} * (length({text}) - length(replace({text}, '{c}', '')))" for c, k in T.SYMBOL_WORDS.items())
    extra = rf"len(regexp_extract_all({text}, '(?:^|[^\p{{L}}\p{{N}}_.])[-−][0-9]')) + len(regexp_extract_all({text}, '{T.GREEK_LETTER}')) + {signs}"
    return f"coalesce((SELECT sum({one}) FROM (SELECT {strip('x')} AS p FROM (SELECT unnest({parts}) AS x))), 0) + coalesce({extra}, 0)"


def sql(text_sql: dict[str, str]) -> dict[str, str]:
    from .text_queries import _SENT

    sentence = f"coalesce({_SENT.format('text')}[1], '')"
    return {
        "running_talk_time": f"""WITH w AS (SELECT conv_id, turn, text, {spoken_sql("coalesce(text, '')")} AS _W FROM conversations), s AS (SELECT conv_id, turn, {_SECONDS} AS seconds FROM w)
SELECT conv_id, turn, seconds, upto, (upto // 60)::VARCHAR || ':' || lpad((upto % 60)::VARCHAR, 2, '0') AS clock FROM (
SELECT conv_id, turn, seconds, (sum(seconds) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM s)""",
        "budget_gate": f"""WITH w AS (SELECT conv_id, text, {spoken_sql("coalesce(text, '')")} AS _W FROM conversations)
SELECT conv_id, s AS seconds, CASE WHEN s > {LIMIT_SECONDS} THEN 'over' WHEN s * 10 > {LIMIT_SECONDS * 9} THEN 'tight' ELSE 'fits' END AS state FROM (SELECT conv_id, sum({_SECONDS})::BIGINT AS s FROM w GROUP BY conv_id)""",
        "spoken_only_lag": f"""WITH w AS (SELECT conv_id, turn, role, list_distinct({_RUN}) AS w FROM conversations),
l AS (SELECT *, coalesce(lag(w) OVER o, []) AS p, coalesce(lag(w, 2) OVER o, []) AS q FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, len(list_filter(w, lambda x: NOT list_contains(p, x) AND NOT list_contains(q, x)))::BIGINT AS n_new FROM l WHERE role = 'assistant'""",
        "first_screen_vs_spoken": f"""WITH w AS (SELECT conv_id, turn, role, unnest({_RUN}) AS word FROM conversations),
f AS (SELECT conv_id, word, min(turn) FILTER (WHERE role = 'user') AS shown, min(turn) FILTER (WHERE role = 'assistant') AS said FROM w GROUP BY ALL)
SELECT conv_id, count(*) AS n_early, min(said) AS first_said FROM f WHERE said IS NOT NULL AND (shown IS NULL OR said < shown) GROUP BY conv_id""",
        "renumber_and_pages": """WITH p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'system', turn) AS place FROM conversations)
SELECT conv_id, turn, place, CASE WHEN role = 'user' THEN sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY place)::BIGINT ELSE 0 END AS page FROM p""",
        "turn_gaps": """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'system'), m AS (SELECT conv_id, max(turn) AS m FROM t GROUP BY conv_id),
a AS (SELECT conv_id, unnest(range(0, m)) AS missing FROM m) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = a.conv_id AND t.turn = a.missing)""",
        "as_of_event": """SELECT e.event_id, e.user_id, coalesce((SELECT arg_max(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) <= (e.ts, e.event_id)), -1) AS view_id FROM events e WHERE event_type = 'error'""",
        "event_islands": """WITH e AS (SELECT *, epoch(ts)::BIGINT AS s FROM events), l AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600 OR lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b FROM e),
i AS (SELECT user_id, event_id, (sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS island FROM l)
SELECT user_id, island, count(*) AS n_events, min(event_id) AS least_id, max(event_id) AS most_id FROM i GROUP BY ALL""",
        "best_support": f"""WITH w AS (SELECT conv_id, turn, role, list_filter({_ALPHA.format('text')}, lambda x: length(x) > 4 AND NOT list_contains([{', '.join(repr(x) for x in T.TOPIC_STOP)}], x)) AS w FROM conversations),
p AS (SELECT u.conv_id, u.turn AS unit, s.turn AS support, len(list_intersect(u.w, s.w)) AS shared, len(u.w) AS z FROM w u JOIN w s ON u.conv_id = s.conv_id WHERE u.role = 'assistant' AND s.role = 'user' AND len(u.w) >= 3 AND len(s.w) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, unit ORDER BY shared DESC, support) AS k FROM p)
SELECT conv_id, unit, support, shared FROM r WHERE k = 1 AND shared >= 2 AND shared * 100 >= z * 5""",
        "topic_overlap": f"""WITH w AS (SELECT conv_id, turn, {_ALPHA.format('text')} AS w, {_ALPHA.format(sentence)} AS f FROM conversations),
l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM w)
SELECT conv_id, turn, len(list_intersect(f, p))::BIGINT AS n_shared, len(f)::BIGINT AS n_words FROM l WHERE p IS NOT NULL""",
        "upper_medians": "SELECT l_returnflag, list_sort(list(l_quantity))[(count(*) // 2 + 1)::INT] AS upper_median FROM lineitem GROUP BY l_returnflag",
        "column_alignment": " UNION ALL ".join(rf"SELECT '{c}' AS col, count(*) FILTER (WHERE regexp_matches({c}::VARCHAR, '^[-+−]?[0-9][0-9.,]*%?$')) AS n_numeric, count(*) AS n_cells, CASE WHEN count(*) FILTER (WHERE regexp_matches({c}::VARCHAR, '^[-+−]?[0-9][0-9.,]*%?$')) * 2 > count(*) THEN 'right' ELSE 'left' END AS align FROM part WHERE trim({c}::VARCHAR) <> ''" for c in ("p_name", "p_brand", "p_size", "p_type")),
        "unpivot_cells": "SELECT 'nation' AS tag, n_nationkey::VARCHAR AS row, 'n_name' AS col, n_name AS value FROM nation UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'n_regionkey', n_regionkey::VARCHAR FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR, 'r_name', r_name FROM region",
        "sidecar_upsert": "SELECT n_regionkey::VARCHAR AS tag, n_name AS value FROM nation WHERE n_regionkey >= 2 UNION ALL SELECT r_regionkey::VARCHAR, r_name FROM region WHERE r_regionkey < 2",
        "greedy_turns": f"""WITH RECURSIVE w AS (SELECT conv_id, turn, role, {_ALPHA.format('text')} AS w FROM conversations),
u AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM w WHERE role = 'user'),
s AS (SELECT u.conv_id, u.i, a.turn AS p, len(list_intersect(u.w, a.w))::DOUBLE / len(list_distinct(u.w || a.w)) AS score FROM u JOIN w a ON a.role = 'assistant' AND a.conv_id = u.conv_id WHERE len(list_intersect(u.w, a.w)) > 0),
g AS (SELECT conv_id, i, list(p ORDER BY score DESC, p) FILTER (WHERE score >= 0.05) AS best FROM s GROUP BY conv_id, i),
r(conv_id, i, used, matched) AS (SELECT DISTINCT conv_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM u
UNION ALL SELECT r.conv_id, u.i, CASE WHEN x.p IS NULL THEN used ELSE list_append(used, x.p) END, x.p FROM r JOIN u ON u.conv_id = r.conv_id AND u.i = r.i + 1
LEFT JOIN g ON g.conv_id = u.conv_id AND g.i = u.i, LATERAL (SELECT list_filter(coalesce(g.best, []), lambda p: NOT list_contains(r.used, p))[1] AS p) x)
SELECT u.conv_id, u.turn, r.matched FROM r JOIN u USING (conv_id, i)""",
        "fingerprint_duplicates": """SELECT print, count(*) AS n, min(vec_id) AS first_id FROM (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: lower(to_hex(least(greatest(floor((x::DOUBLE + 1.0) * 8.0), 0), 15)::BIGINT))), '') AS print FROM embeddings) GROUP BY print HAVING count(*) > 1""",
        "cell_number_parse": """SELECT (l_orderkey + l_linenumber) % 5 AS kind, (count(*) FILTER (WHERE (l_orderkey + l_linenumber) % 5 = 4)) AS n_blank,
sum(CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 1000 WHEN 1 THEN -1 WHEN 2 THEN 1000000 WHEN 3 THEN 100 ELSE 0 END * trunc(l_quantity)) AS total FROM lineitem GROUP BY 1""",
        "box_overlap_pairs": f"""WITH b AS {_BOX}, p AS (SELECT x.page, x.box AS a, y.box AS b, (least(x.x1, y.x1) - greatest(x.x0, y.x0)) * (least(x.y1, y.y1) - greatest(x.y0, y.y0)) AS area, least((x.x1 - x.x0) * (x.y1 - x.y0), (y.x1 - y.x0) * (y.y1 - y.y0)) AS small
FROM b x JOIN b y ON x.page = y.page AND x.box < y.box AND x.x0 < y.x1 AND y.x0 < x.x1 AND x.y0 < y.y1 AND y.y0 < x.y1) SELECT page, a, b, area FROM p WHERE area * 100 >= small * 25""",
        "caption_regions": f"""WITH b AS {_BOX}, c AS (SELECT s_suppkey % 40 AS page, s_suppkey AS caption, ((s_suppkey * 31) % 300)::DOUBLE AS pos FROM supplier),
h AS (SELECT c.page, caption, pos, y1 FROM c LEFT JOIN b ON b.page = c.page)
SELECT page, caption, max(y1) AS top FROM h WHERE y1 IS NULL OR y1 < pos GROUP BY page, caption""",
        "contrast_ratios": f"""SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS ratio FROM (SELECT p_partkey, {_LUM('p_partkey * 7', 'p_partkey * 11', 'p_partkey * 13')} AS a, {_LUM('p_partkey * 3', 'p_partkey * 5', 'p_partkey * 17')} AS b FROM part)""",
        "reciprocal_pairs": """WITH r AS (SELECT l_orderkey, l_linenumber, round(l_quantity)::BIGINT AS q, round(l_discount * 100)::BIGINT AS d FROM lineitem)
SELECT a.l_orderkey, count(*) AS n_pairs FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.q % 10 <> 0 AND b.d % 10 <> 0 AND abs(a.q * b.d - 100) <= 3 GROUP BY a.l_orderkey""",
        "count_mismatch": "SELECT * FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS said, count(*) AS drawn FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) WHERE said >= 3 AND said <> drawn AND abs(said - drawn) <= 4",
        "merged_columns": """WITH h AS (SELECT p_brand, string_split(p_type, ' ')[1] AS head, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, sum(n)::BIGINT AS n_rows, count(*) FILTER (WHERE n >= 2) AS n_heads, coalesce(sum(n) FILTER (WHERE n >= 2), 0)::BIGINT AS n_covered FROM h GROUP BY p_brand HAVING sum(n) >= 4 AND count(*) FILTER (WHERE n >= 2) >= 2 AND sum(n) FILTER (WHERE n >= 2) * 100 >= sum(n) * 60""",
        "table_widths": "SELECT p_brand, (max(length(p_name)) + max(length(p_type)) + max(length(p_size::VARCHAR)))::BIGINT AS n_chars FROM part GROUP BY p_brand",
        "modal_values": """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c)
SELECT o_custkey, o_orderpriority, n FROM r WHERE k = 1 AND n * 2 >= greatest(1, t - 2)""",
        "deck_values": """WITH a AS (SELECT p_brand, count(DISTINCT p_size) AS n_all FROM part GROUP BY p_brand), e AS (SELECT p_brand, p_type, count(DISTINCT p_size) AS n_places FROM part GROUP BY ALL)
SELECT p_brand, p_type, n_places FROM e JOIN a USING (p_brand) WHERE n_places >= 2 AND n_places * 100 >= n_all * 5""",
        "unexplained_blanks": "SELECT l_orderkey, sum((l_discount = 0)::INT + (l_tax = 0)::INT)::BIGINT AS n_blank FROM lineitem WHERE (l_discount = 0)::INT + (l_tax = 0)::INT < 2 GROUP BY l_orderkey HAVING sum((l_discount = 0)::INT + (l_tax = 0)::INT) > 0",
        "bar_axes": """WITH r AS (SELECT c_nationkey, CASE WHEN c_custkey % 11 <> 0 THEN round(c_acctbal * 100)::BIGINT END AS v FROM customer)
SELECT c_nationkey, min(coalesce(v, 0)) AS low, max(coalesce(v, 0)) AS high, count(*) FILTER (WHERE v IS NULL) AS n_missing, count(*) FILTER (WHERE v < 0) >= count(*) FILTER (WHERE v > 0) AS down FROM r GROUP BY c_nationkey""",
        "log_points": """WITH r AS (SELECT c_mktsegment, round(c_acctbal * 100)::BIGINT AS v FROM customer)
SELECT c_mktsegment, count(*) FILTER (WHERE v > 0) AS n_points, count(*) FILTER (WHERE v <= 0) AS n_dropped, min(v) FILTER (WHERE v > 0) AS low, max(v) AS high FROM r GROUP BY c_mktsegment""",
        "series_polylines": """WITH r AS (SELECT c_mktsegment, c_nationkey, round(c_acctbal * 100)::BIGINT AS y, lag(round(c_acctbal * 100)::BIGINT) OVER o AS p, lead(round(c_acctbal * 100)::BIGINT) OVER o AS n FROM customer WINDOW o AS (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey))
SELECT c_mktsegment, c_nationkey, count(*) AS n_points, count(*) FILTER (WHERE sign(y - p) * sign(n - y) < 0) AS n_turns FROM r GROUP BY ALL""",
        "edge_endpoints": """SELECT o_orderstatus, count(*) FILTER (WHERE c_custkey IS NOT NULL) AS n_kept, count(*) FILTER (WHERE c_custkey IS NULL) AS n_rejected FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY o_orderstatus""",
        "spoken_numbers": f"""SELECT o_orderstatus, sum({_int_words('floor(o_totalprice)::BIGINT')})::BIGINT AS price_words, sum({_int_words('o_orderkey')})::BIGINT AS key_words FROM orders GROUP BY o_orderstatus""",
        "spoken_lines": f"""WITH t AS (SELECT l_returnflag, 'No. ' || l_linenumber || 'th: ' || round(l_extendedprice, 2) || 'M at -' || round(l_discount, 2) || '% (' || l_quantity::INT || 'GB, ISO-' || l_orderkey || ', ΔT ≤ ' || l_quantity::INT || '.5) GPU-days.' AS text FROM lineitem)
SELECT l_returnflag, sum(w)::BIGINT AS n_plain, (sum(w) + 3 * count(*))::BIGINT AS n_named FROM (SELECT l_returnflag, {spoken_sql("text")} AS w FROM t) GROUP BY l_returnflag""",
        "axis_ticks": """WITH s AS (SELECT c_nationkey, min(round(c_acctbal * 100)::BIGINT) AS low, max(round(c_acctbal * 100)::BIGINT) AS high FROM customer GROUP BY c_nationkey), t AS (SELECT *, unnest(range(0, 5)) AS tick FROM s)
SELECT c_nationkey, tick, floor((low * (4 - tick) + high * tick) / 4)::BIGINT AS at FROM t""",
        "section_heads": """WITH l AS (SELECT doc_id, line, i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS i)),
h AS (SELECT doc_id, last_value(CASE WHEN NOT contains(line, '.') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS head FROM l)
SELECT doc_id, count(DISTINCT head) AS n_heads, count(*) FILTER (WHERE head IS NULL) AS n_headless FROM h GROUP BY doc_id""",
        "violations_rollup": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) AS n FROM ({text_sql[n]})" for n in ("unsourced_values", "banned_words", "markup_leaks", "contradicting_values")) + ") SELECT coalesce(section, 'total') AS section, sum(n)::BIGINT AS n FROM v GROUP BY ROLLUP (section)",
    }
