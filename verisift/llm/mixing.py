"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Each source has a target number of words. Whole copies of it (target div size) are taken of every document; of the rest
a hash threshold decides: words are summed by source and hash bucket, the bucket where the running sum crosses the
budget is found, and only that boundary bucket is refined with the hash's next bits, until it holds one document.
Documents are never sorted; a filter on the hash gives the mix, and a larger budget's mix contains a smaller one's.

The boundary document is taken if that brings the source nearer to its target. Documents with equal ids have equal
hashes and are taken together. A null source is a source of its own, last in order; a null text has size 0; a null id
hashes as the empty string. An empty table gives an empty mix. Summaries have a row for each source, no matter how
many documents it has; they are put in order of their names and ratios in one task, three numbers a source. Very long
texts count whole, rows that repeat each by themselves; reruns agree. With `keep`, columns keep their names whatever these
are; else only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import WORD, join_hot, release, staged, staged_so_far

BITS = 10  # of the hash, for each histogram
LEVELS = 6
FEW_SOURCES, FEW_CHARS = 100_000, 8_000_000  # up to which the table of sources is broadcast


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, cap: int = 3, share: float = 1.0) -> DataFrame:
    """(source, weight, source_size) with `target`: shares of all sizes by weight, none above cap times its source.

    What the capped sources leave goes to the others by weight: in order of cap over weight, a source is capped while
    an equal level for those that remain would exceed its own.
    """
    order = W.orderBy(F.col("ratio"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    t = sources.withColumn("ratio", cap * F.col("source_size") / F.col("weight")).withColumn("total", total * F.lit(share))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after))
    t = t.withColumn("full", F.col("level") >= F.col("ratio"))
    t = t.withColumn("free", F.first(F.when(~F.col("full"), F.col("level")), True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return t.withColumn("target", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("free") * F.col("weight"))).drop("ratio", "total", "level", "full", "free")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, copies, below): documents with h < below get one copy more. `sized` has source, size, h.

    A job for each level over ids and sizes, not texts; after the first only rows of boundary buckets are summed.
    """
    spark = sized.sparkSession
    state = budgets.select("source", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("copies"), "target", "source_size")
    state = state.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).drop("target", "source_size")
    state = staged(state.withColumn("low", F.lit(0).cast("long")), "mix-state")
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        a, b = sized.alias("a"), state.alias("b")
        inside = a.join(b, F.expr(f"a.source <=> b.source AND shiftright(a.h, {shift + BITS}) = shiftright(b.low, {shift + BITS}) AND b.left > 0") if level else F.expr("a.source <=> b.source AND b.left > 0"))
        hist = inside.groupBy(F.col("a.source").alias("source"), F.shiftright("a.h", shift).alias("bucket")).agg(F.sum("a.size").alias("words"), F.count(F.lit(1)).alias("docs"), F.min("a.h").alias("least"), F.max("a.h").alias("most"))
        run = W.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run)).alias("h")
        # the first bucket that reaches beyond the budget is the boundary; what lies before it is taken
        at = hist.join(state.alias("s"), F.expr("h.source <=> s.source")).where(F.expr("h.upto > s.left"))
        edge = at.groupBy(F.col("s.source").alias("source")).agg(F.min_by(F.struct("h.bucket", "h.upto", "h.words", "h.least", "h.most"), "h.bucket").alias("e"), F.first("s.left").alias("was"))
        edge = edge.select("source", F.shiftleft(F.col("e.bucket"), shift).alias("low"), (F.col("was") - F.col("e.upto") + F.col("e.words")).alias("left"), F.col("e.words").alias("words"), F.when(F.col("e.least") == F.col("e.most"), F.col("e.most")).alias("single"))
        s, e = state.alias("s"), edge.alias("e")
        joined = s.join(e, F.expr("s.source <=> e.source"), "left")
        take = F.expr("2 * e.left >= e.words")  # one document is left: taken if that is nearer
        # no boundary: the budget takes all that is left of the last boundary bucket
        low = F.when(F.col("s.left") <= 0, F.col("s.low")).when(F.col("e.low").isNull(), F.col("s.low") + (F.lit(1).cast("long") * (1 << (shift + BITS)))).when(F.col("e.single").isNotNull(), F.when(take, F.col("e.single") + 1).otherwise(F.col("e.single"))).otherwise(F.col("e.low"))
        rest = F.when(F.col("e.low").isNull() | F.col("e.single").isNotNull(), F.lit(0.0)).otherwise(F.col("e.left"))
        new = staged(joined.select("s.source", "s.copies", rest.alias("left"), low.alias("low")), "mix-state")
        state = new
        if not state.where("left > 0").limit(1).count():
            break
    return state.select("source", "copies", F.col("low").alias("below"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0, keep: bool = False, few_sources: int = FEW_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes) and copies; with `keep` the input's columns, each
    row as often as the mix takes it. Weights repeat over the sources in code point order, null last."""
    mark = staged_so_far()
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), hash60(F.col(f"`{doc_id}`")).alias("h"))
    sized = staged(sized, "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    plan = staged(targets(per.withColumn("weight", weight), cap, share), "mix-targets")
    cut = thresholds(sized, plan).alias("c")
    p = plan.alias("p")
    decided = p.join(cut, F.expr("p.source <=> c.source")).select("p.source", "p.source_size", "p.target", "c.copies", "c.below")
    n, chars = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    few = n <= few_sources and chars <= FEW_CHARS
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))

    def with_plan(rows: DataFrame) -> DataFrame:
        """Rows (source, h, ...) with their source's plan and `copies`; beyond a broadcast, hot sources are not dealt by key."""
        if few:
            out = rows.alias("r").join(F.broadcast(decided).alias("q"), F.expr("r.source <=> q.source")).select("r.*", "q.source_size", "q.target", "q.copies", "q.below")
        else:
            out = join_hot(rows.withColumn("k", key), decided.withColumn("k", key).drop("source"), "k").drop("k")
        return out.withColumn("copies", F.col("copies") + (F.col("h") < F.col("below")).cast("int"))

    if keep:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("source"), hash60(F.col(f"`{doc_id}`")).alias("h"))
        out = with_plan(rows).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    else:
        out = with_plan(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    release(mark, out)
    return out
