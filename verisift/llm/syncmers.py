"""Document fingerprints of closed syncmers, with DataFrame expressions only.

Tokens are words (cut after 24 code points; signs of scripts written without spaces are tokens of their own) between
start and end marks. A run of k tokens is an anchor if the least hash among its inner runs of s tokens is that of the
first or the last inner run. Whether it is depends on those k tokens alone, so a change elsewhere in the text neither adds
nor removes it, and the order and place of anchors can be matched position by position. The fingerprint lists the
anchors' 32-bit hashes, in order, as eight hexadecimal digits each.

A null text is an empty one; an empty text, or one of white space only, has the empty fingerprint. Equal texts have
equal fingerprints. Two empty fingerprints are wholly alike (1), an empty and another not at all (0). Very long texts are
fingerprinted whole; rows that repeat follow each other; an empty table gives an empty result. Only the named columns are
read, so others cannot clash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K, S = 8, 2
# fixed values: Thai and Lao, Myanmar, Khmer, and the East Asian ideographs and syllables, as ranges, which match much
# faster than script names
_ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_TOKEN = rf"[^\x20\x09-\x0D{_ALONE}]{{1,24}}+|[{_ALONE}]"


def token_hashes(text: Column) -> Column:
    """The text's token hashes between k - 1 start and k - 1 end marks; empty for a text without tokens."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    marks = [F.array(*[F.xxhash64(F.lit(f"{name}{i}")) for i in range(K - 1)]) for name in ("<", ">")]
    return F.when(F.size(tokens) > 0, F.concat(marks[0], tokens, marks[1])).otherwise(F.array().cast("array<bigint>"))


def inner_hashes(tokens: str) -> Column:
    """Hashes of the runs of s tokens of an array column."""
    parts = ", ".join(f"{tokens}[i + {j}]" for j in range(S))
    return F.expr(f"IF(size({tokens}) < {K}, CAST(array() AS array<bigint>), transform(sequence(0, size({tokens}) - {S}), i -> xxhash64({parts})))")


def anchor_places(inner: str) -> Column:
    """Start tokens of the closed syncmers: the least of the w inner runs is the first or the last."""
    w = K - S + 1
    first = " AND ".join(f"{inner}[i] <= {inner}[i + {j}]" for j in range(1, w))
    last = " AND ".join(f"{inner}[i + {w - 1}] <= {inner}[i + {j}]" for j in range(w - 2, -1, -1))
    return F.expr(f"IF(size({inner}) < {w}, CAST(array() AS array<int>), filter(sequence(0, size({inner}) - {w}), i -> ({first}) OR ({last})))")


def anchor_hashes(inner: str, places: str) -> Column:
    """32-bit hashes of the anchors; their k tokens are covered by every s-th inner run."""
    parts = ", ".join(f"{inner}[p + {j}]" for j in range(0, K - S + 1, S))
    return F.expr(f"transform({places}, p -> shiftrightunsigned(xxhash64({parts}), 32))")


def with_anchors(df: DataFrame, text: str, out: str, places: str | None = None) -> DataFrame:
    """`df` with the anchors of a text column as `out` (array of long below 2^32), and their places if a name is given."""
    tmp = [f"__{out}_{x}" for x in "hsp"]
    df = df.withColumn(tmp[0], token_hashes(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(tmp[1], inner_hashes(tmp[0])).withColumn(tmp[2], anchor_places(tmp[1]))
    df = df.withColumn(out, anchor_hashes(tmp[1], tmp[2]))
    if places:
        df = df.withColumn(places, F.col(tmp[2]))
    return df.drop(*tmp)


def fingerprint(anchors: str) -> Column:
    return F.array_join(F.transform(F.col(anchors), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints' anchors."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    united = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(united == 0, F.lit(1.0)).otherwise(common / united)


def aligned(a: str, a_places: str, b: str, b_places: str) -> Column:
    """Anchors that both texts have at the same place: the positional match of edits that keep a text's start."""
    at = lambda x, p: F.arrays_zip(F.col(x).alias("x"), F.col(p).alias("p"))
    return F.size(F.array_intersect(at(a, a_places), at(b, b_places)))


CELLS = 1000  # quantile cells of the ids; cells are cut evenly from there


def _ranges(docs: DataFrame, per_range: int, max_ranges: int) -> tuple[Column, Column, Column]:
    """(range of a known id, range of a null id by `h`, part of a range by `h`): numbers that grow in the order wanted.

    Only ids that hold more than a cell's share of the rows, so fewer than CELLS, have ranges of more than one part.
    """
    n, known, low, high = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    per_range = max(per_range, n // max_ranges)
    bits = min(40, ((n - known) // per_range).bit_length())
    of_null = F.shiftright("h", 64 - bits) + ((1 << (bits - 1)) + 1) if bits else F.lit(1)
    wanted = known // per_range
    if wanted < 2:
        return F.lit(0), of_null, F.lit(0)
    cells = min(CELLS, wanted)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], 10 * CELLS)).first()[0]
    often = {c: k for c, k in Counter(cuts).items() if k > 1}  # an id between two cuts has at least a cell of its own
    edges = sorted({low - 1, high, *[c for c in cuts if c < high], *[c - 1 for c in often if c - 1 >= low]})
    part = F.lit(0).cast("long")
    for c, k in often.items():
        parts = min(40, ((k + 1) * wanted // cells).bit_length())
        part = F.when(F.col("doc_id") == c, F.shiftright("h", 64 - parts)).otherwise(part) if parts else part
    steps, m = (len(edges) - 1).bit_length() + 1, -(-wanted // (len(edges) - 1))
    array = "array(" + ", ".join(f"{e}L" if e > -(2**63) else "bigint(-9223372036854775807)" for e in edges) + ")"
    # binary search for the cell (edges[x], edges[x + 1]] that holds the id, then an even share of that cell
    find = f"aggregate(sequence(1, {steps}), struct(0 AS lo, {len(edges) - 1} AS hi, {array} AS e), (s, _) -> IF(s.hi - s.lo <= 1, s, IF(s.e[(s.lo + s.hi) div 2] < doc_id, named_struct('lo', int((s.lo + s.hi) div 2), 'hi', s.hi, 'e', s.e), named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2), 'e', s.e))), s -> bigint(s.lo) * {m} + least({m - 1}, bigint(floor((double(doc_id) - double(s.e[s.lo]) - 1) * {m} / (double(s.e[s.hi]) - double(s.e[s.lo]))))))"
    return -F.expr(find), of_null, part


def with_next(docs: DataFrame, per_range: int = 256, max_ranges: int = 200_000) -> DataFrame:
    """Rows (doc_id, t) with a range (`bucket`, `part`) and `h`; sorted in it, each row's next stands right behind it.

    Order: doc_id descending, nulls last (equal ids and nulls by a hash of the text), and the first again after the last.
    Ids are cut into ranges at their quantiles; the range of a null id, and the parts of a range that one id fills, come
    from the hash. Each range also gets a copy of the next range's first row (`guest`), so no window spans the table; only
    one row a range (about max_ranges at most) is put in order at once, and broadcast.
    """
    h = F.xxhash64(F.coalesce("t", F.lit("")))
    of_known, of_null, part = _ranges(docs, per_range, max_ranges)
    rows = docs.withColumn("h", h).withColumn("bucket", F.when(F.col("doc_id").isNull(), of_null).otherwise(of_known).cast("long")).withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("long"))
    place = F.struct("bucket", "part")
    first = rows.groupBy("bucket", "part").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("g"))).alias("top"))
    over = W.orderBy("bucket", "part")
    heads = first.select("bucket", "part", F.col("top.doc_id").alias("head_id"), F.bitwise_not("top.g").alias("head_h"), F.lag(place).over(over).alias("before"), F.max(place).over(W.partitionBy()).alias("final"))
    heads = heads.select("bucket", "part", "head_id", "head_h", F.coalesce("before", "final").alias("before"))
    a, b = rows.alias("a"), heads.alias("b")
    joined = a.join(F.broadcast(b), F.expr("a.bucket = b.bucket AND a.part = b.part AND a.doc_id <=> b.head_id AND a.h = b.head_h"), "left")
    own = F.struct(F.col("a.bucket").alias("bucket"), F.col("a.part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("b.before.bucket").alias("bucket"), F.col("b.before.part").alias("part"), F.lit(True).alias("guest"))
    both = joined.select("a.doc_id", "a.t", "a.h", F.explode(F.when(F.col("b.before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("o"))
    return both.select("doc_id", "t", "h", "o.bucket", "o.part", "o.guest")


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and the next document's.

    Edited: the last third of the code points (rounded down) gives way to as many of the next document's first.
    """
    rows = with_next(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")))
    order = W.partitionBy("bucket", "part").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    third = (F.length("t") / 3).cast("int")
    rows = rows.withColumn("t", F.coalesce("t", F.lit(""))).withColumn("next_t", F.lead("t").over(order))
    rows = with_anchors(rows, "t", "a").withColumn("next_a", F.lead("a").over(order)).where("NOT guest")
    rows = rows.withColumn("e", F.concat(F.substring("t", F.lit(1), F.length("t") - third), F.substring(F.coalesce("next_t", "t"), F.lit(1), third)))
    rows = rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "e", "a", F.coalesce("next_a", "a").alias("next_a"))
    rows = with_anchors(rows, "e", "b")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint("a").alias("fingerprint"), fingerprint("b").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "next_a").alias("near_next"))
