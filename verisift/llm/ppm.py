"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie: how often each byte followed each context of up to `order` bytes in the training texts.
A byte's probability is its share in the longest context seen; where it never followed that context, an escape (method C:
distinct followers over followers and distinct ones) leads to the next shorter one, in which the bytes that the longer
context knew are excluded; below the empty context all bytes not yet excluded are equally likely. Counts are fixed
while scoring, so each escape's exclusions depend on the context alone and are worked out once: a text's code length is a sum of
table entries. A text is read as its words in A-Z lower case with one space between, and an end byte.

Counts of the longest contexts are gathered from all training texts by a shuffle; shorter contexts are sums of them. A
byte that followed its longest context has the share of one row in another, worked out for all such pairs at once. The
most frequent pairs, at most `max_nodes` whatever the corpus, are broadcast and sum up most of a text in one map pass;
of a text's other pairs the distinct ones are joined with the table of all. Pairs that no training text has, in the end,
need the escapes: they are dealt, with the counts of contexts that end in the same three bytes, into groups, and each
group builds the part of the trie that it needs. Three bytes have 2^24 pairs of longer context and byte at most, so a
group is bounded; only the counts of one byte and the next, 65,536 at most, are broadcast to it. Nothing is pruned and
`max_nodes` has no say in the result.

The base is the smoothed unigram model of words, with an end token for each text. The most frequent words, at most
`max_words`, are broadcast; the words of a text that are not among them are joined with the counts of the others.

Nulls: a null text is empty (its end token only); a null doc_id counts as the text "" in the fold. Rows that repeat get
equal scores, and so do reruns: what joins add is summed in whole numbers. Very long texts are scored a chunk of rows at
a time, one text at least. Without training rows all counts are 0, and each byte has a probability of 1/256. An empty
table gives an empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import release, staged, staged_so_far
from ._words import U, Words, chunks

ORDER = 5
TAIL = 3  # bytes at a context's end by which contexts are dealt
UNIT = 2.0**32  # of the logarithms that joins sum up
END = 10  # a line feed is in no word
EDGE = np.uint64(0x8C5FB1B34DFE2A17)  # the end token's hash
GOLDEN = 0x9E3779B97F4A7C15


def streams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as normalised bytes, each after `order` end bytes and before one; (bytes, first byte behind the padding)."""
    raw, pad, out, first, at = data.tobytes(), bytes([END]) * order, [], [], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = b" ".join(raw[a:b].lower().split())
        out += [pad, text, b"\n"]
        first.append(at + order)
        at += order + len(text) + 1
    return np.frombuffer(b"".join(out), np.uint8), np.array(first + [at + order], np.int64)


def codes(stream: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the texts, it and the `order` bytes before as one number, the byte itself lowest."""
    x = stream.astype(np.uint64)
    out = np.zeros(max(0, len(x) - order), np.uint64)
    for j in range(order + 1):
        out |= x[order - j : len(x) - j] << U(8 * j)
    keep = np.ones(len(out), bool)
    for a in first[1:-1].tolist():  # drop the places of the padding
        keep[a - 2 * order : a - order] = False
    return out[keep]


def _train(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): kind 0 counts contexts with their next byte, kind 1 words of the training rows (t)."""

    def run(batches):
        grams, words = [], []

        def merged(parts):
            key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            key, at = np.unique(key, return_inverse=True)
            return key, np.bincount(at, n).astype(np.int64)

        def rows(kind, parts):
            key, n = parts
            for j in range(0, len(key), 500_000):
                k = key[j : j + 500_000]
                yield pa.record_batch({"kind": pa.array(np.full(len(k), kind, np.int8)), "key": pa.array(k.view(np.int64)), "n": pa.array(n[j : j + 500_000])})

        for batch in batches:
            for _, data, offsets in chunks(batch.column(0), 1_000_000):
                grams.append(np.unique(codes(*streams(data, offsets, order), order), return_counts=True))
                w = Words(data, offsets, lower=True)
                words.append(np.unique(np.append(w.h, np.full(len(offsets) - 1, EDGE)), return_counts=True))
                for kind, parts in ((0, grams), (1, words)):
                    if sum(len(p[0]) for p in parts) > 1_500_000:
                        parts[:] = [merged(parts)]
                        if len(parts[0][0]) > 750_000:
                            yield from rows(kind, parts.pop())
            pa.default_memory_pool().release_unused()
        for kind, parts in ((0, grams), (1, words)):
            if parts:
                yield from rows(kind, merged(parts))

    counts = docs.mapInArrow(run, "kind byte, key long, n long")
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# An open-addressing hash table from 64-bit keys to rows of float32: (bits, keys, values). Plain data, as models are
# broadcast and workers need no class of this package to read them.
FREE = np.uint64(2**64 - 1)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys ^ (keys >> U(29))) * U(GOLDEN) >> U(64 - bits)).astype(np.int64)


def table(keys: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    bits = max(4, int(1.25 * len(keys)).bit_length())
    held, values = np.full(1 << bits, FREE), np.zeros((1 << bits, rows.shape[1]), np.float32)
    left, at = np.arange(len(keys)), _slots(keys, bits)
    while len(left):
        free = held[at] == FREE
        held[at[free]] = keys[left[free]]  # of several the last stays
        won = held[at] == keys[left]
        values[at[won]] = rows[left[won]]
        left, at = left[~won], (at[~won] + 1) & ((1 << bits) - 1)
    return bits, held, values


def find(among: tuple[int, np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the values, found) for many keys at once."""
    bits, held, _ = among
    at = _slots(keys, bits)
    slot = held[at]
    found = slot == keys
    left = np.flatnonzero(~found & (slot != FREE))
    while len(left):
        at[left] = (at[left] + 1) & (len(held) - 1)
        slot = held[at[left]]
        hit = slot == keys[left]
        found[left[hit]] = True
        left = left[~hit & (slot != FREE)]
    return at, found


def build(keys: np.ndarray, n: np.ndarray, order: int, middle: tuple[np.ndarray, np.ndarray], low: tuple[np.ndarray, np.ndarray]) -> dict:
    """The model of some contexts' ends: for each order a table of (context, byte) and one of contexts.

    keys, n: the counts of `order` bytes and the next whose contexts have these ends of TAIL bytes; middle: those of
    TAIL - 1 bytes and the next, of these ends at least; low: all those of fewer bytes.
    Entries of a byte: log count, log share in its context. Of a context: log escape; then for the next shorter
    context with this one's bytes excluded: log of what is left with its escapes, log of its escape, whether any is left.
    """
    by_order: dict[int, tuple] = {}
    for k in range(order, -1, -1):
        source = (keys, n) if k >= TAIL else middle if k == TAIL - 1 else low
        g, at = np.unique(source[0] & U((1 << (8 * (k + 1))) - 1), return_inverse=True)
        by_order[k] = g, np.bincount(at, source[1], minlength=len(g)).astype(np.float64) if len(g) else np.zeros(0)
    tables: dict = {"order": order, "grams": [], "contexts": [], "root": (0.0, 0)}
    sums: dict[int, tuple] = {}
    for k in range(order + 1):
        g, c = by_order[k]
        ctx, at = np.unique(g >> U(8), return_inverse=True)
        sums[k] = ctx, at, np.bincount(at, c, minlength=len(ctx)) if len(ctx) else np.zeros(0), np.bincount(at, minlength=len(ctx)) if len(ctx) else np.zeros(0)
    for k in range(order + 1):
        g, c = by_order[k]
        ctx, at, total, kinds = sums[k]
        with np.errstate(divide="ignore"):
            tables["grams"].append(table(g, np.stack([np.log(c), np.log(c) - np.log(total + kinds)[at]], axis=1) if len(g) else np.zeros((0, 2))))
            if k == 0:
                tables["root"] = (float(np.log(kinds[0]) - np.log(total[0] + kinds[0])), int(kinds[0])) if len(ctx) else (0.0, 0)
                tables["contexts"].append(None)
                continue
            up_g, up_c = by_order[k - 1]
            up_ctx, _, up_total, up_kinds = sums[k - 1]
            # counts that this context's bytes have in the next shorter context
            known = np.bincount(at, up_c[np.searchsorted(up_g, g & U((1 << (8 * k)) - 1))], minlength=len(ctx)) if len(g) else np.zeros(0)
            up = np.searchsorted(up_ctx, ctx & U((1 << (8 * (k - 1))) - 1))
            rest, rest_kinds = (up_total[up] - known, up_kinds[up] - kinds) if len(ctx) else (np.zeros(0), np.zeros(0))
            some = rest_kinds > 0
            values = np.stack([np.log(kinds) - np.log(total + kinds), np.where(some, np.log(np.maximum(rest + rest_kinds, 1)), 0), np.where(some, np.log(np.maximum(rest_kinds, 1)), 0), some], axis=1) if len(ctx) else np.zeros((0, 4))
            tables["contexts"].append(table(ctx, values))
    return tables


def log_probabilities(model: dict, code: np.ndarray) -> np.ndarray:
    """The natural logarithm of each byte's probability after the bytes before it."""
    order, grams, contexts = model["order"], model["grams"], model["contexts"]
    out = np.zeros(len(code))
    left = np.arange(len(code))
    above = np.zeros((len(code), 3))  # of the context just escaped from: what is left in the next one
    escaped = np.zeros(len(code), bool)
    for k in range(order, -1, -1):
        key = code[left] & U((1 << (8 * (k + 1))) - 1)
        at, found = find(grams[k], key)
        values = grams[k][2][at[found]]
        from_above, got = escaped[left[found]], left[found]
        out[got] += np.where(from_above, values[:, 0] - above[got, 0], values[:, 1])
        left = left[~found]
        if not len(left):
            break
        if k == 0:
            root, kinds = model["root"]
            out[left] += np.where(escaped[left], np.where(above[left, 2] > 0, above[left, 1] - above[left, 0], 0.0), root) - np.log(256 - kinds)
            break
        at, found = find(contexts[k], code[left] >> U(8) & U((1 << (8 * k)) - 1))
        know, values = left[found], contexts[k][2][at[found]]
        out[know] += np.where(escaped[know], np.where(above[know, 2] > 0, above[know, 1] - above[know, 0], 0.0), values[:, 0])
        above[know] = values[:, 1:4]
        escaped[know] = True
    return out


def _frequent(counts: DataFrame, most: int):
    """The rows (key, n) above a bound on n that leaves at most `most` of them, as arrays, and the bound; 1: all rows."""
    cell = F.floor(F.log2("n") * 8).cast("int")
    left, least, sizes = 0, 0, {r.cell: r["count"] for r in counts.groupBy(cell.alias("cell")).count().collect()}  # 505 cells at most
    for c in sorted(sizes, reverse=True):
        left += sizes[c]
        if left > most:
            least = c + 1
            break
    rows = counts.where(cell >= least).select("key", "n").toArrow()
    return rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy(), cell < least if least else None


def _context(key, bytes_: int = 7):
    """The (last) bytes of a pair's context."""
    return F.shiftright(key, 8).bitwiseAND(F.lit((1 << (8 * bytes_)) - 1))


def pair_scores(counts: DataFrame) -> DataFrame:
    """(key, n, s): the logarithm of each training pair's share in its longest context."""
    over = W.partitionBy(_context(F.col("key")))
    return counts.select("key", "n", (F.log("n") - F.log(F.sum("n").over(over) + F.count("n").over(over))).alias("s"))


def unseen_scores(counts: DataFrame, unseen: DataFrame, order: int, group: int = 500_000) -> DataFrame:
    """(key, s): the logarithms of the probabilities of pairs (key) that no training text has, from all training counts."""
    spark = counts.sparkSession
    unseen = unseen.withColumn("end", _context(F.col("key"), TAIL))
    ends = staged(unseen.select("end").distinct(), "ends")
    mine = staged(counts.withColumn("end", _context(F.col("key"), TAIL)).join(ends, "end", "left_semi"), "end-counts")
    groups = max(1, (mine.count() + unseen.count()) // group)
    number = F.pmod(F.xxhash64("end"), F.lit(groups))
    # counts of TAIL - 1 bytes and the next go to each group that has such an end
    asks = ends.select(F.col("end").bitwiseAND((1 << (8 * (TAIL - 1))) - 1).alias("short"), number.alias("g")).distinct()
    short = counts.groupBy(F.col("key").bitwiseAND((1 << (8 * TAIL)) - 1).alias("key")).agg(F.sum("n").alias("n"))
    middle = short.withColumn("short", F.shiftright("key", 8)).join(asks, "short").select("g", F.lit(1).alias("kind"), "key", "n")
    low = short.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 at most
    sent = spark.sparkContext.broadcast((low["key"].to_numpy().astype(np.uint64), low["n"].to_numpy()))

    def solve(rows: pa.Table) -> pa.Table:
        kind, key, n = rows["kind"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        asked = key[kind == 2]
        if not len(asked):
            return pa.table({"key": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        model = build(key[kind == 0], n[kind == 0], order, (key[kind == 1], n[kind == 1]), sent.value)
        return pa.table({"key": pa.array(asked.view(np.int64)), "s": pa.array(log_probabilities(model, asked))})

    rows = mine.select(number.alias("g"), F.lit(0).alias("kind"), "key", "n").unionAll(middle)
    rows = rows.unionAll(unseen.select(number.alias("g"), F.lit(2).alias("kind"), "key", F.lit(0).cast("long").alias("n")))
    return rows.groupBy("g").applyInArrow(solve, "key long, s double")


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, max_nodes: int = 3_000_000, max_words: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; logarithms of base 10."""
    if order < TAIL:
        raise ValueError(f"contexts have {TAIL} bytes at least")
    spark, mark = docs.sparkSession, staged_so_far()
    fold = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{doc_id}`").alias("i"), fold.alias("held_out"))
    counts = staged(_train(rows.where("NOT held_out").select("t"), order), "counts")
    of_words, of_pairs = counts.where("kind = 1").select("key", "n"), counts.where("kind = 0").select("key", "n")
    words, tokens = of_words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    norm = float(np.log10(tokens + 0.5 * (words + 1))) if tokens else float(np.log10(0.5))
    pairs = staged(pair_scores(of_pairs), "pair-scores")
    key, n, other_pairs = _frequent(pairs, max_nodes)
    scores = pairs.where(~other_pairs) if other_pairs is not None else pairs
    got = scores.select("key", "s").toArrow()
    model = table(got["key"].to_numpy().view(np.uint64), got["s"].to_numpy().astype(np.float32).reshape(-1, 1))
    del got
    key, n, other_words = _frequent(of_words, max_words)
    by = np.argsort(key)
    sent = spark.sparkContext.broadcast((model, key[by], np.log10(n[by] + 0.5)))
    del model, key, n, by
    kind = dict(rows.dtypes)["i"]
    done = rows.mapInArrow(_pass(sent, order, norm, other_words is None), f"i {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, pairs array<long>, times array<int>")
    done = staged(done.withColumn("r", F.monotonically_increasing_id()), "scored")
    out = done.drop("rare", "pairs", "times")
    if other_words is not None:
        asked = done.select("r", F.explode("rare").alias("key"))
        value = F.round((F.log10(F.coalesce("n", F.lit(0)) + 0.5) - norm) * UNIT).cast("long")
        answer = asked.join(of_words.where(other_words), "key", "left").groupBy("r").agg(F.sum(value).alias("b"), F.count("n").alias("k"))
        out = out.join(answer, "r", "left").withColumn("base_score", F.col("base_score") + F.coalesce(F.col("b") / UNIT, F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("k", F.lit(0))).drop("b", "k")
    asked = staged(done.select("r", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("r", F.col("x.pairs").alias("key"), F.col("x.times").alias("times")), "asked")
    wanted = staged(asked.select("key").distinct(), "wanted")
    rare = pairs.where(other_pairs).select("key", "s") if other_pairs is not None else pairs.limit(0).select("key", "s")
    found = staged(wanted.join(rare, "key", "left"), "found")
    answers = found.where("s IS NOT NULL").unionByName(unseen_scores(of_pairs, found.where("s IS NULL").select("key"), order))
    answers = staged(answers.select("key", F.round(F.col("s") / float(np.log(10)) * UNIT).cast("long").alias("s")), "answers")
    sums = asked.join(answers, "key").groupBy("r").agg(F.sum(F.col("s") * F.col("times")).alias("more"))
    out = out.join(sums, "r", "left").withColumn("score", F.col("score") + F.coalesce(F.col("more") / UNIT, F.lit(0.0)))
    out = out.select(F.col("i").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
    release(mark, out)
    return out


def _unigrams(w: Words, words, logs, norm: float, all_words: bool):
    """(n_known, base, rare words) of each text; where not all words are in `words`, others are left to be asked for."""
    many = len(w.first) - 1
    h, at = np.unique(np.append(w.h, EDGE), return_inverse=True)
    place = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
    known = (words[place] == h) if len(words) else np.zeros(len(h), bool)
    value = np.where(known, logs[place] if len(words) else 0.0, np.log10(0.5) if all_words else norm) - norm
    value, known = value[at], known[at]
    sums = [np.concatenate([[0], np.cumsum(x[:-1].astype(np.float64))]) for x in (value, known)]
    base, n_known = [s[w.first[1:]] - s[w.first[:-1]] + float(x[-1]) for s, x in zip(sums, (value, known))]
    rare = np.zeros(0, np.int64)
    ends = np.zeros(many + 1, np.int64)
    if not all_words:
        # the end token is in each text; should it be rare, it is asked for like a word
        missed = np.flatnonzero(~known[:-1])
        rare, ends = w.h[missed].view(np.int64), np.searchsorted(missed, w.first)
        if not known[-1]:
            rare, ends = np.insert(rare, ends[1:], EDGE.astype(np.uint64).view(np.int64)), ends + np.arange(many + 1)
    return np.round(n_known).astype(np.int64), base, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rare))


def _pass(sent, order: int, norm: float, all_words: bool):
    """Rows (t, i, held_out) to what the broadcast model knows of each, and the words and pairs to ask for."""

    def run(batches):
        model, words, logs = sent.value
        for batch in batches:
            for row, data, offsets in chunks(batch.column(0), 400_000):
                many = len(offsets) - 1
                w = Words(data, offsets, lower=True)
                n_known, base, rare = _unigrams(w, words, logs, norm, all_words)
                stream, first = streams(data, offsets, order)
                code = codes(stream, first, order)
                ends = np.concatenate([[0], np.cumsum(np.diff(first) - order)])
                at, found = find(model, code)
                log_p = np.where(found, model[2][at, 0], 0).astype(np.float64)
                total = np.add.reduceat(log_p, ends[:-1]) / np.log(10)
                missed = np.flatnonzero(~found)
                text = np.searchsorted(ends, missed, "right") - 1
                by = np.lexsort((code[missed], text))
                key, text = code[missed][by], text[by]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(key))).astype(np.int32)
                cuts = pa.array(np.searchsorted(text[new], np.arange(many + 1)).astype(np.int32))
                part = batch.slice(row, many)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(w.n.astype(np.int64) + 1), pa.array(n_known), pa.array(base), pa.array(total), rare, pa.ListArray.from_arrays(cuts, pa.array(key[new].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times))],
                    names=["i", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "pairs", "times"],
                )

    return run
