"""Jaccard self-join of word-shingle sets by prefix filters under several global token orders.

A set's tokens are 64-bit shingle hashes. Every order puts shingles with a rare word first (by the power of two of the
rarest word's count, in a count sketch of fixed size) and differs in the hash that breaks ties; sets that reach the
threshold share a token in their prefixes under each order. The first order finds candidates, the prefixes of the other orders must meet too, and
only then whole sets are compared.

Between the first order and the others stands an exact filter of 256 bits a set: the parity of the number of tokens in
each of 256 cells. A token that only one of two sets has changes one parity, so sets whose parities differ in more
cells than tokens may differ cannot link.

Equal sets are one class with one representative: its 64-bit hash, the node. A second hash, of other shingle hashes, and
the size tell whether different sets share a node (some few in 10^10); such nodes are told apart by all three, so that a
class holds equal sets only, by 128 bits and size. Sets under 9 tokens (at 90 %) can only equal one another.

Inside a token's bucket the member with the token earliest in its prefix is the leader; pairs with the leader are
compared first, and only pairs of members that are still in different components after that are compared as well, so a
large group of near copies needs no pair of each two. Buckets that hold more than `crowd` sets then are split by a second
token: sets that link share two tokens at least in prefixes that are one token longer, so only pairs that meet in two
tokens are listed. Components do not depend on this: each pair that may link is compared or already connected.

`one_of_each` decides by row, not by id: rows that share an id, or have none, go or stay by their own texts.

Nulls: a null text or one without words has an empty set, links with nothing and is its own component; a null doc_id
counts as larger than any other, a component of such rows alone has a null id. Repeated rows are equal sets. Very long
texts are sets like others. An empty table gives an empty result. Columns keep their names, whatever these are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import bloom_has, bloom_of, drop_staged, filter_bits, join_hot, release, staged, staged_so_far
from ._words import U, Words, chunks, mix, sliding_min
from .components import components

SKETCH_BITS = 21
SKETCH_CHUNK = 1 << 15
SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
CROWD = 2000
MAX_CLASHES = 100_000


def shingle_sets(column, k: int, classes: np.ndarray | None = None, clashes: frozenset = frozenset(), node_bits: int = 64):
    """Of each text of an Arrow column (A-Z lower-cased): its sorted distinct shingle hashes, their classes, node and
    second hash (None, None for a set without tokens; the second hash only where a clash asks for it, or without classes)."""
    import xxhash

    cut = (1 << node_bits) - 1
    for _, data, offsets in chunks(column):
        w = Words(data, offsets, lower=True)
        g, second = w.windows(k), classes is None or len(clashes) > 0
        other = w.windows(k, 1) if second else None
        raw, start, end = w.plain() if (w.n < k).any() else (b"", None, None)
        rare = np.zeros(len(g), np.uint8) if classes is None else sliding_min(classes[(w.h >> U(64 - SKETCH_BITS)).astype(np.int64)], k)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= k:
                s, at = np.unique(g[a : b - k + 1], return_index=True)
                node = xxhash.xxh3_64_intdigest(s) & cut
                check = xxhash.xxh3_64_intdigest(other[a : b - k + 1][at], seed=1) if second else None
                kinds = rare[a : b - k + 1][at]
            elif b > a:
                both = xxhash.xxh3_128_intdigest(raw[start[a] : end[b - 1]], seed=2)
                node, check = both & cut, both >> 64
                s, kinds = np.array([both & (2**64 - 1)], np.uint64), np.zeros(1, np.uint8)
            else:
                yield g[:0], np.zeros(0, np.uint8), None, None
                continue
            if node in clashes:
                node = xxhash.xxh3_64_intdigest(f"{node} {check} {len(s)}".encode())
            yield s, kinds, _signed(node), None if check is None else _signed(check)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _need(n, t: int):
    return (n * t + 99) // 100


def _prefix(s: np.ndarray, rare: np.ndarray, order: int, t: int, more: int = 0) -> np.ndarray:
    """The set's prefix under an order, rare tokens first, and as many tokens more."""
    p = len(s) - _need(len(s), t) + 1 + more
    key = (rare.astype(np.uint64) << U(56)) | (mix(s ^ U(SALTS[order])) >> U(8))
    at = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[at[np.argsort(key[at])]]


def _parity(s: np.ndarray) -> np.ndarray:
    """Whether the number of the set's tokens in each of 256 cells is odd: four 64-bit numbers."""
    odd = np.bincount((mix(s ^ U(0xBE5466CF34E90C6C)) >> U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_table(docs: DataFrame, k: int, text: str = "text", doc_id: str = "doc_id", clashes: frozenset = frozenset(), node_bits: int = 64) -> tuple[DataFrame, np.ndarray, frozenset]:
    """(i, n, node, v, q: parities) of each row, written down; each sketch cell's class: the power of two of its count;
    the nodes that several different sets would have, which are replaced by others."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, node, v, q = [], [], [], []
            for s, _, own, check in shingle_sets(batch.column(0), k, None, clashes, node_bits):
                n.append(len(s))
                node.append(own)
                v.append(check)
                q.append(_parity(s))
            for _, data, offsets in chunks(batch.column(0)):
                np.add.at(counts, (Words(data, offsets, lower=True).h >> U(64 - SKETCH_BITS)).astype(np.int64), 1)
            m = len(n)
            yield pa.record_batch({"i": batch.column(1), "n": pa.array(n, pa.int32()), "node": pa.array(node, pa.int64()), "v": pa.array(v, pa.int64()), "q": pa.array(q, pa.list_(pa.int64())), "chunk": pa.nulls(m, pa.int32()), "data": pa.nulls(m, pa.binary())})
        import zlib

        for c in range(0, len(counts), SKETCH_CHUNK):
            part = counts[c : c + SKETCH_CHUNK].astype(np.uint32)
            if part.any():
                none = {x: pa.nulls(1, kind) for x, kind in (("i", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("v", pa.int64()), ("q", pa.list_(pa.int64())))}
                yield pa.record_batch(none | {"chunk": pa.array([c // SKETCH_CHUNK], pa.int32()), "data": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        import zlib

        total = np.zeros(SKETCH_CHUNK, np.int64)
        for data in table.column("data").to_pylist():
            total += np.frombuffer(zlib.decompress(data), np.uint32)
        classes = np.where(total > 0, np.log2(np.maximum(total, 1)).astype(np.uint8), 0).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk")[:1], "data": [zlib.compress(classes.tobytes(), 1)]})

    source = docs.select(F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long"))
    rows = staged(source.mapInArrow(run, "i long, n int, node long, v long, q array<long>, chunk int, data binary"), "sets")
    sets = rows.where("chunk IS NULL").select("i", "n", "node", "v", "q")
    if not clashes:
        ends = sets.where("node IS NOT NULL").groupBy("node").agg(*[f(c).alias(f"{name}_{c}") for c in ("v", "n") for name, f in (("lo", F.min), ("hi", F.max))])
        found = ends.where("lo_v <> hi_v OR lo_n <> hi_n").select("node").limit(MAX_CLASHES + 1).collect()
        if len(found) > MAX_CLASHES:
            raise RuntimeError("too many sets share 64-bit hashes")
        if found:
            drop_staged(docs.sparkSession, rows.staged_path)
            return class_table(docs, k, text, doc_id, frozenset(r.node % (1 << 64) for r in found), node_bits)
    import zlib

    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows.where("chunk IS NOT NULL").select("chunk", "data").groupBy("chunk").applyInArrow(add, "chunk int, data binary").collect():
        classes[r.chunk * SKETCH_CHUNK : (r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return sets, classes, clashes


def _prefix_rows(docs: DataFrame, text: str, k: int, t: int, model) -> DataFrame:
    """(token, node, n, pos, p) of the first order's prefixes of p tokens, and one token more."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes, pos, short = [], [], [], [], []
            for s, rare, node, _ in shingle_sets(batch.column(0), k, *model.value):
                if _need(len(s), t) == len(s) and len(s) * 100 < (len(s) + 1) * t:
                    continue
                if node in seen:
                    continue
                seen.add(node)
                p = _prefix(s, rare, 0, t, 1)
                tokens.append(p)
                nodes.append(np.full(len(p), node, np.int64))
                sizes.append(np.full(len(p), len(s), np.int32))
                pos.append(np.arange(len(p), dtype=np.int32))
                short.append(np.full(len(p), len(s) - _need(len(s), t) + 1, np.int32))
            if len(seen) > 1_000_000:
                seen.clear()
            if tokens:
                yield pa.record_batch({"token": np.concatenate(tokens).view(np.int64), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "pos": np.concatenate(pos), "p": np.concatenate(short)})

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "token long, node long, n int, pos int, p int")


def _in_bloom(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose long column may be among the keys, a staged table's column of that name."""
    at, log2 = rows.columns.index(column), filter_bits(keys.count())
    bits = rows.sparkSession.sparkContext.broadcast(bloom_of(keys, column, log2, 3))

    def run(batches):
        for batch in batches:
            h = batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bloom_has(bits.value, h, log2, 3)))

    return rows.mapInArrow(run, rows.schema)


def _candidate_sets(docs: DataFrame, table: DataFrame, pairs: DataFrame, text: str, doc_id: str, k: int, t: int, model) -> DataFrame:
    """(node, n, p1, p2, tokens) of the sets in `pairs`, each from the document with its smallest id.

    Documents are picked by a Bloom filter; what it lets through beyond those does no harm.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    least = table.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("i").alias("i"))
    least = staged(least.select(F.col("node").bitwiseXOR(F.coalesce("i", F.lit(-1).cast("long"))).alias("x")), "picked")
    log2 = filter_bits(least.count())
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(least, "x", log2, 3))

    def run(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            for start in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column(0).slice(start, 256), k, *model.value))
                nodes = np.array([node or 0 for _, _, node, _ in sets], np.int64)
                hits = bloom_has(wanted.value, (nodes ^ ids[start : start + 256]).view(np.uint64), log2, 3)
                rows = [(node, len(s), *(_prefix(s, rare, o, t).view(np.int64) for o in (1, 2)), s.view(np.int64)) for (s, rare, node, _), hit in zip(sets, hits) if hit and len(s)]
                if rows:
                    a = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*a, *[pa.array([r[j] for r in rows], pa.list_(pa.int64())) for j in (2, 3, 4)]], names=["node", "n", "p1", "p2", "tokens"])

    rows = docs.select(F.col(f"`{text}`"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-1).cast("long")))
    return staged(rows.mapInArrow(run, "node long, n int, p1 array<long>, p2 array<long>, tokens array<long>"), "candidate-sets")


def _need_sql(a_n: str, b_n: str, t: int) -> str:
    """Tokens that two sets must have in common."""
    return f"ceil({t} * ({a_n} + {b_n}) / {100 + t})"


def _even_enough(a: str, b: str, t: int) -> str:
    """Parities differ in no more cells than the tokens that only one of two linked sets may have."""
    cells = " + ".join(f"bit_count({a}.q[{j}] ^ {b}.q[{j}])" for j in range(4))
    return f"{cells} <= {a}.n + {b}.n - 2 * {_need_sql(f'{a}.n', f'{b}.n', t)}"


def _may_reach(a_n, a_pos, b_n, b_pos, t: int) -> str:
    """Sizes near enough, and the token early enough in both to be the first that they share."""
    need = _need_sql(a_n, b_n, t)
    return f"100 * least({a_n}, {b_n}) >= {t} * greatest({a_n}, {b_n}) AND {a_n} - {a_pos} >= {need} AND {b_n} - {b_pos} >= {need}"


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) whose prefixes meet under the other orders and whose sets reach the threshold."""
    side = lambda x, c: sets.select(F.col("node").alias(x), *[F.col(y).alias(f"{x}_{y}") for y in c])
    near = pairs.join(side("a", ("p1", "p2")), "a").join(side("b", ("p1", "p2")), "b")
    near = near.where(F.arrays_overlap("a_p1", "b_p1") & F.arrays_overlap("a_p2", "b_p2")).select("a", "b")
    both = near.join(side("a", ("n", "tokens")), "a").join(side("b", ("n", "tokens")), "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.withColumn("c", common).where(F.expr(f"100L * c >= {t}L * (a_n + b_n - c)")).select("a", "b")


def _members(docs: DataFrame, k: int, percent: int, text: str, doc_id: str, crowd: int = CROWD, node_bits: int = 64) -> tuple[DataFrame, DataFrame, object]:
    """((i, n, node) of each row: id, number of shingles, set's hash; (node, c) of linked sets: component; the model)."""
    t, spark = percent, docs.sparkSession
    table, found, clashes = class_table(docs, k, text, doc_id, node_bits=node_bits)
    model = spark.sparkContext.broadcast((found, clashes, node_bits))
    rows = staged(_prefix_rows(docs, text, k, t, model), "prefixes")
    shared = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    shared = staged(shared, "shared-tokens")
    # what the filter lets through beyond shared tokens are buckets of one set, which bring no pair
    every = staged(_in_bloom(rows, "token", shared).dropDuplicates(["token", "node"]), "bucket-rows")
    drop_staged(spark, rows.staged_path)
    few = every.where("pos < p")
    lead = few.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("lead"))
    buckets = join_hot(few, lead, "token").select("token", "node", "n", "pos", F.col("lead.node").alias("l_node"), F.col("lead.n").alias("l_n"), F.col("lead.pos").alias("l_pos")).where("node <> l_node")
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    parities = staged(table.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("q").alias("q")), "parities")
    first = buckets.where(_may_reach("n", "pos", "l_n", "l_pos", t)).select(*pair("node", "l_node")).distinct()
    first = first.join(parities.alias("x"), F.expr("a = x.node")).join(parities.alias("y"), F.expr("b = y.node")).where(_even_enough("x", "y", t))
    first = staged(first.select("a", "b"), "pairs-1")
    links = staged(_verified(first, _candidate_sets(docs, table, first, text, doc_id, k, t, model), t), "links-1")
    held = buckets.join(components(links), "node", "left").withColumn("c", F.coalesce("component", "node"))
    held = staged(held.select("token", "node", "n", "pos", "c"), "unsettled")
    apart = held.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("token", "size")
    held = join_hot(held, apart, "token").where("size IS NOT NULL")
    held = staged(held.join(parities.select("node", "q"), "node"), "apart")
    x, y = held.where(F.col("size") <= crowd).alias("x"), held.where(F.col("size") <= crowd).alias("y")
    near = "x.node < y.node AND x.c <> y.c AND " + _may_reach("x.n", "x.pos", "y.n", "y.pos", t) + " AND " + _even_enough("x", "y", t)
    rest = x.join(y, F.expr(f"x.token = y.token AND {near}")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowded = held.where(F.col("size") > crowd)
    if crowded.limit(1).count():
        # sets that link share a second token at least in the prefix and the token behind it
        second = crowded.join(every.select(F.col("node").alias("e_node"), F.col("token").alias("u")), F.expr("node = e_node AND token <> u")).drop("e_node")
        x, y = second.alias("x"), second.alias("y")
        rest = rest.unionAll(x.join(y, F.expr(f"x.token = y.token AND x.u = y.u AND {near}")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    rest = staged(rest.distinct(), "pairs-2")
    if rest.limit(1).count():
        links = links.unionAll(_verified(rest, _candidate_sets(docs, table, rest, text, doc_id, k, t, model), t))
    comp = staged(components(links).withColumnRenamed("component", "c"), "components")
    return table.select("i", "n", "node"), comp, model


def _per_set(rows: DataFrame, comp: DataFrame, of) -> DataFrame:
    """(node, c, ...) of each set that is not empty, with `of`, an aggregate over its component's rows: first by set, so
    that copies are one row, then by component, and large components are joined by a broadcast."""
    sets = rows.where("node IS NOT NULL").groupBy("node").agg(*of("own")).join(comp, "node", "left").withColumn("c", F.coalesce("c", "node"))
    sets = staged(sets, "per-set")
    return staged(join_hot(sets.select("node", "c"), sets.groupBy("c").agg(*of("all")), "c"), "per-set")


def near_components(docs: DataFrame, k: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """(doc_id, n_shingles, component_id): sets link when 100 * common >= percent * united."""
    mark = staged_so_far()
    rows, comp, _ = _members(docs, k, percent, text, doc_id, **how)
    least = _per_set(rows, comp, lambda which: [F.min("i" if which == "own" else "least").alias("least")])
    out = join_hot(rows, least.select("node", F.lit(True).alias("linked"), "least"), "node")
    component = F.when(F.col("linked"), F.col("least")).otherwise(F.col("i"))
    out = out.select(F.col("i").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    release(mark, out)
    return out


def _with_node(rows: DataFrame, k: int, model) -> DataFrame:
    """Rows (t, ...) with the node of each."""

    def run(batches):
        for batch in batches:
            nodes = [node for _, _, node, _ in shingle_sets(batch.column(0), k, *model.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "node"])

    return rows.mapInArrow(run, rows.withColumn("node", F.lit(None).cast("long")).schema)


def one_of_each(docs: DataFrame, k: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of each component, that with the smallest (id, set's hash, text, other columns), nulls last; and all without words.

    An id that one row has decides by itself. Only rows with a null or repeated id, some of which go, are told apart by
    their sets.
    """
    mark = staged_so_far()
    rows, comp, model = _members(docs, k, percent, text, doc_id, **how)
    order = F.struct(F.col("i").isNull().alias("z"), "i", "node")
    first = _per_set(rows, comp, lambda which: [F.min(order if which == "own" else "first").alias("first"), (F.count(F.lit(1)) if which == "own" else F.sum("size")).alias("size")])
    marked = join_hot(rows, first, "node")
    stays = F.col("node").isNull() | (F.col("first.node").eqNullSafe(F.col("node")) & F.col("first.i").eqNullSafe(F.col("i")))
    # a row that stays by its key may have equals with the same key
    alone = F.col("node").isNull() | (F.col("size") == 1)
    ids = marked.groupBy("i").agg(F.count(F.lit(1)).alias("rows"), F.count_if(stays).alias("stay"), F.bool_and(alone).alias("alone"))
    ids = staged(ids.where("NOT alone AND (stay < rows OR rows > 1)").select("i", F.expr("rows > 1 AND stay > 0").alias("several")), "ids-to-drop")
    all_rows = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{doc_id}`").cast("long").alias("i"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    same = F.expr("a.i <=> b.i")
    out = all_rows.alias("a").join(ids.alias("b"), same, "left_anti").select("a.row").select(*columns)
    several = ids.where("several").select("i")
    if not several.limit(1).count():
        release(mark, out)
        return out
    some = _with_node(all_rows.alias("a").join(several.alias("b"), same, "left_semi").select("a.*"), k, model)
    keys = first.select(F.col("first.i").alias("i"), F.col("first.node").alias("node")).distinct()
    chosen = some.where("node IS NOT NULL").alias("a").join(keys.alias("b"), F.expr("a.i <=> b.i AND a.node = b.node"), "left_semi")
    chosen = chosen.groupBy("i", "node").agg(F.min_by("row", F.struct("t", F.to_json("row"))).alias("row"))
    out = out.unionByName(some.where("node IS NULL").select(*columns)).unionByName(chosen.select(*columns))
    release(mark, out)
    return out
