"""The prefix trie of conversations, summed up by leaf-peeling message passing.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. A node
belongs to its smallest member, and the nodes that one conversation owns lie one below the other: the trie falls into one
path an owner, and a path hangs at one node of another path. Messages travel between paths: each holds a counter of
paths that still hang at it; those at zero send their totals to the path they hang at and are done, until the root's path
is the last. Running sums along each path then give every node the totals of its subtree.

A prefix is known by 144 bits of sums over its turns of hashes of (position, SHA-256 of the turn), so prefixes of any
length are running sums, taken over blocks of `BLOCK` turns. No task holds a conversation or a node's members: turns are
numbered by a global sort, so one conversation's turns lie in as many partitions as they fill; members are counted and
compared in partial aggregates; the ids of a node's ends are joined in chunks of at most 4,096 and hashed as a stream.
Rounds: the longest chain of paths, each hanging at the one before; n turns have sqrt(2 n) at most, and usual tables a few.

Nulls: a null role or text is empty, a null turn comes first; rows with a null conv_id are in no conversation. Turns of
equal number are ordered by their SHA-256; equal rows are turns of their own. An empty table has no nodes, not even a
root. Texts of any length count whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._shared import join_hot, release, staged, staged_so_far

BLOCK = 4096
CHUNK_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()
_SHIFT = 28  # 36-bit summands: sums of up to 2^27 turns a block stay in a long


def running(df: DataFrame, key: str, at: str, sums: dict[str, Column], longest: int, backwards: bool = False) -> DataFrame:
    """`df` with sums over the rows of the same key up to and including each row, in the order of `at` (0 and more, each
    once a key, `longest` at most), or from it to the last. Rows are dealt by key and block; totals of blocks are summed
    one level up, so that one key's rows need no common task."""
    block = F.floor(F.col(at) / BLOCK).cast("long")
    order = F.col(at).desc() if backwards else F.col(at)
    within = W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    values = df.withColumn("_block", block).withColumns({f"_v_{n}": c for n, c in sums.items()})
    out = values.withColumns({n: F.sum(f"_v_{n}").over(within) for n in sums})
    if longest >= BLOCK:
        totals = values.groupBy(key, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        later = W.partitionBy(key).orderBy(F.col("_block").desc() if backwards else F.col("_block")).rowsBetween(W.unboundedPreceding, -1)
        before = totals.select(key, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(later), F.lit(0)).alias(f"_o_{n}") for n in sums])
        out = out.join(before, [key, "_block"]).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_block", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def _numbered(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns with their place k in the conversation, from 1, and what `parts` says about it."""
    return turns.join(parts, ["conv_id", "part"]).withColumn("k", F.col("at") - F.col("first") + F.col("offset") + 1)


def _members(conversations: DataFrame, head: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations with the nodes they lead to, and one row a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("d"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    turns = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "d", "row").select("conv_id", "d", "chars", F.monotonically_increasing_id().alias("at"))
    turns = staged(turns.withColumn("part", F.shiftright("at", 33)), "turns")
    # one row for each conversation and partition of the sort that holds some of it
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = W.partitionBy("conv_id").orderBy("part")
    parts = parts.select("*", F.coalesce(F.sum("n").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    parts = staged(parts, "conversation-parts")
    heads = _numbered(turns.where(F.col("conv_id") % group == 0), parts).where(F.col("k") < head)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "d", "chars"))).alias("heads"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n"), F.min("first").alias("first")).select(
        "conv_id", "n", F.shiftright("first", CHUNK_BITS).alias("chunk"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int").alias("h"))
    whole = whole.join(heads, "base", "left").withColumn("heads", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h")))
    whole = staged(whole.withColumn("borrowed", F.size("heads")), "conversations").withColumn("size", F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    borrowed = whole.select("conv_id", "chunk", "size", F.explode("heads").alias("turn")).select("conv_id", "chunk", F.col("turn.k").alias("pos"), "turn.d", "turn.chars", (F.col("turn.k") == F.col("size")).alias("ends"))
    own = _numbered(turns, parts.drop("n").join(whole.select("conv_id", "chunk", "h", "borrowed", "n"), "conv_id")).where("k > h")
    own = own.select("conv_id", "chunk", (F.col("k") - F.col("h") + F.col("borrowed")).alias("pos"), "d", "chars", (F.col("k") == F.col("n")).alias("ends"))
    rows = own.unionByName(borrowed)
    longest = whole.agg(F.max("size")).first()[0] or 0
    words = {f"s{i}": F.shiftright(F.xxhash64(F.lit(i), "pos", "d"), _SHIFT) for i in range(4)}
    rows = running(rows, "conv_id", "pos", words, longest)
    key = lambda pos, cols: F.struct(pos.cast("long").alias("pos"), F.xxhash64(F.lit(5), *cols).alias("a"), F.xxhash64(F.lit(6), *cols[::-1]).alias("b"))
    here, above = [F.col(n) for n in words], [F.col(n) - c for n, c in words.items()]
    return staged(rows.select("conv_id", "chunk", "pos", "chars", "ends", key(F.col("pos"), here).alias("node"), key(F.col("pos") - 1, above).alias("up")), "trie-members"), whole


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id, chunk): ids are joined by chunk, then hashed as a stream in their order."""

    def stream(batches):
        now, digest = None, None
        for batch in batches:
            nodes, digests = [], []
            for pos, a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (pos, a, b) != now:
                    if now:
                        nodes.append(now)
                        digests.append(digest.hexdigest())
                    now, digest = (pos, a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield out(nodes, digests)
        if now:
            yield out([now], [digest.hexdigest()])

    def out(nodes, digests):
        columns = [pa.array([n[i] for n in nodes], pa.int64()) for i in range(3)]
        return pa.record_batch([*columns, pa.array(digests, pa.string())], names=["pos", "a", "b", "ends_sha256"])

    ids = ends.groupBy("node", "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    ids = ids.select("node.pos", "node.a", "node.b", "chunk", "ids").repartition("pos", "a", "b").sortWithinPartitions("pos", "a", "b", "chunk")
    hashed = ids.select("pos", "a", "b", "ids").mapInArrow(stream, "pos long, a long, b long, ends_sha256 string")
    return hashed.select(F.struct("pos", "a", "b").alias("node"), "ends_sha256")


def peeled(paths: DataFrame) -> DataFrame:
    """Totals of every path with all that hangs at it, by rounds of messages.

    `paths`: owner, up (the owner of the path it hangs at; null for the root's), at (the place there), leaves, saved."""
    waits = paths.where("up IS NOT NULL").groupBy(F.col("up").alias("owner")).agg(F.count("*").alias("waits"))
    open_ = staged(paths.join(waits, "owner", "left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long"))), "open-paths")
    done = []
    while True:
        done.append(open_.where("waits = 0").drop("waits"))
        rest = open_.where("waits > 0")
        if rest.limit(1).count() == 0:
            break
        sent = done[-1].groupBy(F.col("up").alias("owner")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        none = F.lit(0).cast("long")
        rest = rest.join(sent, "owner", "left").select(
            "owner", "up", "at", (F.col("leaves") + F.coalesce("more_leaves", none)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", none)).alias("saved"), (F.col("waits") - F.coalesce("n", none)).alias("waits"))
        open_ = staged(rest, "open-paths")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(conversations: DataFrame, head: int = 6, group: int = 100) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations, in the columns of the module's contract.

    A conversation c is rebuilt from the first crc32(c) % `head` turns of conversation c - c % `group`, then its own later
    ones."""
    since = staged_so_far()
    members, whole = _members(conversations, head, group)
    root = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("pos", "a", "b")])
    nodes = members.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("up").alias("up"))
    nodes = nodes.withColumn("up", F.when(F.col("up.pos") == 0, root).otherwise(F.col("up")))
    top = whole.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = staged(nodes.unionByName(top.select(root.alias("node"), "owner", "n_convs", F.lit(0).cast("long").alias("chars"), F.lit(None).cast(nodes.schema["up"].dataType).alias("up"))), "trie-nodes")
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").select("node", F.col("node.pos").alias("depth"), "owner", "up", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    nodes = staged(nodes, "trie-nodes")
    paths = staged(nodes.groupBy("owner").agg(F.min(F.struct("depth", "up")).alias("first"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
                   .select("owner", F.col("first.depth").alias("depth"), F.col("first.up").alias("up"), "leaves", "saved"), "trie-paths")
    hangs = join_hot(paths, nodes.select(F.col("node").alias("up"), F.col("owner").alias("above")), "up")
    hangs = staged(hangs.select("owner", F.col("above").alias("up"), (F.col("depth") - 1).alias("at"), "leaves", "saved"), "trie-paths")
    hung = peeled(hangs).where("up IS NOT NULL").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    none = F.lit(0).cast("long")
    full = nodes.join(hung, ["owner", "depth"], "left").join(hangs.where("up IS NOT NULL").select("owner", (F.col("at") + 1).alias("depth"), F.col("up").alias("above")), ["owner", "depth"], "left")
    longest = nodes.agg(F.max("depth")).first()[0] or 0
    full = running(full, "owner", "depth", {
        "n_leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("hung_leaves", none), "saved_tokens": F.col("saved") + F.coalesce("hung_saved", none)}, longest, backwards=True)
    ends = members.where("ends").select("node", "conv_id", "chunk").unionByName(whole.where("size = 0").select(root.alias("node"), "conv_id", "chunk"))
    full = full.join(_ends_sha256(ends), "node", "left")
    out = staged(full.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")), "trie")
    release(since, out)
    return out
