"""Substring dedup with a log-structured index of window fingerprints.

A window is k consecutive words; its fingerprint is the BLAKE2b digest (128 bits) of the words' bytes: two halves, by
both of which runs are dealt, sorted and merged, so that equal fingerprints stand for equal words. The index is a list of
immutable runs in the shared folder. A run holds, for each fingerprint, the smallest document id, dealt into buckets by
the fingerprint and sorted in them, as a bucketed table, so that runs are merge-joined with a batch and with each other
without shuffling them again. A batch is joined with all runs,
then becomes a run itself; `compact` merges `fanout` runs of one level into one of the next. A table is taken in
`batches` ranges of ascending id, more than `fanout`, so that its windows meet compacted and fresh runs.

For a whole table, windows that cannot repeat are left out first: every window has an anchor, the least hash among its
inner runs of half its length, equal windows have equal anchors, so only windows whose anchor occurs in two different
texts are fingerprinted. Up to `filter_keys` such anchors are broadcast as a Bloom filter; if there are more, each text
gets its own list of them by a join. Given an `index` of earlier tables, all windows are fingerprinted and appended.
Texts are the same when their SHA-256 over the words is. Whole copies need no windows: all but those of the smallest id
lose every word if they have a window at all.

Nulls: a null text has no words; a null doc_id comes after every other id. Equal ids take nothing from each other, nor do
null ids. Texts shorter than a window keep all words. Very long texts are read in one piece, window by window. Rows that
repeat give equal results. An empty table gives an empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ._shared import bloom_has, bloom_of, drop_staged, filter_bits, join_hot, new_path, release, staged, staged_so_far
from ._words import Words, chunks, sliding_min

FILTER_KEYS = 20_000_000  # anchors that one broadcast filter holds well: 32 MB


class WindowIndex:
    """Runs of (g1, g2, least): fingerprints and the smallest document id that starts each; null: only documents without."""

    def __init__(self, spark, buckets: int | None = None, fanout: int = 4):
        """buckets: as many as shuffles have partitions if not given, so that they grow with what the session is set for."""
        self.spark, self.buckets, self.fanout = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout
        self.runs: list[tuple[int, str, str]] = []  # (level, table, folder)

    def _write(self, rows: DataFrame, level: int) -> None:
        """Rows (g1, g2, least), united by fingerprint, each bucket in one task."""
        name = f"verisift_run_{uuid.uuid4().hex}"
        rows = self._dealt(rows.groupBy("g1", "g2").agg(F.min("least").alias("least")))
        path = new_path(self.spark, "run")
        rows.write.bucketBy(self.buckets, "g1", "g2").sortBy("g1", "g2").format("parquet").option("path", path).saveAsTable(name)
        self.runs.append((level, name, path))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows grouped by fingerprint as the buckets are; shuffles of as many partitions do that already."""
        same = int(self.spark.conf.get("spark.sql.shuffle.partitions")) == self.buckets
        return rows if same else rows.repartition(self.buckets, "g1", "g2")

    def history(self, runs: list | None = None) -> DataFrame | None:
        """All runs; a fingerprint may be in several. Read as files: Spark 4.1 takes a union of bucketed tables for
        bucketed and would leave out the shuffle that an aggregate over it needs."""
        paths = [path for _, _, path in runs or self.runs]
        return self.spark.read.parquet(*paths) if paths else None

    def append(self, windows: DataFrame) -> None:
        self._write(windows.select("g1", "g2", F.col("i").alias("least")), 0)

    def probe(self, windows: DataFrame) -> DataFrame:
        """`windows` (i, g1, g2, ...) with `least`: the smallest id of the runs and of the batch itself.

        The batch's own least ids are combined in each task before they are dealt as the runs' buckets are, for merge joins
        on the whole fingerprint. The last join may have a window that very many documents share on one side; adaptive
        execution splits it.
        """
        own = windows.groupBy("g1", "g2").agg(F.min("i").alias("least"))
        if self.runs:
            own = self._dealt(own)
        for _, name, _ in self.runs:
            run = self.spark.table(name).withColumnRenamed("least", "old")
            own = own.join(run, ["g1", "g2"], "left").select("g1", "g2", F.least("least", "old").alias("least"))
        return windows.join(own, ["g1", "g2"])

    def repeats(self, windows: DataFrame) -> DataFrame:
        """The windows that a document with a smaller id starts as well."""
        return self.probe(windows).where("least < i OR (i IS NULL AND least IS NOT NULL)").drop("least")

    def compact(self) -> None:
        """Merge the runs of every level that has `fanout` of them into one run of the next level."""
        level = 0
        while any(run[0] >= level for run in self.runs):
            mine = [run for run in self.runs if run[0] == level]
            if len(mine) >= self.fanout:
                self._write(self.history(mine), level + 1)
                self.runs = [run for run in self.runs if run not in mine]
                self._drop(mine)
            level += 1

    def _drop(self, runs: list) -> None:
        for _, name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_staged(self.spark, path)

    def drop(self) -> None:
        self._drop(self.runs)
        self.runs = []


def _anchors(w: Words, k: int) -> np.ndarray:
    """Of each window of k words, the least hash of its inner runs of k // 2 words."""
    inner = max(1, k // 2)
    return sliding_min(w.windows(inner), k - inner + 1)


def _sequences(w: Words):
    """The SHA-256 over each text's words, joined by single spaces."""
    import hashlib

    raw, start, end = w.plain()
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        yield hashlib.sha256(raw[start[a] : end[b - 1]] if b > a else b"").digest()


def _short(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def text_rows(docs: DataFrame, k: int) -> DataFrame:
    """(i, n_words, sha, x, anchors) of rows (t, i): the word sequence's SHA-256, its first 64 bits, its windows' anchors."""

    def run(batches):
        for batch in batches:
            n, sha, anchors = [], [], []
            for _, data, offsets in chunks(batch.column(0)):
                w = Words(data, offsets)
                n.append(w.n)
                sha += _sequences(w)
                m = _anchors(w, k)
                new = np.ones(len(m), bool)
                new[1:] = m[1:] != m[:-1]
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    if b - a >= k:
                        new[a] = True
                        anchors.append(np.unique(m[a : b - k + 1][new[a : b - k + 1]]).view(np.int64))
                    else:
                        anchors.append(None)
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(n), pa.int32()), pa.array(sha, pa.binary()), pa.array([_short(s) for s in sha], pa.int64()), pa.array(anchors, pa.list_(pa.int64()))], names=["i", "n_words", "sha", "x", "anchors"])

    return docs.mapInArrow(run, "i long, n_words int, sha binary, x long, anchors array<long>")


def window_rows(docs: DataFrame, k: int, repeated=None, bits: int = 0) -> DataFrame:
    """(i, x, g1, g2, at) of the windows of rows (t, i): all of them, those whose anchor may be in the Bloom filter
    `repeated`, or, if rows have a third column `mine`, those whose anchor it lists.

    at: the places of the window in its text, so a text that repeats itself gives a row for each different window.
    """
    listed = "mine" in docs.columns

    def run(batches):
        import hashlib

        digest = hashlib.blake2b
        for batch in batches:
            ids = batch.column(1)
            for row, data, offsets in chunks(batch.column(0)):
                w = Words(data, offsets)
                ok = w.within(k)
                if not ok.any():
                    continue
                if repeated is not None or listed:
                    m = _anchors(w, k)
                    at = np.flatnonzero(ok)
                    if listed:
                        for j, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                            if b - a >= k:
                                ok[a : b - k + 1] = np.isin(m[a : b - k + 1], batch.column(2)[row + j].values.to_numpy().view(np.uint64))
                    else:
                        # neighbours share anchors: ask the filter once for each run of equal ones
                        change = np.flatnonzero(np.concatenate([[True], m[at[1:]] != m[at[:-1]]]))
                        ok[at] = np.repeat(bloom_has(repeated.value, m[at[change]], bits, 3), np.diff(np.append(change, len(at))))
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                raw, start, end = w.plain()
                text = np.searchsorted(w.first, at, "right") - 1
                x = np.zeros(len(offsets) - 1, np.int64)
                for j in np.unique(text).tolist():
                    x[j] = _short(hashlib.sha256(raw[start[w.first[j]] : end[w.first[j + 1] - 1]]).digest())
                for j in range(0, len(at), 200_000):
                    p, of = at[j : j + 200_000], text[j : j + 200_000]
                    g = np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(start[p].tolist(), end[p + k - 1].tolist())]), "<i8").reshape(-1, 2)
                    order = np.lexsort((p, g[:, 1], g[:, 0], of))
                    p, of, g = p[order], of[order], g[order]
                    new = np.ones(len(p) + 1, bool)
                    new[1:-1] = (g[1:] != g[:-1]).any(axis=1) | (of[1:] != of[:-1])
                    groups = np.flatnonzero(new)
                    head = groups[:-1]
                    lists = pa.ListArray.from_arrays(pa.array(groups.astype(np.int32)), pa.array((p - w.first[of]).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + of[head])), pa.array(x[of[head]]), pa.array(g[head, 0]), pa.array(g[head, 1]), lists], names=["i", "x", "g1", "g2", "at"])

    return docs.mapInArrow(run, "i long, x long, g1 long, g2 long, at array<int>")


def _cut(rows: DataFrame, k: int, digest: bool) -> DataFrame:
    """(i, x, ..., n_removed, kept) of rows (t, i, starts, x, ...): words in windows that start at `starts` are left out,
    all where it is null. kept: what stays, joined by single spaces, or its SHA-256.
    """
    out = rows.drop("t", "starts").withColumn("n_removed", F.lit(0).cast("long")).withColumn("kept", F.lit(b""))
    names, schema = out.columns, out.schema

    def run(batches):
        import hashlib

        for batch in batches:
            starts = batch.column(2).to_pylist()
            n, kept = [], []
            for row, data, offsets in chunks(batch.column(0)):
                w = Words(data, offsets)
                raw, start, end = w.plain()
                for j, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    edge = np.zeros(b - a + k + 1, np.int64)
                    at = np.array(starts[row + j] or (), np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + k, -1)
                    gone = np.cumsum(edge)[: b - a] > 0 if starts[row + j] is not None else np.ones(b - a, bool)
                    stay = np.flatnonzero(~gone) + a
                    n.append(b - a - len(stay))
                    text = b" ".join([raw[c:d] for c, d in zip(start[stay].tolist(), end[stay].tolist())])
                    kept.append(hashlib.sha256(text).digest() if digest else text)
            rest = [batch.column(1), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(kept, pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def _with_sequence(docs: DataFrame, wanted=None, bits: int = 0) -> DataFrame:
    """Rows (t, i, ...) with x; with a Bloom filter only those whose id may be in it (a null one as -1)."""

    def run(batches):
        for batch in batches:
            if wanted is not None:
                ids = pa.compute.fill_null(batch.column(1), -1).to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(bloom_has(wanted.value, ids, bits, 3)))
            x = []
            for _, data, offsets in chunks(batch.column(0)):
                x += [_short(s) for s in _sequences(Words(data, offsets))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.int64())], names=[*batch.schema.names, "x"])

    return docs.mapInArrow(run, docs.withColumn("x", F.lit(0).cast("long")).schema)


def _windows(source: DataFrame, rows: DataFrame, sequences: DataFrame, k: int, filter_keys: int) -> DataFrame:
    """The windows of the whole table that may occur in two different texts."""
    # an anchor is listed once a text, so two counts are two texts
    shared = staged(sequences.select(F.explode("anchors").alias("h")).groupBy("h").count().where("count > 1").select("h"), "anchors")
    many = shared.count()
    if many <= filter_keys:
        bits = filter_bits(many)
        return window_rows(source, k, source.sparkSession.sparkContext.broadcast(bloom_of(shared, "h", bits, 3)), bits)
    lists = rows.select("x", F.explode("anchors").alias("h")).join(shared, "h", "left_semi").groupBy("x").agg(F.collect_set("h").alias("mine"))
    return window_rows(_with_sequence(source).join(lists, "x").select("t", "i", "mine"), k)


def _found(source: DataFrame, k: int, batches: int, filter_keys: int, index: WindowIndex | None) -> tuple[DataFrame, DataFrame]:
    """((i, n_words, sha, x, copy) of each row, (i, x, starts) of those with repeated windows) of rows (t, i)."""
    spark = source.sparkSession
    rows = staged(text_rows(source, k), "texts")
    sequences = rows.where(F.col("n_words") >= k).groupBy("sha").agg(F.min("i").alias("first"), F.first("anchors").alias("anchors"))
    sequences = staged(sequences, "sequences")
    cuts = rows.agg(F.percentile_approx("i", [x / batches for x in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    number = F.lit(len(cuts))  # null ids are in the last batch
    for j, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("i") <= cut, j).otherwise(number)
    windows = window_rows(source, k) if index else _windows(source, rows, sequences, k, filter_keys)
    windows = staged(windows.withColumn("batch", number.cast("int")), "windows", "batch")
    runs, found = index or WindowIndex(spark), None
    try:
        for j in range(len(cuts) + 1):
            mine = windows.where(F.col("batch") == j).drop("batch")
            hit = staged(runs.repeats(mine).select("i", "x", "at"), "hits")
            found = hit if found is None else found.unionAll(hit)
            if index or j < len(cuts):
                runs.append(mine)
                runs.compact()
    finally:
        if not index:
            runs.drop()
    drop_staged(spark, windows.staged_path)
    copy = F.col("first").isNotNull() & (F.col("i").isNull() | (F.col("first") < F.col("i")))
    whole = join_hot(rows.drop("anchors"), sequences.select("sha", "first"), "sha").withColumn("copy", copy).drop("first")
    starts = found.groupBy("i", "x").agg(F.flatten(F.collect_set("at")).alias("starts"))
    return whole, staged(starts, "starts")


def remove_repeats(docs: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", batches: int = 6, filter_keys: int = FILTER_KEYS, index: WindowIndex | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words go that a window covers which also starts in a smaller doc_id.

    The table is merged into a window index in `batches` ranges of doc_id. An `index` given holds earlier tables with
    smaller ids and keeps all windows of this one.
    """
    spark, mark = docs.sparkSession, staged_so_far()
    source = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.col(f"`{doc_id}`").cast("long").alias("i"))
    whole, starts = _found(source, k, batches, filter_keys, index)
    bits = filter_bits(starts.count())
    wanted = spark.sparkContext.broadcast(bloom_of(starts.select(F.coalesce("i", F.lit(-1).cast("long")).alias("i")), "i", bits, 3))
    texts = _with_sequence(source, wanted, bits).alias("t").join(starts.alias("s"), F.expr("t.i <=> s.i AND t.x = s.x")).select("t.t", "t.i", "s.starts", "t.x")
    cut = _cut(texts, k, True).dropDuplicates(["i", "x"]).alias("c")
    out = whole.alias("w").join(cut, F.expr("w.i <=> c.i AND w.x = c.x"), "left")
    nothing, gone = F.unhex(F.sha2(F.lit("").cast("binary"), 256)), F.col("n_words").cast("long")
    kept = F.when(F.col("copy"), nothing).otherwise(F.coalesce("c.kept", "w.sha"))
    out = out.select(
        F.col("w.i").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.when(F.col("copy"), gone).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.lower(F.hex(kept)).alias("kept_sha256"),
    )
    if index is None:
        release(mark, out)
    return out


def deduplicated(docs: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """`docs` with all its columns; a text that loses words becomes those left, joined by single spaces, others stay as
    they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.col(f"`{doc_id}`").cast("long").alias("i"), row.alias("row"))
    whole, starts = _found(rows.select("t", "i"), k, how.pop("batches", 6), how.pop("filter_keys", FILTER_KEYS), how.pop("index", None))
    copies = whole.where("copy").select("i", "x", F.lit(None).cast("array<int>").alias("starts")).distinct()
    same = F.expr("a.i <=> b.i AND a.x = b.x")
    marks = starts.alias("a").join(copies.alias("b"), same, "left_anti").unionByName(copies)
    texts = _with_sequence(rows).alias("a").join(marks.alias("b"), same, "left")
    texts = texts.select("a.t", "a.i", F.when(F.col("b.x").isNull(), F.array().cast("array<int>")).otherwise(F.col("b.starts")).alias("starts"), "a.x", "a.row", F.col("b.x").isNotNull().alias("hit"))
    out = _cut(texts, k, False)
    new = F.when(F.col("hit"), F.col("kept").cast("string")).otherwise(F.col(f"row.`{text}`"))
    return out.select(*[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
