"""Hard negatives by norm-bucketed maximum inner product search.

Candidates are dealt out evenly; each partition is sorted by norm, longest first, and read in buckets of `BUCKET` rows.
Anchors come as blocks of a bounded size. By Cauchy-Schwarz no candidate of a bucket scores more than |anchor| times the
bucket's longest norm: an anchor skips a bucket that cannot reach what it still needs, which is its running kth score
and, for negatives, also the lower limit of its windows. A first search finds the positives (same label, best five), a
second the negatives (other labels, best three of the window below each positive). Every task returns its best few of
each anchor; these are merged by Spark. The search is exact: pruning only leaves out what cannot be among the results.

Scores are exact integers: inner products of components floor(256 x) are sums below 2^53 in floating point as long as
components are small; a block with larger ones is computed in Python integers. Scores beyond a long are held at its ends.

Nulls: rows with a null label, a null vector, or a null, infinite or NaN component take no part. A null vec_id is no
anchor and comes last among ties. Of vectors of different lengths the shorter counts as filled up with zeros; an empty
vector scores 0. Rows that repeat are rows of their own (each finds the other); ties go by the smaller vec_id, so they
decide nothing else. Anchors without other rows of their label, or positives without negatives in their window, give no
rows. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._shared import release, staged, staged_so_far
from ._words import tidy

BUCKET = 1024
SLICE = 1024  # anchors multiplied with a bucket at once
BLOCK_BYTES = 8 << 20  # of anchors' vectors that are broadcast for one pass over the candidates
LAST = np.iinfo(np.int64).max
_EXACT = 2**52


def whole_vectors(embeddings: DataFrame, classes: int = 10, moved: int = 7, scale: int = 256) -> DataFrame:
    """Rows that take part as (vec_id, label, vector of whole doubles): labels of ids divisible by `moved` go one up."""
    ok = "label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")).cast("long")
    whole = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    return embeddings.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("vector"))


def _floor(x):
    """floor as a double, also beyond a long, which Spark's floor() gives; there doubles are whole anyway."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` doubles, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: doubles while all sums are, else Python integers."""
    most = (np.abs(a).max(initial=0.0) or 1.0) * (np.abs(c).max(initial=0.0) or 1.0) * max(1, a.shape[1])
    if most < _EXACT:
        return a @ c.T
    whole = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in c], object).reshape(c.shape).T
    return np.clip(whole, -(2**63), 2**63 - 1)


class _Best:
    """The best k (score, id) of each of n lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.filled, self.k = np.full((n, k), -np.inf, object), np.full((n, k), LAST), np.zeros(n, np.int64), k

    def kth(self, rows=slice(None)) -> np.ndarray:
        return self.score[rows, -1]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates in columns, their ids ascending; `allowed` says which of them count for which row."""
        kth, last, full = self.kth(rows), self.id[rows, -1], self.filled[rows] == self.k
        if scores.dtype != object:
            kth = kth.astype(float)
        better = allowed & ((scores > kth[:, None]) | ((scores == kth[:, None]) & ((ids[None, :] < last[:, None]) | ~full[:, None])))
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        rows, better, k = rows[some], better[some], min(self.k, len(ids))
        if scores.dtype == object:
            key = np.where(better, scores[some], -np.inf)
            top = np.array([sorted(range(len(ids)), key=lambda j: (-row[j], j))[:k] for row in key])
        else:  # one whole number for score and place, so that equal scores are told apart
            key = np.where(better, scores[some].astype(np.int64) * BUCKET + np.arange(len(ids))[::-1], np.iinfo(np.int64).min)
            top = np.argpartition(key, len(ids) - k, axis=1)[:, len(ids) - k :]
        count = np.take_along_axis(better, top, 1)
        new = np.where(count, np.take_along_axis(scores[some], top, 1).astype(object), -np.inf)
        both = np.concatenate([self.score[rows], new], axis=1)
        names = np.concatenate([self.id[rows], np.where(count, ids[top], LAST)], axis=1)
        order = np.argsort(names, axis=1, kind="stable")
        both, names = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        order = np.argsort(-both, axis=1, kind="stable")[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        self.filled[rows] = np.minimum(self.k, self.filled[rows] + count.sum(axis=1))


def _search(anchors: dict, needs_same: bool, k: int, width: int):
    """Batches of candidates to the best k of each anchor (positives), or of each anchor's windows (negatives).

    `anchors`: vector, label, row, norm, and for negatives owner (index into the anchors), low and high of each window."""
    best = _Best(len(anchors["owner"]), k)

    def limits(name: str, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        values = anchors[name][at]
        return (values if scores.dtype == object else values.astype(float))[:, None]

    def bucket(batch: pa.RecordBatch) -> None:
        ids, rows, labels, norms = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        order = np.argsort(ids, kind="stable")
        vectors = _matrix(batch.column(4), width)[order]
        ids, rows, labels, longest = ids[order], rows[order], labels[order], norms.max()
        reach = anchors["norm"] * longest * (1 + 1e-9) + 1
        need = np.maximum(best.kth().astype(float), anchors["low"].astype(float))  # by window; positives have one window without limits
        live = np.unique(anchors["owner"][reach[anchors["owner"]] >= need])
        for i in range(0, len(live), SLICE):
            some = live[i : i + SLICE]
            scores = _scores(anchors["vector"][some], vectors)
            same = anchors["label"][some][:, None] == labels[None, :]
            if needs_same:
                best.offer(some, scores, ids, same & (anchors["row"][some][:, None] != rows[None, :]))
                continue
            for w in range(anchors["windows"]):
                at = anchors["first"][some] + w
                has = np.flatnonzero(w < anchors["many"][some])
                at = at[has]
                inside = ~same[has] & (scores[has] >= limits("low", at, scores)) & (scores[has] <= limits("high", at, scores))
                if inside.any():
                    best.offer(at, scores[has], ids, inside)

    def run(batches):
        tidy()
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET):
                bucket(batch.slice(i, BUCKET))
        at, place = np.nonzero(np.arange(k)[None, :] < best.filled[:, None])
        for i in range(0, len(at), 4096):
            part = at[i : i + 4096], place[i : i + 4096]
            yield pa.record_batch({"at": pa.array(part[0], pa.int64()), "score": pa.array([int(x) for x in best.score[part]], pa.int64()), "id": pa.array(best.id[part], pa.int64())})

    return run


def _pass(candidates: DataFrame, anchors: dict, needs_same: bool, k: int, width: int) -> DataFrame:
    """The best k over all partitions: (at, place, score, id)."""
    handle = candidates.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        yield from _search(handle.value, needs_same, k, width)(batches)

    found = candidates.select("id", "row", "label", "norm", "vector").mapInArrow(run, "at long, score long, id long")
    place = F.row_number().over(W.partitionBy("at").orderBy(F.col("score").desc(), "id"))
    return staged(found.withColumn("place", place).where(F.col("place") <= k), "found")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For anchors (vec_id divisible by `every`) and their best `positives` of the same label, the best `negatives` of
    other labels that score between `low` and `high` per cent of the positive: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    spark: SparkSession = vectors.sparkSession
    since = staged_so_far()
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    parts = max(2, 2 * spark.sparkContext.defaultParallelism)
    rows = vectors.select("vec_id", F.coalesce("vec_id", F.lit(LAST)).alias("id"), F.col("label").alias("label"), "vector", norm.alias("norm"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows.repartition(parts).sortWithinPartitions(F.col("norm").desc(), "id"), "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    candidates = rows.coalesce(parts)
    anchors = rows.where(F.col("vec_id") % every == 0)
    per_block = max(1, BLOCK_BYTES // (8 * max(1, width)))
    blocks = -(-anchors.count() // per_block)
    out = []
    for block in range(blocks):
        # by a hash of the row, so that blocks are even; what a block holds beyond the share is some per cent
        mine = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").select("vec_id", "label", "row", "norm", "vector").toArrow()
        a = {"id": mine["vec_id"].to_numpy(), "label": mine["label"].to_numpy(), "row": mine["row"].to_numpy(), "norm": mine["norm"].to_numpy(), "vector": _matrix(mine["vector"], width)}
        n = len(a["id"])
        found = _pass(candidates, a | {"owner": np.arange(n), "low": np.full(n, -np.inf)}, True, positives, width).orderBy("at", "place").toArrow()
        at, score, ids = (found[c].to_numpy() for c in ("at", "score", "id"))
        keep = score >= 0  # the window below a negative score is empty
        at, score, ids = at[keep], score[keep], ids[keep]
        many = np.bincount(at, minlength=n)
        limit = lambda share, up: np.array([-(-share * int(s) // 100) if up else share * int(s) // 100 for s in score], object)
        windows = a | {"owner": at, "low": limit(low, True), "high": limit(high, False), "first": np.cumsum(many) - many, "many": many, "windows": int(many.max(initial=0))}
        best = _pass(candidates, windows, False, negatives, width)
        names = pa.table({"at": pa.array(np.arange(len(at)), pa.int64()), "anchor_id": pa.array(a["id"][at], pa.int64()), "positive_id": pa.array(ids, pa.int64(), mask=ids == LAST), "positive_score": pa.array(score, pa.int64())})
        named = best.join(F.broadcast(spark.createDataFrame(names)), "at").select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.when(F.col("id") != LAST, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(staged(named, "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    release(since, result)
    return result
