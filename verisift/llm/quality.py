"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated output.

Words here are runs of signs of one kind: lower-case letters and all signs beyond ASCII, capitals, digits, or one
punctuation mark repeated. A word hashes to one of 2^`BITS` slots. A slot has a random index vector (`NONZERO` entries of
+1 or -1 in `WIDTH`, drawn from the slot's number) and a context vector: the sum of the index vectors of the two words
before and after each of its occurrences, over all documents. Context vectors are whole numbers, so their sum does not
depend on the order of tasks; centred and brought to length 1 they are the word vectors. A document is pooled to the mean
and the spread of its words' vectors, to the mean likeness (inner product) of words one to `APART` places apart, and to
its number of words, as log(1 + n).

The network (one hidden layer of `HIDDEN` rectified units, one logistic output; numpy, Adam, fixed seed) learns from
labelled documents outside the held-out fold: of crc32(doc_id) mod `folds`, remainder `fold` is held out. At most
`SAMPLE` of them are used, those of the lowest MD5 of doc_id; one in five of these does not train but sets the
temperature that divides the logit (least log loss), so that scores are probabilities. Labels, languages, sources and
ids are never inputs. Everything else, word vectors and pooled documents, covers all rows and whole texts.

Nulls: a null text is empty; empty and blank texts are pooled to zeros and scored like all others. A null doc_id has no
label and is not held out (the CRC-32 of nothing is 0). Several labels of one id count as 1 if one is 1; repeated rows
are documents of their own with equal scores. Null qualities teach nothing. With labels of fewer than two kinds the score
is the smoothed share of label 1, (n1 + 1) / (n + 2), 0.5 without any. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import release, staged, staged_so_far
from ._words import U, Words, chunks, mix, tidy

BITS, WIDTH, NONZERO = 15, 32, 2
SLOTS = 1 << BITS
NEAR = 2  # words before and after
APART = 4
PIECE = 512  # slots whose vectors travel in one row
TALLIES = 4096  # tasks at most that tally contexts, each with a table of SLOTS x WIDTH
SAMPLE = 40_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 30, 2e-3, 1e-4

_KIND = np.arange(256, dtype=np.int16)  # a punctuation mark is a kind of its own
_KIND[97:123] = 256
_KIND[128:] = 256
_KIND[65:91] = 257
_KIND[48:58] = 258
_KIND[[32, 9, 10, 11, 12, 13]] = -1


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word of the texts, and where each text's words begin (one more at the end)."""
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    at = np.flatnonzero(edge)
    words = Words.__new__(Words)
    word = kind[at[:-1]] >= 0 if len(data) else np.zeros(0, bool)
    words.data, words.start, words.end = data, at[:-1][word], at[1:][word]
    return (words.hashes() >> U(64 - BITS)).astype(np.int64), np.searchsorted(words.start, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every slot's index vector."""
    drawn = np.stack([mix(np.arange(SLOTS, dtype=np.uint64) + U((j + 1) << 32)) for j in range(NONZERO)], axis=1)
    step = WIDTH // NONZERO  # each entry in a stretch of its own, so that no two meet
    return (drawn % U(step)).astype(np.int64) + np.arange(NONZERO) * step, ((drawn >> U(40)) & U(1)).astype(np.int64) * 2 - 1


def tally(table: np.ndarray, slots: np.ndarray, first: np.ndarray, index) -> None:
    """Add the index vectors of each word's neighbours in the same text to its slot of `table` (flat)."""
    places, signs = index
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for d in range(1, NEAR + 1):
        if len(text) <= d:
            continue
        near = text[d:] == text[:-d]
        a, b = slots[:-d][near], slots[d:][near]
        for j in range(NONZERO):
            where = np.concatenate([a * WIDTH + places[b, j], b * WIDTH + places[a, j]])
            up = np.concatenate([signs[b, j], signs[a, j]])
            np.add.at(table, where, up)


def _contexts(texts: DataFrame) -> np.ndarray:
    """Context vectors of all slots, summed over all texts: tasks send tables in pieces, which are added as streams."""

    def fill(batches):
        table, index, some = np.zeros(SLOTS * WIDTH, np.int64), index_vectors(), False
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0), 500_000):
                tally(table, *slots_of(data, offsets), index)
                some = True
        if some:
            yield from pieces(table)

    def pieces(table):
        for i, part in enumerate(table.reshape(-1, PIECE * WIDTH)):
            if part.any():
                yield pa.record_batch({"piece": pa.array([i], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data, np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield pa.record_batch({"piece": pa.array([i], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})

    tables = texts.coalesce(TALLIES).mapInArrow(fill, "piece int, data binary")
    merged = tables.repartition(SLOTS // PIECE, "piece").mapInArrow(add, "piece int, data binary")
    out = np.zeros((SLOTS // PIECE, PIECE * WIDTH), np.int64)
    for r in merged.collect():  # SLOTS x WIDTH numbers, whatever the input
        out[r.piece] = np.frombuffer(r.data, np.int64)
    return out.reshape(SLOTS, WIDTH)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Centred by the mean direction of all slots that occur, then of length 1; slots without contexts are zeros."""
    length = np.sqrt((contexts.astype(float) ** 2).sum(axis=1, keepdims=True))
    unit = contexts / np.maximum(length, 1)
    seen = length[:, 0] > 0
    unit[seen] -= unit[seen].mean(axis=0) if seen.any() else 0
    length = np.sqrt((unit**2).sum(axis=1, keepdims=True))
    return (unit / np.maximum(length, 1e-9)).astype(np.float32)


def pool(slots: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's words, likeness of near ones, and log(1 + their number)."""
    n = np.diff(first)
    out = np.zeros((len(n), 2 * WIDTH + APART + 1), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        rows, many = vectors[slots], n[some][:, None].astype(np.float32)
        text, like = np.repeat(np.arange(len(n)), n), np.zeros((len(n), APART), np.float32)
        for d in range(1, min(APART, len(text) - 1) + 1):
            alike = np.einsum("ij,ij->i", rows[d:], rows[:-d]) * (text[d:] == text[:-d])
            like[:, d - 1] = np.bincount(text[d:], alike, len(n)) / np.maximum(n - d, 1)
        sums = np.stack([rows[first[i] : first[i + 1]].sum(axis=0) for i in some])
        rows *= rows
        squares = np.stack([rows[first[i] : first[i + 1]].sum(axis=0) for i in some])
        mean = sums / many
        spread = np.sqrt(np.maximum(squares / many - mean**2, 0))
        out[some] = np.concatenate([mean, spread, like[some], np.log1p(many)], axis=1)
    return out


class Network:
    """Inputs standardised, one hidden layer, one logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 7):
        x, y = x.astype(np.float64), y.astype(np.float64)
        self.shift, self.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
        rng, n = np.random.default_rng(seed), x.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._fit((x[~held] - self.shift) / self.scale, y[~held], rng)
        if held.any():
            z, t = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid])])

    def _fit(self, x, y, rng) -> None:
        moved, squared, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            order, rate = rng.permutation(len(x)), RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for i in range(0, len(x), 256):
                some = order[i : i + 256]
                a, t = x[some], y[some]
                hidden = np.maximum(a @ self.w[0] + self.w[1], 0)
                off = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -50, 50))) - t) / len(some)
                back = off[:, None] * self.w[2] * (hidden > 0)
                step += 1
                for j, g in enumerate((a.T @ back, back.sum(axis=0), hidden.T @ off, off.sum(keepdims=True))):
                    moved[j] += 0.1 * (g - moved[j])
                    squared[j] += 0.001 * (g * g - squared[j])
                    self.w[j] = self.w[j] * (1 - rate * DECAY) - rate * (moved[j] / (1 - 0.9**step)) / (np.sqrt(squared[j] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -50, 50)))


class Share:
    """What is said where labels are of fewer than two kinds: their smoothed share of 1."""

    def __init__(self, y: np.ndarray):
        self.share = (float(np.sum(y)) + 1) / (len(y) + 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def pooled(docs: DataFrame) -> DataFrame:
    """(doc_id, x): every document's pooled vector as bytes of 32-bit floats; word vectors are of these documents."""
    handle = docs.sparkSession.sparkContext.broadcast(word_vectors(_contexts(docs.select("text"))))

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1), 500_000):
                x = pool(*slots_of(data, offsets), handle.value)
                yield pa.record_batch({"doc_id": batch.column(0).slice(row, len(x)), "x": pa.array([v.tobytes() for v in x], pa.binary())})
            tidy()

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary"), "pooled")


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (higher: quality 1 likelier), predicted."""
    since = staged_so_far()
    vectors = pooled(docs)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good")).where(remainder != fold)
    order = F.md5(F.concat(F.lit("q"), F.col("doc_id")).cast("binary"))
    # one row an id is enough to learn from, so that the sample is bounded whatever repeats
    rows = vectors.join(marked, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("good").alias("good")).orderBy(order, "doc_id").limit(sample)
    learned = rows.select("x", "good").toArrow()
    y = np.array([int(g > 0) for g in learned["good"].to_pylist()])
    if len(set(y.tolist())) < 2:
        model = Share(y)
    else:
        x = np.stack([np.frombuffer(v, np.float32) for v in learned["x"].to_pylist()])
        held = np.arange(len(y)) % 5 == 4
        model = Network(x, y, held if len(set(y[~held].tolist())) == 2 else np.zeros(len(y), bool))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v, np.float32) for v in batch.column(1).to_pylist()])
                yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(handle.value.scores(x), pa.float64())})

    out = vectors.mapInArrow(run, "doc_id long, score double")
    out = out.select("doc_id", (remainder == fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    release(since, out)
    return out
