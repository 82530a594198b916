"""Line dedup with two Bloom filters.

A first pass sets each document's line keys in a once-seen bitmap and, where it was set before, in a twice-seen one;
the bitmaps of all tasks are united chunk by chunk (twice = both twice, or once in two tasks). Only keys that the
twice-seen filter holds are suspected repeats: their 128-bit hashes (XXH3) are counted exactly, pre-aggregated in each
task. Filters have 64 bits or more a document up to 2^28 bits (32 MB) each: a full filter suspects more, it never misses.

Keys found in enough documents are hot. They are broadcast while their number is at most `max_broadcast`; beyond that
each document's suspects are joined with them instead. `keep_first` leaves a hot key's first line, in the document with
the smallest id (ties: every document of that id).

A row is a document: repeated rows count as many. A null text is one empty line; a null doc_id comes after all others.
Very long texts are one list of lines. An empty table stays empty. Columns of the input keep their names; one called
n_lines, n_dropped or kept_sha256 is replaced where that is returned (not with `counts=False`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import CHUNK, bitmap_or, bitmap_rows, bloom_bits, staged
from ._words import tidy

_EDGE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """128-bit hashes of the lines' keys; None for a key that is too short."""
    import xxhash

    hashed, out = xxhash.xxh3_128_digest, []
    for line in text.split(b"\n"):
        key = line.strip(_EDGE).lower()  # bytes.lower() changes A-Z only
        long = len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(hashed(key) if long else None)
    return out


def _texts(column):
    tidy()
    return (b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist())


def _halves(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def twice_seen(docs: DataFrame, text: str, min_chars: int, log2_bits: int) -> np.ndarray:
    """The united twice-seen bitmap: 2^log2_bits / 8 bytes on the driver."""
    size = 1 << (log2_bits - 3)

    def fill(batches):
        once, twice, any_row = np.zeros(size, np.uint8), np.zeros(size, np.uint8), False
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                keys = []
                for t in _texts(batch.column(0).slice(start, 512)):
                    keys += {k for k in line_keys(t, min_chars) if k}
                if not keys:
                    continue
                any_row = True
                at = bloom_bits(_halves(keys)[:, 0], log2_bits, 1)[0]
                at, n = np.unique(at, return_counts=True)
                byte, bit = (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8)
                again = ((once[byte] & bit) != 0) | (n > 1)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
        if any_row:
            rows = [(c, False, d) for c, d in bitmap_rows(once)] + [(c, True, d) for c, d in bitmap_rows(twice)]
            yield pa.record_batch({"chunk": pa.array([r[0] for r in rows], pa.int32()), "twice": pa.array([r[1] for r in rows]), "data": pa.array([r[2] for r in rows], pa.binary())})

    def unite(table: pa.Table) -> pa.Table:
        import zlib

        once, twice = np.zeros(CHUNK, np.uint8), np.zeros(CHUNK, np.uint8)
        for is_twice, data in zip(table.column("twice").to_pylist(), table.column("data").to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            if is_twice:
                twice[: len(part)] |= part
            else:
                twice[: len(part)] |= once[: len(part)] & part
                once[: len(part)] |= part
        return pa.table({"chunk": table.column("chunk")[:1], "data": [zlib.compress(twice.tobytes(), 1)]})

    parts = docs.select(F.col(f"`{text}`")).mapInArrow(fill, "chunk int, twice boolean, data binary")
    rows = parts.groupBy("chunk").applyInArrow(unite, "chunk int, data binary").collect()
    return bitmap_or(((r.chunk, r.data) for r in rows), size)


def hot_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, log2_bits: int | None = None) -> DataFrame:
    """Exact: (key, n_docs, first_id) of the keys in at least min_docs documents; first_id is null if none has an id."""
    spark = docs.sparkSession
    log2_bits = log2_bits or min(28, max(22, (64 * docs.count()).bit_length()))
    filters = spark.sparkContext.broadcast(twice_seen(docs, text, min_chars, log2_bits) if min_docs > 1 else None)

    def suspects(batches):
        seen: dict[bytes, list[int]] = {}

        def out():
            rows = pa.record_batch({"key": pa.array(list(seen), pa.binary()), "n": pa.array([x[0] for x in seen.values()], pa.int64()), "first": pa.array([x[1] for x in seen.values()], pa.int64())})
            seen.clear()
            return rows

        for batch in batches:
            ids = batch.column(1).to_pylist()
            for start in range(0, batch.num_rows, 512):
                keys, of = [], []
                for i, t in enumerate(_texts(batch.column(0).slice(start, 512)), start):
                    mine = {k for k in line_keys(t, min_chars) if k}
                    keys += mine
                    of += [i] * len(mine)
                if keys and filters.value is not None:
                    at = bloom_bits(_halves(keys)[:, 0], log2_bits, 1)[0]
                    hit = (filters.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
                    picked = np.flatnonzero(hit)
                else:
                    picked = range(len(keys))
                for j in picked:
                    i, got = ids[of[j]], seen.get(keys[j])
                    if got is None:
                        seen[keys[j]] = [1, i]
                    else:
                        got[0] += 1
                        if i is not None and (got[1] is None or i < got[1]):
                            got[1] = i
            if len(seen) > 200_000:
                yield out()
        if seen:
            yield out()

    found = docs.select(F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long")).mapInArrow(suspects, "key binary, n long, first long")
    return found.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first_id")).where(F.col("n_docs") >= min_docs)


def drop_hot_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, log2_bits: int | None = None, max_broadcast: int = 500_000, digest: bool = False, counts: bool = True) -> DataFrame:
    """`docs` with hot lines out of `text`, plus n_lines and n_dropped; with `digest` the SHA-256, kept_sha256, stands for
    the text. Without `counts` (and `digest`) the columns are those of `docs`, in their order."""
    spark = docs.sparkSession
    hot = staged(hot_keys(docs, text, doc_id, min_docs, min_chars, log2_bits), "hot-lines")
    made = {"n_lines", "n_dropped", "kept_sha256"} if digest else {"n_lines", "n_dropped"} if counts else set()
    rest = [c for c in docs.columns if c != text and c not in made]
    names = [f"c{i}" for i in range(len(rest))]
    df = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{doc_id}`").cast("long").alias("i"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)])
    small = hot.limit(max_broadcast + 1).count() <= max_broadcast
    if small:
        table = spark.sparkContext.broadcast({bytes(r.key): r.first_id for r in hot.collect()})
    else:
        table = None

        def mine(batches):
            import xxhash

            for batch in batches:
                ids, keys, texts = [], [], []
                for i, t in zip(batch.column(1).to_pylist(), _texts(batch.column(0))):
                    own = {k for k in line_keys(t, min_chars) if k}
                    ids += [i] * len(own)
                    texts += [xxhash.xxh3_128_digest(t)] * len(own)
                    keys += own
                yield pa.record_batch({"i": pa.array(ids, pa.int64()), "x": pa.array(texts, pa.binary()), "key": pa.array(keys, pa.binary())})

        def hashed(batches):
            import xxhash

            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh3_128_digest(t) for t in _texts(batch.column(0))], pa.binary())], names=[*batch.schema.names, "x"])

        lists = df.select("t", "i").mapInArrow(mine, "i long, x binary, key binary").join(hot, "key").groupBy("i", "x").agg(F.collect_set(F.struct("key", "first_id")).alias("hot"))
        kinds = dict(df.dtypes)
        df = df.mapInArrow(hashed, ", ".join([*[f"{c} {kinds[c]}" for c in df.columns], "x binary"])).alias("a")
        df = df.join(lists.alias("b"), F.expr("a.i <=> b.i AND a.x = b.x"), "left").select("a.t", "a.i", *[f"a.{n}" for n in names], "b.hot")

    def apply(batches):
        import hashlib

        for batch in batches:
            lists = batch.column("hot").to_pylist() if table is None else None
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                n_lines, n_dropped, kept = [], [], []
                for j, (i, t) in enumerate(zip(part.column(1).to_pylist(), _texts(part.column(0)))):
                    known = table.value if table is not None else {x["key"]: x["first_id"] for x in lists[start + j] or ()}
                    lines, stay, own = t.split(b"\n"), [], set()
                    for line, key in zip(lines, line_keys(t, min_chars)):
                        if not key or key not in known:
                            stay.append(line)
                        elif keep_first and known[key] == i and key not in own:
                            own.add(key)
                            stay.append(line)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    text_now = b"\n".join(stay)
                    kept.append(hashlib.sha256(text_now).hexdigest().encode() if digest else text_now)
                columns = [part.column(k + 2) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_lines", "n_dropped", "kept"])

    kinds = dict(df.dtypes)
    out = df.mapInArrow(apply, ", ".join([*[f"{n} {kinds[n]}" for n in names], "n_lines long, n_dropped long, kept string"]))
    if not counts and not digest:
        back = dict(zip(rest, names)) | {text: "kept"}
        return out.select(*[F.col(back[c]).alias(c) for c in docs.columns])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, rest)], "n_lines", "n_dropped", F.col("kept").alias("kept_sha256" if digest else text))
