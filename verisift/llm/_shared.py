"""What several operators of this subpackage need: staged tables, bounded Bloom filters, Arrow batches."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Workers need no copy of this package on their path: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules["verisift.llm"])

#: One word: a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def part_of(key: Column, n: int) -> Column:
    """A number below n from the MD5 of a key's text (null: empty): the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % n


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_mine: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/verisift-{name}-{uuid.uuid4().hex}"
    if not _mine:
        atexit.register(_forget_all)
    _mine.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
    if path in _mine:
        _mine.remove(path)


def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _mine:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is temporary anyway
            return


BATCH_ROWS = 1000  # of texts at once between the JVM and Python, where the session allows more
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session hands Python BATCH_ROWS rows at once at most.

    Queries and pipeline stages call it, as what they return runs only when it is written: an Arrow batch of 10,000 texts
    is held several times over by the JVM's buffers, which keep their size, and by each worker.
    """
    rows = int(spark.conf.get(_ROWS))
    spark.conf.set(_ROWS, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage and survives lost executors. With `by`, an int column,
    in a folder for each of its values, so that a filter on it reads those rows alone.

    While it is written, Python is handed BATCH_ROWS rows at most: an Arrow batch is held several times over.
    """
    spark = df.sparkSession
    path, rows = new_path(spark, name), spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_ROWS, rows)
    out = spark.read.schema(df.schema).parquet(path)
    if by:
        out = out.select(df.columns)
    out.staged_path = path
    return out


def staged_so_far() -> int:
    """A mark for `release`."""
    return len(_mine)


def _roots(df: DataFrame) -> str | None:
    """The folders that a result reads, as one text; None if its plan has leaves of a kind that may hide some."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation":
            if leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                found.append(leaf.relation().location().rootPaths().mkString("\n"))
        elif kind not in ("LocalRelation", "LogicalRDD", "OneRowRelation", "Range"):
            return None
    return "\n".join(found)


def release(since: int, *results: DataFrame) -> None:
    """Delete what was staged since a mark and these results do not read."""
    used = [_roots(df) for df in results]
    if None in used:
        return  # kept until the process ends
    for path in _mine[since:]:
        if path.rsplit("/", 1)[-1] not in "\n".join(used):
            drop_staged(results[0].sparkSession, path)


HOT = 2000


def join_hot(rows: DataFrame, table: DataFrame, key: str, share: int = HOT) -> DataFrame:
    """`rows`, a staged table, left-joined with `table`, which has one row for each value of `key`.

    Keys of more than one in `share` rows, fewer than `share` in number whatever the size, are joined by a broadcast, so
    their rows are not dealt by the key; all others by a shuffle.
    """
    many = rows.count()
    hot = staged(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * share > many).select(key), "hot-keys")
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, "left")
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return warm.unionByName(cold)


# ---- Bloom filters of a bounded size -----------------------------------------------------------

CHUNK = 1 << 16  # bytes of a bitmap that travel in one row


def filter_bits(keys: int, least: int = 20, most: int = 28) -> int:
    """log2 of the bits of a filter of three probes for so many keys: twelve each, 32 MB at most. Beyond that a filter lets
    more through, never less."""
    return min(most, max(least, (12 * keys).bit_length()))


def bloom_bits(h: np.ndarray, log2_bits: int, hashes: int) -> list[np.ndarray]:
    """Bit positions of 64-bit hashes: double hashing, one array for each probe."""
    mask, step = np.uint64((1 << log2_bits) - 1), (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - log2_bits)) & mask for k in range(hashes)]


def bloom_set(bits: np.ndarray, h: np.ndarray, log2_bits: int, hashes: int) -> None:
    for at in bloom_bits(h, log2_bits, hashes):
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))


def bloom_has(bits: np.ndarray, h: np.ndarray, log2_bits: int, hashes: int) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in bloom_bits(h, log2_bits, hashes):
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
    return found


def bitmap_rows(bits: np.ndarray):
    """The non-empty chunks of a bitmap as (chunk, bytes)."""
    import zlib

    for i in range(0, len(bits), CHUNK):
        part = bits[i : i + CHUNK]
        if part.any():
            yield i // CHUNK, zlib.compress(part.tobytes(), 1)


def bitmap_or(rows, n_bytes: int) -> np.ndarray:
    import zlib

    bits = np.zeros(n_bytes, np.uint8)
    for chunk, data in rows:
        part = np.frombuffer(zlib.decompress(data), np.uint8)
        bits[chunk * CHUNK : chunk * CHUNK + len(part)] |= part
    return bits


def _or_chunk(table: pa.Table) -> pa.Table:
    import zlib

    total = None
    for data in table.column("data").to_pylist():
        part = np.frombuffer(zlib.decompress(data), np.uint8)
        total = part.copy() if total is None else np.bitwise_or(total, part, out=total)
    return pa.table({"chunk": table.column("chunk")[:1], "data": [zlib.compress(total.tobytes(), 1)]})


def bloom_of(hashes: DataFrame, column: str, log2_bits: int = 24, n_hashes: int = 3) -> np.ndarray:
    """A Bloom filter of a long column. Its size is fixed: once it is full it lets more through, never less.

    Tasks fill one bitmap each; equal chunks are united on the executors; the driver gets 2^log2_bits / 8 bytes.
    """

    def fill(batches):
        bits, any_row = np.zeros(1 << (log2_bits - 3), np.uint8), False
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(h):
                bloom_set(bits, h, log2_bits, n_hashes)
                any_row = True
        if any_row:
            chunks = list(bitmap_rows(bits))
            yield pa.record_batch({"chunk": pa.array([c for c, _ in chunks], pa.int32()), "data": pa.array([d for _, d in chunks], pa.binary())})

    parts = hashes.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(fill, "chunk int, data binary")
    merged = parts.groupBy("chunk").applyInArrow(_or_chunk, "chunk int, data binary")
    return bitmap_or(((r.chunk, r.data) for r in merged.collect()), 1 << (log2_bits - 3))
