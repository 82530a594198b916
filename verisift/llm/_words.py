"""Words, their hashes and hashes of word windows, for many texts at once, on UTF-8 bytes with numpy.

A word's hash chains its 8-byte lanes through a bijective mixer; words beyond 32 bytes are hashed by XXH3. A window's
hash joins those of its halves through a mixer, so it is no polynomial and texts built to cancel do not collide. There
are two independent sets of them (other mixer, other constants, other chain); where a match decides a result, operators
compare digests of the words' bytes besides (see `substrings` and `jaccard`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def kept(name: str) -> dict:
    """A dict that lasts as long as the worker process. Functions travel to workers by value, so a global of this
    module would be a new one in each task, and the old one garbage in a cycle that is collected late."""
    import sys
    import types

    return sys.modules.setdefault(f"_kept_{name}", types.ModuleType(f"_kept_{name}")).__dict__


def tidy(step_mb: int = 40) -> None:
    """Collect garbage and give freed memory back when the process has grown by step_mb since the last time: what tasks
    before this one held (models, tables, batches) hangs in cycles and in the allocators' pools, which keep it for long."""
    import ctypes
    import gc

    try:
        with open("/proc/self/statm") as f:
            now = int(f.read().split()[1]) * 4096 / 1e6
        seen = kept("memory")
        if now > seen.get("mb", 150) + step_mb:
            gc.collect()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            with open("/proc/self/statm") as f:
                seen["mb"] = int(f.read().split()[1]) * 4096 / 1e6
    except (OSError, AttributeError):
        pass  # neither /proc nor malloc_trim here


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LANES = 4  # of 8 bytes; longer words are hashed one by one
_MASKS = np.array([(1 << (8 * min(n, 8))) - 1 for n in range(9)], np.uint64)
#: first multiplier, second multiplier, shifts and seed of each of the two sets of hashes
_KINDS = ((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (30, 27, 31), 0x5851F42D4C957F2D), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, (33, 29, 32), 0xD6E8FEB86659FD93))


def mix(x: np.ndarray, kind: int = 0) -> np.ndarray:
    """A 64-bit finisher: splitmix64's, or murmur's multipliers."""
    one, two, (a, b, c), _ = _KINDS[kind]
    x = x ^ (x >> U(a))
    x = x * U(one)
    x = x ^ (x >> U(b))
    x = x * U(two)
    return x ^ (x >> U(c))


def join(a: np.ndarray, b: np.ndarray, kind: int = 0) -> np.ndarray:
    """The hash of what a and b stand for, in this order; bijective in each of them."""
    one, two, (s, t, u), _ = _KINDS[kind]
    x = a ^ (a >> U(s))
    x *= U(two)
    x += b
    x ^= x >> U(u)
    x *= U(one)
    x ^= x >> U(t)
    return x


class Words:
    """Words of texts: `start` and `end` in `data`, `first[i]:first[i + 1]` those of text i, `h` their hashes."""

    __slots__ = ("data", "start", "end", "first", "h", "n")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        inside = np.empty(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[data], out=inside[1:-1])
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        joined = cut[inside[cut] & inside[cut + 1]]  # a text ends in a word and the next begins with one
        begins[joined] = True
        ends[joined] = True
        self.data, self.start, self.end = data, np.flatnonzero(begins[: len(data)]), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.h = self.hashes()

    def hashes(self, kind: int = 0) -> np.ndarray:
        """One of the two independent 64-bit hashes of each word."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + U(_KINDS[kind][3]), kind)
        if not len(h):
            return h
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        lanes = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        live, at, left = None, self.start, size
        for _ in range(LANES):
            lane = lanes[at] & _MASKS[np.minimum(left, 8)]
            if live is None:
                h = mix(h ^ lane, kind)
            else:
                h[live] = mix(h[live] ^ lane, kind)
            more = np.flatnonzero(left > 8)
            if not len(more):
                return h
            live, at, left = more if live is None else live[more], at[more] + 8, left[more] - 8
        import xxhash

        for j in live.tolist():
            h[j] = xxhash.xxh3_64_intdigest(self.data[self.start[j] : self.end[j]].tobytes(), seed=_KINDS[kind][3])
        return h

    def windows(self, k: int, kind: int = 0) -> np.ndarray:
        """The hash of words i .. i + k - 1, also of windows that cross texts (see `within`)."""
        level, many = self.h if kind == 0 else self.hashes(kind), len(self.h) - k + 1
        if many <= 0:
            return np.zeros(0, np.uint64)
        out, done, size = None, 0, 1
        while True:
            if k & size:
                part = level[done : done + many]
                out = part if out is None else join(out, part, kind)
                done += size
            if size * 2 > k:
                return out
            level = join(level[:-size], level[size:], kind)
            size *= 2

    def within(self, k: int) -> np.ndarray:
        """Which windows of k words lie in one text."""
        if len(self.h) < k:
            return np.zeros(0, bool)
        last = np.repeat(self.first[1:], self.n)
        return np.arange(len(self.h) - k + 1) + k <= last[: len(self.h) - k + 1]

    def plain(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words in a row, those of one text with one space between, and where each begins and ends there."""
        size = len(self.data)
        stays = np.zeros(size + 1, np.int8)
        np.add.at(stays, self.start, 1)
        np.add.at(stays, self.end, -1)
        stays = np.cumsum(stays, dtype=np.int8)
        gaps = self.end[(stays[self.end] == 0) & (self.end < size)]  # the first of the white space behind each word
        stays[gaps] = 1
        place = np.cumsum(stays, dtype=np.int64)
        out = self.data[stays[:size] > 0]
        out[place[gaps] - 1] = 32
        return out.tobytes(), place[self.start] - 1, place[self.end - 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def chunks(column, limit: int = 1_000_000):
    """An Arrow column of texts in runs of rows of at most `limit` bytes, or one row: (first row, bytes, offsets)."""
    tidy()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    if column.null_count:
        column = pa.array([b"" if x is None else x for x in column.to_pylist()], pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
