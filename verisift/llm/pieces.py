"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

All segmentations of a text into vocabulary pieces form a lattice; a piece with id r weighs 1 / r^alpha (the vocabulary
is in merge order). Forward filtering sums the weights of all ways to each place; backward sampling then draws a
segmentation from the end, each with its exact probability. Draws come from a hash of the row's key, the segment's number
and the step, so a row has the same pieces wherever and whenever it is encoded.

No piece of such a vocabulary spans the start of a space run, so the lattice falls into segments (spaces and the word behind them), and
characters that occur in no longer piece are segments of their own; each distinct segment of a batch is filtered once.
Segments are the same when their characters are (a hash finds them, a comparison decides), and pieces are found by a trie
of code points. A segment beyond LONG characters, however long, is filtered by itself in blocks: time grows with its
length, memory by a number a character. A character that no piece has, and a literal U+2581, is spelled in byte pieces.
As in the library a space precedes each text that is not empty; decoding takes it off, so decode(encode(x)) == x for
every text.

A null text encodes to no pieces, as an empty one does; a null key is a key of its own. Rows with equal keys and texts
have equal pieces. An empty table stays empty. Columns of the input keep their names, but for one called as the output.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._words import U, join, kept, mix, tidy

SPACE = 0x2581
SPELLED = 0x110000  # stands for a literal U+2581
LONG = 512  # characters of a segment from which on it is filtered by itself
BLOCK = 1 << 14
CHARS, CELLS = 400_000, 1_000_000  # of texts, and of the tables of their segments, that are in memory at once
FREE = np.uint64(2**64 - 1)


def vocabulary(model: str | None = None) -> dict:
    """Pieces of a SentencePiece model as arrays; plain data, to be broadcast (a vocabulary has a fixed size)."""
    import sentencepiece

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces, byte_id = [], np.full(256, -1, np.int32)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((i, sp.id_to_piece(i)))
    assert (byte_id >= 0).all(), "a vocabulary without byte pieces cannot spell every text"
    inner = [p for _, p in pieces if "▁" in p.lstrip("▁") or p.startswith("▁▁") and p.strip("▁")]
    assert not inner, f"pieces span segments: {inner[:3]}"
    return {"pieces": pieces, "byte_id": byte_id, "size": sp.get_piece_size()}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocab: dict, alpha: float = 1.0):
        self.byte_id = vocab["byte_id"]
        self.longest = max(len(p) for _, p in vocab["pieces"])
        ids = np.array([i for i, _ in vocab["pieces"]], np.int64)
        # a trie: (node, code point) to the next node, in an open-addressing table of exact keys; each node's piece or -1
        edges: dict[int, int] = {}
        ends = [-1]
        for i, p in vocab["pieces"]:
            node = 0
            for c in p:
                step = node << 21 | ord(c)
                if step not in edges:
                    edges[step] = len(ends)
                    ends.append(-1)
                node = edges[step]
            ends[node] = i
        self.ends = np.array(ends, np.int32)
        self.bits = max(8, int(2 * len(edges)).bit_length())
        self.edges, self.next = np.full(1 << self.bits, FREE), np.zeros(1 << self.bits, np.int32)
        keys, nodes = np.array(list(edges), np.uint64), np.array(list(edges.values()), np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.edges[at] == FREE
            self.edges[at[free]] = keys[left[free]]  # of several the last stays
            won = self.edges[at] == keys[left]
            self.next[at[won]] = nodes[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        self.first = np.full(0x110001, -1, np.int32)  # the root's edges
        root = keys < U(1 << 21)
        self.first[keys[root].astype(np.int64)] = nodes[root]
        weight = np.full(vocab["size"], -np.inf)
        weight[ids] = -alpha * np.log(np.maximum(ids, 2))
        self.weights = np.append(weight, [-alpha * np.log(vocab["size"]) * 4, -np.inf])  # [-2]: a spelled character, [-1]: no piece
        self.linear = np.exp(self.weights)
        self.in_longer = np.zeros(0x110001, bool)
        for _, p in vocab["pieces"]:
            if len(p) > 1:
                self.in_longer[[ord(c) for c in p]] = True
        # decoding: the bytes of every id
        raw = [b""] * vocab["size"]
        for b, i in enumerate(self.byte_id.tolist()):
            raw[i] = bytes([b])
        for i, p in vocab["pieces"]:
            raw[i] = p.replace("▁", " ").encode()
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def _step(self, nodes: np.ndarray, cps: np.ndarray) -> np.ndarray:
        """The trie's nodes behind `nodes` by these code points, -1 where there is none."""
        keys = nodes.astype(np.uint64) << U(21) | cps.astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            slot = self.edges[at]
            hit = slot == keys[left]
            out[left[hit]] = self.next[at[hit]]
            go = ~hit & (slot != FREE)
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets); keys are 64-bit hashes of the rows' keys."""
        chars = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(chars)])
        joined = "".join(" " + t for t in texts if t)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        n = len(cps)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space = cps == 32
        cps[cps == SPACE] = SPELLED
        cps[space] = SPACE
        # segments
        space, alone = cps == SPACE, ~self.in_longer[cps]
        cut = np.ones(n, bool)
        cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[first[:-1][chars > 0]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, n))
        row = np.searchsorted(first, start, "right") - 1
        number = np.arange(len(start)) - np.searchsorted(start, first[row])
        seed = mix(keys[row] + number.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        piece_at = np.full(n, -1, np.int32)  # at a piece's first character: its id; -1: none starts here; -2: spelled
        size = 1
        while True:
            mine = np.flatnonzero((length > size // 2) & (length <= size) if size > 1 else length == 1)
            self._segments(cps, start, length, seed, mine, size, piece_at)
            if size >= min(length.max(), LONG):
                break
            size *= 2
        for j in np.flatnonzero(length > LONG).tolist():
            a, b = int(start[j]), int(start[j] + length[j])
            self._long(cps[a:b], int(seed[j]), piece_at[a:b])
        # ids in order; spelled characters take as many as their bytes
        at = np.flatnonzero(piece_at != -1)
        found = piece_at[at]
        spelled = found == -2
        counts = np.ones(len(at), np.int64)
        if spelled.any():
            cp = np.where(cps[at] == SPELLED, SPACE, cps[at])
            counts[spelled] = 1 + (cp[spelled] > 0x7F) + (cp[spelled] > 0x7FF) + (cp[spelled] > 0xFFFF)
        ids = np.repeat(found, counts)
        ends = np.cumsum(counts)
        for j in np.flatnonzero(spelled).tolist():
            ids[ends[j] - counts[j] : ends[j]] = self.byte_id[list(chr(cp[j]).encode("utf-8", "surrogatepass"))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(at, first)]

    def _segments(self, cps, start, length, seed, mine, size, piece_at) -> None:
        """Find the distinct ones of the segments `mine` (no longer than size); filter and sample some at a time."""
        while len(mine):
            s, n = start[mine], length[mine]
            h = mix(n.astype(np.uint64))
            for j in range(size):
                live = np.flatnonzero(n > j) if j > size // 2 else slice(None)
                h[live] = join(h[live], cps[s[live] + j].astype(np.uint64))
            _, pick, of = np.unique(h, return_index=True, return_inverse=True)
            # the hash finds the first of equal segments, their characters decide; others wait for the next turn
            same, first = n == n[pick][of], s[pick][of]
            for j in range(size):
                live = np.flatnonzero(same & (n > j)) if j > size // 2 else np.flatnonzero(same)
                same[live] = cps[s[live] + j] == cps[first[live] + j]
            order = np.argsort(of, kind="stable")
            order = order[same[order]]
            first = np.searchsorted(of[order], np.arange(len(pick) + 1))
            some = max(1, CELLS // ((size + 1) * min(size, self.longest)))  # so the tables stay small
            for a in range(0, len(pick), some):
                b = min(a + some, len(pick))
                uses = order[first[a] : first[b]]
                tables = self._filtered(cps, s[pick[a:b]], n[pick[a:b]], size)
                self._sampled(*tables, of[uses] - a, s[uses], n[uses], seed[mine[uses]], piece_at)
            mine = mine[~same]

    def _pieces(self, cps: np.ndarray, start: np.ndarray, room: np.ndarray, top: int) -> np.ndarray:
        """[length, place]: the id of the piece of that length from a place that has room for it; -1: none, -2: spelled."""
        ids = np.full((top + 1, len(start)), -1, np.int32)
        live = np.flatnonzero(room > 0)
        for k in range(1, top + 1):
            node = self._step(node, cps[start[live] + (k - 1)]) if k > 1 else self.first[cps[start[live]]]
            on = node >= 0
            ids[k, live[on]] = self.ends[node[on]]
            if k == 1:
                ids[1, live[ids[1, live] == -1]] = -2
            on &= room[live] > k
            live, node = live[on], node[on]
            if not len(live):
                break
        return ids

    def _filtered(self, cps, us, un, size) -> tuple[np.ndarray, np.ndarray]:
        """([length, place, segment]: ids of the pieces; [end, segment, length]: cumulative chances of the last one's)."""
        reach, top = np.arange(size), min(size, self.longest)
        room = np.maximum(un[None, :] - reach[:, None], 0).ravel()
        ids = self._pieces(cps, (us[None, :] + reach[:, None]).ravel(), room, top).reshape(top + 1, size, len(us))
        got = self._sums(self.linear[ids], un, size, top) if size <= 32 else None
        return ids, got if got is not None else self._log_sums(self.weights[ids], size, top)

    @staticmethod
    def _sums(weight, un, size, top) -> np.ndarray | None:
        """The chances from sums of products; None if these become too small for that."""
        forward = np.zeros((size + 1, len(un)))
        forward[0] = 1
        chance = np.ones((size + 1, len(un), top), np.float32)
        for j in range(1, size + 1):
            k = np.arange(1, min(top, j) + 1)
            part = np.cumsum(forward[j - k] * weight[k, j - k], axis=0)
            forward[j] = part[-1]
            chance[j, :, : len(k)] = (part / np.where(part[-1] > 0, part[-1], 1)).T
        return chance if (forward[un, np.arange(len(un))] > 1e-280).all() else None

    @staticmethod
    def _log_sums(weight, size, top) -> np.ndarray:
        """The same by logarithms, for long segments and small weights."""
        forward = np.full((size + 1, weight.shape[2]), -np.inf)
        forward[0] = 0
        chance = np.ones((size + 1, weight.shape[2], top), np.float32)
        for j in range(1, size + 1):
            k = np.arange(1, min(top, j) + 1)
            terms = forward[j - k] + weight[k, j - k]
            peak = terms.max(axis=0)
            peak = np.where(np.isfinite(peak), peak, 0.0)
            part = np.cumsum(np.exp(terms - peak), axis=0)
            with np.errstate(divide="ignore"):
                forward[j] = peak + np.log(part[-1])
            chance[j, :, : len(k)] = (part / np.where(part[-1] > 0, part[-1], 1)).T
        return chance

    def _sampled(self, ids, chance, of, s, n, seed, piece_at) -> None:
        """Draw each use's pieces from its end, by the tables of its segment."""
        top = chance.shape[2]
        at, live, step = n.copy(), np.arange(len(s)), 0
        while len(live):
            draw = (mix(seed[live] + U((step + 1) * 0xBF58476D1CE4E5B9 % 2**64)) >> U(11)).astype(np.float64) * 2.0**-53
            u, j = of[live], at[live]
            k = (chance[j, u] <= draw[:, None]).sum(axis=1) + 1
            k = np.minimum(k, np.minimum(j, top))
            piece_at[s[live] + j - k] = ids[k, j - k, u]
            at[live] = j - k
            live = live[at[live] > 0]
            step += 1

    def _long(self, cps: np.ndarray, seed: int, piece_at: np.ndarray) -> None:
        """Filter and sample one segment of any length; the pieces are looked up again, block by block, on the way back."""
        n, top = len(cps), self.longest
        weight = self.weights

        def found(a: int, b: int):
            """(place, length, id, weight) of the pieces from places a to b."""
            at = np.arange(a, b)
            ids = self._pieces(cps, at, np.minimum(n - at, top), top).T
            place, k = np.nonzero(ids != -1)
            i = ids[place, k]
            return (place + a).tolist(), k.tolist(), i.tolist(), weight[i].tolist()

        exp, log, low = math.exp, math.log, -math.inf
        forward = array("d", [low]) * (n + 1)
        forward[0] = 0.0
        for a in range(0, n, BLOCK):
            for at, k, _, w in zip(*found(a, min(a + BLOCK, n))):
                old, new = forward[at + k], forward[at] + w
                forward[at + k] = new if old == low else max(old, new) + log(1 + exp(-abs(old - new)))
        end, step = n, 0
        for b in range(n, 0, -BLOCK):
            a = max(b - BLOCK, 0)
            ends: dict[int, list] = {}
            for at, k, i, w in zip(*found(max(a - top, 0), b)):
                if a < at + k <= b:
                    ends.setdefault(at + k, []).append((k, i, forward[at] + w))
            while end > a:
                draw = int(mix(np.array([(seed + (step + 1) * 0xBF58476D1CE4E5B9) % 2**64], np.uint64))[0]) >> 11
                left, total = draw * 2.0**-53, forward[end]
                for k, i, w in sorted(ends[end]):
                    left -= exp(w - total)
                    if left < 0:
                        break
                piece_at[end - k] = i
                end, step = end - k, step + 1

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of rows of ids."""
        lens = self.raw_len[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(self.raw_at[ids] - (ends - lens), lens)
        data = self.raw[index].tobytes()
        at = np.concatenate([[0], ends])[offsets].tolist()
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(at, at[1:])]  # without the first space


def _codec(vocab, name: str, alpha: float) -> "Codec":
    """One codec a worker process, not a task; its tables are built from the broadcast vocabulary of that name."""
    held = kept("codecs")
    key = f"{name} {alpha} {Codec.__name__}"
    if key not in held:
        for old in [k for k in held if not k.startswith("__")]:
            del held[old]
        held[key] = Codec(vocab.value, alpha)
    return held[key]


def row_seeds(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of keys; a null key has one of its own."""
    import xxhash

    text = keys.cast(pa.string()).to_pylist()
    return np.array([xxhash.xxh3_64_intdigest(b"\x00" if k is None else b"\x01" + k.encode()) for k in text], np.uint64)


def encoded_batches(batch: pa.RecordBatch, codec: Codec, limit: int = CHARS):
    """(texts, ids, offsets) of runs of a batch's rows (text, key), about `limit` characters each."""
    tidy()
    texts = ["" if t is None else t for t in batch.column(0).to_pylist()]
    seeds, at = row_seeds(batch.column(1)), 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= limit):
            chars += len(texts[end])
            end += 1
        yield at, texts[at:end], *codec.encode(texts[at:end], seeds[at:end])
        at = end


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "pieces", model: str | None = None, alpha: float = 1.0) -> DataFrame:
    """`docs` with the sampled piece ids of each whole text (array<int>)."""
    vocab, name = docs.sparkSession.sparkContext.broadcast(vocabulary(model)), str(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    df = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{key}`").cast("string").alias("k"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])

    def run(batches):
        codec = _codec(vocab, name, alpha)
        for batch in batches:
            for at, texts, ids, offsets in encoded_batches(batch, codec):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                rest = [batch.column(i + 2).slice(at, len(texts)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=[*names, "p"])

    kinds = dict(df.dtypes)
    got = df.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "p array<int>"]))
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns) if c != out], F.col("p").alias(out))


def decode(rows: DataFrame, pieces: str = "pieces", out: str = "text", model: str | None = None) -> DataFrame:
    """`rows` with the text that the piece ids stand for; null ids give an empty text."""
    vocab, name = rows.sparkSession.sparkContext.broadcast(vocabulary(model)), str(model)
    rest = [c for c in rows.columns if c != out]
    names = [f"c{i}" for i in range(len(rest))]
    df = rows.select(F.coalesce(F.col(f"`{pieces}`"), F.array().cast("array<int>")).alias("p"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)])

    def run(batches):
        codec = _codec(vocab, name, 1.0)
        for batch in batches:
            p = batch.column(0)
            offsets = p.offsets.to_numpy().astype(np.int64)
            ids = p.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            texts = codec.decode(ids, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "t"])

    kinds = dict(df.dtypes)
    got = df.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "t string"]))
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, rest)], F.col("t").alias(out))


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None, alpha: float = 1.0) -> DataFrame:
    """(key, n_chars, n_pieces, pieces_sha256, decoded_sha256, lossless): encodes and decodes every whole text.

    pieces_sha256 is over the ids as little-endian 32-bit integers; decoded_sha256 over the decoded UTF-8 text.
    """
    vocab, name = docs.sparkSession.sparkContext.broadcast(vocabulary(model)), str(model)
    kind = dict(docs.dtypes)[key]
    df = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{key}`").alias("i"))

    def run(batches):
        import hashlib

        codec = _codec(vocab, name, alpha)
        for batch in batches:
            for at, texts, ids, offsets in encoded_batches(batch, codec):
                back = codec.decode(ids, offsets)
                raw, cuts = ids.astype("<i4").tobytes(), (offsets * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).slice(at, len(texts)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        pa.array([x == t.encode() for x, t in zip(back, texts)]),
                    ],
                    names=["i", "n_chars", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"],
                )

    got = df.mapInArrow(run, f"i {kind}, n_chars long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
    return got.withColumnRenamed("i", key)
