"""The shared numpy tokeniser against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from verisift.llm._words import Words, chunks, sliding_min

W = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é漢 \n\t\x0b\x00"), max_size=30)), max_size=12), st.integers(1, 40))
def test_words_and_windows(texts, limit):
    seen = {}
    for row, data, offsets in chunks(pa.array(texts, pa.string()), limit):
        w = Words(data, offsets)
        raw, start, end = w.plain()
        g, ok = w.windows(3), w.within(3)
        for i in range(len(offsets) - 1):
            want = [x.encode() for x in W.findall(texts[row + i] or "")]
            a, b = w.first[i], w.first[i + 1]
            assert [bytes(w.data[s:e]) for s, e in zip(w.start[a:b], w.end[a:b])] == want
            for word, h in zip(want, w.h[a:b].tolist()):
                assert seen.setdefault(("w", word), h) == h
            for j in range(a, b):
                inside = j < len(ok) and bool(ok[j])
                assert inside == (j + 3 <= b)
                if inside:
                    key = ("g", *want[j - a : j - a + 3])
                    assert seen.setdefault(key, int(g[j])) == int(g[j])
            assert (raw[start[a] : end[b - 1]] if b > a else b"") == b" ".join(want)
    for kind in ("w", "g"):
        values = [v for k, v in seen.items() if k[0] == kind]
        assert len(values) == len(set(values))


def test_hashes_of_long_and_structured_words():
    """Words of every length, each with its own hashes, wherever they stand; windows of different sizes are no sums."""
    words = [("ab" * 40)[:n] for n in range(1, 80)] + [("ba" * 40)[:n] for n in range(1, 80)]
    for kind in (0, 1):
        first = None
        for text in (" ".join(words), "x\n" + "  ".join(words)):
            data = np.frombuffer(text.encode(), np.uint8)
            h = Words(data, np.array([0, len(data)])).hashes(kind)[-len(words) :]
            assert len(set(h.tolist())) == len(words) and (first is None or first == h.tolist())
            first = h.tolist()
    odd = [bin(i).count("1") % 2 for i in range(4096)]
    text = " ".join("ab"[x] for x in odd) + " | " + " ".join("ba"[x] for x in odd)
    w = Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    for k in (2048, 4096):
        g = w.windows(k)
        assert g[0] != g[4097] and g[0] == w.windows(k)[0] and w.windows(k, 1)[0] != w.windows(k, 1)[4097]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 60).astype(np.uint64)
    for w in (1, 2, 3, 7, 26, 60):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(61 - w)]
    assert len(sliding_min(x, 61)) == 0
