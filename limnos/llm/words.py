"""Words of whole texts as NumPy arrays, a batch of texts at a time.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D.
Those six are single bytes in UTF-8 and never part of a longer character, so
a batch's words are found on its byte buffer: no Python object per word.
Hashes are 64 bits wide; equal words and word sequences have equal hashes.
They are sums of random values looked up or mixed by place, not polynomials,
so different words meet by chance alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_P = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so close inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: bytes of a word that are looked up by their place; longer words are hashed in pieces
_PLACES = 64
# a random 64-bit value for each place and byte
_TABLE = mix64(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(_P))
# a random 64-bit value per byte
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def _ended(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(total + size.astype(np.uint64) * np.uint64(_P))


def sequence_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] (64-bit numbers) for each range; ranges ascend
    and don't overlap. Each value is mixed with its place before they are
    added up, so no two sequences have equal sums by their making."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + _BLOCK)))
        base, top = start[lo], end[hi - 1]
        size = end[lo:hi] - start[lo:hi]
        until = np.append(start[lo + 1:hi], top)
        place = np.arange(base, top) - np.repeat(start[lo:hi], until - start[lo:hi])
        mixed = mix64(values[base:top].astype(np.uint64) + mix64(place.astype(np.uint64) + np.uint64(_P)))
        total = np.zeros(top - base + 1, np.uint64)
        np.cumsum(mixed, out=total[1:])
        out[lo:hi] = _ended(total[end[lo:hi] - base] - total[start[lo:hi] - base], size)
        lo = hi
    return out


def byte_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] (bytes) for each range; ranges ascend and don't
    overlap. Values are looked up by place and byte and added up, in pieces of
    _PLACES bytes; the pieces of a longer range are hashed in turn."""
    size = end - start
    pieces = np.maximum(1, -(-size // _PLACES))
    if len(pieces) and pieces.max() > 1:
        owner = np.repeat(np.arange(len(start)), pieces)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = start[owner] + turn * _PLACES
        parts = _piece_hashes(raw, begin, np.minimum(begin + _PLACES, end[owner]))
        first = np.cumsum(pieces) - pieces
        many = np.flatnonzero(pieces > 1)
        out = parts[first]
        sub = np.concatenate([[0], np.cumsum(pieces[many])])
        out[many] = sequence_hashes(parts[pieces[owner] > 1], sub[:-1], sub[1:]) + size[many].astype(np.uint64) * np.uint64(_P)
        return out
    return _piece_hashes(raw, start, end)


def _piece_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    held = np.empty(0, np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + _BLOCK)))
        base, top = start[lo], end[hi - 1]
        until = np.append(start[lo + 1:hi], top)
        # bytes between ranges are looked up too, anywhere, and not counted
        place = np.arange(base, top).astype(np.uint16) - np.repeat(start[lo:hi].astype(np.uint16), until - start[lo:hi])
        at = (place & np.uint16(_PLACES - 1)) << np.uint16(8) | raw[base:top]
        if len(held) < len(at):
            held = np.empty(len(at), np.uint64)
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(np.take(_TABLE, at, out=held[:len(at)], mode="clip"), out=total[1:])
        out[lo:hi] = _ended(total[end[lo:hi] - base] - total[start[lo:hi] - base], end[lo:hi] - start[lo:hi])
        lo = hi
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two sequences, one behind the other, from theirs."""
    return mix64(mix64(a + np.uint64(_P)) + b * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes behind one another, and the n + 1 borders.
    A null text is an empty one."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[borders[0]:borders[-1]], borders - borders[0]


class Words:
    """Words of a batch: byte ranges ``start``/``end`` in ``raw``; document i
    owns words ``first[i]`` .. ``first[i + 1] - 1``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, self.borders = text_bytes(texts)
        borders = self.borders
        self.raw = _LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, dtype=bool)
        np.logical_not(_SPACE[raw], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        # a word also ends where its document does
        cut = np.unique(borders[1:-1])
        cut = cut[inside[cut] & inside[cut + 1]]
        if len(cut):
            self.start = np.sort(np.concatenate([self.start, cut]))
            self.end = np.sort(np.concatenate([self.end, cut]))
        self.first = np.searchsorted(self.start, borders, side="left")

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return byte_hashes(self.raw, self.start, self.end) if len(self) else np.zeros(0, np.uint64)

    def window_hashes(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k-word window at each word, and whether that window
        lies inside the word's document."""
        h = self.hashes() if hashes is None else hashes
        n = len(h)
        out, inside = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n:
            at = np.arange(n)
            inside = at + k <= np.repeat(self.first[1:], self.counts())
            if n >= k:
                out[:n - k + 1] = _windows(h, k)
        return out, inside

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]].tobytes()


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours, from those of half as many."""
    if k == 1:
        return h
    half = _windows(h, k // 2)
    out = _joined(half[:len(half) - k // 2], half[k // 2:])
    return out if k % 2 == 0 else _joined(out[:len(out) - 1], h[k - 1:])


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Distinct k-word shingle hashes of each document, ascending. A document
    of fewer than k words has its whole word sequence as one shingle, one
    without words has none."""
    h = words.hashes()
    windows, inside = words.window_hashes(k, h)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(windows[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(sequence_hashes(h, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 23):
    """The batch in slices of about ``most`` bytes of text, one row at least."""
    ends, lo = text_bytes(batch.column(column))[1], 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes: of small ones the high planes are zero,
    which Spark's compression takes out."""
    return x.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "u1").reshape(4, -1).T.copy().view("<u4").ravel()


def ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin:begin + size] of each range, behind one another."""
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[np.arange(len(shift)) + shift]
