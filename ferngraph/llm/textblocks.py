"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. A word's hash is a polynomial over its bytes, taken from one
prefix sum over the whole block, then mixed; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C2B
_PINV = pow(_P, -1, 1 << 64)
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], U)
#: Bytes hashed at once; longer texts go in segments cut at white space.
BLOCK = 1 << 19
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every
    input bit; works in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            a = np.full(size, U(base))
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-but-one byte of all words of a block of texts, and at
    which word each text starts."""
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    full = bounds[1:] > bounds[:-1]
    heads, tails = bounds[:-1][full], bounds[1:][full] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, bounds)


class Hasher:
    """Hashes of any byte ranges of a block, A-Z lower-cased unless fold is off."""

    def __init__(self, buf: np.ndarray, fold: bool = True):
        n = len(buf)
        up, self.down = _pow(n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(((_LOWER[buf] if fold else buf).astype(U) + U(1)) * up[:n], out=self.sums[1:])

    def __call__(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return mix((self.sums[t] - self.sums[s]) * self.down[s] + (t - s).astype(U) * U(0xC2B2AE3D27D4EB4F))


def _hash_block(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and at which word each text starts."""
    if len(buf) == 0:
        return np.empty(0, U), np.zeros(len(bounds), np.int64)
    s, t, start = word_spans(buf, bounds)
    return Hasher(buf)(s, t), start


def segments(buf: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes in runs of about BLOCK, cut behind white space; a word
    longer than that stays whole."""
    at = 0
    while at < len(buf):
        end = min(at + BLOCK, len(buf))
        while end < len(buf):
            gaps = np.flatnonzero(_SPACE[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + BLOCK, len(buf))
        yield buf[at:end]
        at = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about BLOCK bytes: number of the first text,
    bytes, and where each text starts (one more entry than texts)."""
    buf, off = utf8(col)
    at = 0
    while at < len(off) - 1:
        end = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
        yield at, buf[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: number of the first text, hashes of all words of the
    block, and at which word each text starts (one more entry than texts)."""
    for at, buf, bounds in blocks(col):
        if len(buf) > 2 * BLOCK:
            h = np.concatenate([_hash_block(x, np.array([0, len(x)]))[0] for x in segments(buf)])
            yield at, h, np.array([0, len(h)])
        else:
            yield at, *_hash_block(buf, bounds)


def shingle_sets(col: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, sorted distinct hashes of its word shingles). A
    text of fewer words has its whole sequence as its one shingle; a text
    without words has none."""
    k = _MULT[:width] if width <= len(_MULT) else mix(np.arange(1, width + 1, dtype=U)) | U(1)
    for at, h, start in words(col):
        n = len(h) - width + 1
        if n > 0:
            rolled = h[:n] * k[0]
            for j in range(1, width):
                rolled += h[j : j + n] * k[j]
            mix(rolled)
        for d in range(len(start) - 1):
            a, b = int(start[d]), int(start[d + 1])
            if b - a >= width:
                yield at + d, np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.add.reduce(h[a:b] * k[: b - a], keepdims=True)
                yield at + d, mix(whole + U(0x2545F4914F6CDD1D * (b - a) & 0xFFFFFFFFFFFFFFFF))
            else:
                yield at + d, np.empty(0, U)
