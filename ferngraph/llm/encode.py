"""Encoding whole texts with a vocabulary file of the tokenizers library.

A text is cut only where the tokenizer's own pre-tokenizer always starts a new
piece, whatever stands around, so the ids of the whole text are those of its
parts in order. Parts are found and hashed a block of texts at a time; the
library encodes each distinct part once per worker, and a bounded table of
64-bit hashes answers for parts that were met before. The strings of added
tokens, such as an end mark, are their tokens wherever the library takes them
for that, so a text that holds one goes to the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from ferngraph.llm.textblocks import U, Hasher, blocks

#: Parts, and ids of parts, that a worker's table holds before it starts afresh
#: (about 35 MB).
PARTS, POOL = 500_000, 4_000_000
#: A part that ends in letters and simple marks: the marks are a piece of their own.
_TAIL = re.compile(r"(.*[A-Za-z])([.,:;!?]+)", re.S)
_LINES = re.compile(r"(.*\S)\n(\S.*)", re.S)

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: First bytes of those three-byte characters some of which are white space, and of the two-byte ones.
_MAY_BLANK = np.isin(np.arange(256), (0xE1, 0xE2, 0xE3))
_MAY_BLANK_2 = 0xC2

#: How byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MARK = [chr(b) if b in _PLAIN else chr(256 + sum(x not in _PLAIN for x in range(b))) for b in range(256)]


class _Table:
    """Ids of parts by hash: open addressing, over a pool of ids. Entry 0 is none."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self._slots((2 * PARTS).bit_length())
        self.pool, self.used = np.empty(1 << 16, self.dtype), 0
        self.start, self.size, self.count = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 1

    def _slots(self, bits: int) -> None:
        self.bits, self.keys, self.entry = bits, np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32)

    def _put(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        left, slot = np.arange(len(hashes)), (hashes >> U(64 - self.bits)).astype(np.int64)
        while len(left):
            free = left[self.entry[slot[left]] == 0]
            self.entry[slot[free]], self.keys[slot[free]] = entries[free], hashes[free]  # of several, the last stays
            left = left[self.entry[slot[left]] != entries[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, 0 where there is none."""
        slot = (hashes >> U(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.entry[slot], 0)
        again = np.flatnonzero((out == 0) & (self.entry[slot] > 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            at = slot[again]
            out[again] = np.where(self.keys[at] == hashes[again], self.entry[at], 0)
            again = again[(out[again] == 0) & (self.entry[at] > 0)]
        return out

    def add(self, hashes: np.ndarray, sizes: list[int], ids: list[int]) -> None:
        """Distinct hashes that have no entry, the number of ids of each, and those ids."""
        n, end = self.count + len(hashes), self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        while n > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.pool[self.used : end] = ids
        own = slice(self.count, n)
        self.size[own] = sizes
        self.start[own] = self.used + np.cumsum(self.size[own]) - self.size[own]
        if 2 * n > 1 << self.bits:  # one very long text
            held = np.flatnonzero(self.entry)
            old = self.keys[held], self.entry[held]
            self._slots((2 * n).bit_length())
            self._put(*old)
        self._put(hashes, np.arange(self.count, n, dtype=np.int32))
        self.count, self.used = n, end

    @property
    def full(self) -> bool:
        return self.count > PARTS or self.used > POOL


class Encoder:
    """cut: "space" where a space starts a piece and belongs to it, "blank"
    where white space is dropped, "" for tokenizers of other kinds, which get
    whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tokenize = self.tokenizer.model.tokenize
        added = spec.get("added_tokens") or []
        # where the library looks for added tokens in normalized text, it gets whole texts
        self.cut = "" if any(t["normalized"] for t in added) else self._cut(spec)
        self.added = [t["content"] for t in added]
        self.marks: dict[str, list[int]] = {}
        self.table = _Table(self.dtype)

    @staticmethod
    def _cut(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "space"
        steps = pre.get("pretokenizers", [])
        if pre.get("type") == "Sequence" and steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", ""):
            return "blank"
        return ""

    # one part

    def _mark(self, text: str) -> list[int]:
        """Ids of a run of marks, which are few."""
        if text not in self.marks:
            if len(self.marks) > 4096:
                self.marks.clear()
            self.marks[text] = self._plain(text)
        return self.marks[text]

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, text: str, before: str = "") -> list[int]:
        """Ids of a part that follows `before`, a space or nothing."""
        if self.cut and text.isalpha():
            if text.isascii():  # letters that stand for themselves
                word = (_MARK[32] if before else "") + (text if self.cut == "space" else text.lower())
                return [t.id for t in self.tokenize(word)]
            if max(text) < "ɐ" and (low := text.lower()).isalpha():
                word = before + (text if self.cut == "space" else low)
                return [t.id for t in self.tokenize("".join(map(_MARK.__getitem__, word.encode())))]
        if self.cut and not any(token in text for token in self.added):
            if m := _TAIL.fullmatch(text):
                return self._part(m[1], before) + self._mark(m[2])
            if self.cut == "space" and "\n" in text and (m := _LINES.fullmatch(text)):
                return self._part(m[1], before) + self._mark("\n") + self._part(m[2])
        return self._plain(before + text)

    # blocks of texts

    def _parts(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one byte of the parts of a block's texts."""
        n = len(buf)
        heads = np.zeros(n + 1, bool)
        heads[bounds] = True
        if self.cut == "blank":
            blank = _BLANK[buf]
            begins = ~blank
            begins[1:] &= blank[:-1] | heads[1:n]
            ends = ~blank
            ends[:-1] &= blank[1:] | heads[1:n]
            s, t = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            begins = heads[:n].copy()
            if self.cut == "space" and n > 2:
                at = np.flatnonzero(buf[1:-1] == 32) + 1
                prev, follow = buf[at - 1], buf[at + 1]
                before2, before3 = buf[at - 2], np.where(at > 2, buf[at - 3], 0)  # at 1, the byte before the text's first is never read as one of it
                ok = ~_BLANK[prev] & ~_BLANK[follow] & ~_MAY_BLANK[follow] & (follow != _MAY_BLANK_2)
                ok &= ~((prev >= 0x80) & ((before2 == _MAY_BLANK_2) | _MAY_BLANK[before3]))
                begins[at[ok & ~heads[at] & ~heads[at + 1]]] = True
            s = np.flatnonzero(begins)
            t = np.append(s[1:], n)
        if self.added:
            raw = buf.tobytes()
            for token in map(str.encode, self.added):
                at = raw.find(token)
                while at >= 0:  # that text whole
                    k = int(np.searchsorted(bounds, at, "right")) - 1
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    if at < b:
                        i, j = np.searchsorted(s, (a, b))
                        s, t = np.concatenate((s[:i], [a], s[j:])), np.concatenate((t[:i], [b], t[j:]))
                    at = raw.find(token, b)
        return s, t

    def column(self, col: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of a column's texts: the ids of all, with end_id behind each
        text if given, and where each text's ids start, and end. Null texts are empty."""
        table = self.table
        for _, buf, bounds in blocks(col):
            if table.full:
                table.clear()
            if len(buf):
                s, t = self._parts(buf, bounds)
                hashes = Hasher(buf, fold=False)(s, t)
                entry = table.find(hashes)
                new = np.flatnonzero(entry == 0)
                if len(new):
                    _, first = np.unique(hashes[new], return_index=True)
                    first, raw, sizes, found = new[np.sort(first)], buf.tobytes(), [], []
                    for a, b in zip(s[first].tolist(), t[first].tolist(), strict=True):
                        text = raw[a:b].decode()
                        spaced = text[0] == " " and self.cut == "space" and b - a > 1 and not text[1].isspace()
                        ids = self._part(text[1:], " ") if spaced else self._part(text)
                        sizes.append(len(ids))
                        found += ids
                    table.add(hashes[first], sizes, found)
                    entry[new] = table.find(hashes[new])
            else:
                s, entry = np.empty(0, np.int64), np.empty(0, np.int32)
            place = np.searchsorted(s, bounds)
            size = table.size[entry]
            if end_id is not None:
                entry, size = np.insert(entry, place[1:], 0), np.insert(size, place[1:], 1)
                place = place + np.arange(len(place))
            stop = np.concatenate(([0], np.cumsum(size)))
            index = np.arange(int(stop[-1])) + np.repeat(table.start[entry] - stop[:-1], size)
            if end_id is not None:
                last = stop[place[1:]] - 1
                index[last] = 0
                ids = table.pool[index]
                ids[last] = end_id
            else:
                ids = table.pool[index]
            yield ids, stop[place]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as bytes."""
        return b"".join(ids.tobytes() for ids, _ in self.column(pa.array([text], pa.string())))


@cache
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
