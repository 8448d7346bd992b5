"""SentencePiece encoding by sampling, and decoding.

The lattice of a text has an edge for every vocabulary piece that occurs in it;
a character that is no piece of its own has one for its bytes. A segmentation's
probability is proportional to the product of its pieces' weights,
(1 + rank)^-alpha. Forward filtering sums the weights of all paths to each
position; backward sampling draws the last piece, then the one before, each by
its share of that sum, so segmentations are drawn exactly by their probability.
Draws come from a hash of the row key, the place in the text and the step: the
same row always gets the same ids, on any machine, in any order.

Where no piece crosses from a letter to a following space mark, the lattice
falls apart at those places, and equal parts share one filtered lattice. The
lattices of all distinct parts of a block of texts are built together: a walk
down the trie of pieces from every character at once, then a filter that goes
from position to position over all parts at once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import lean, ship
from ferngraph.llm.textblocks import U, mix

MARK = "▁"
#: Stands for a MARK in the text; texts that are UTF-8 can't hold it.
_OWN_MARK = "\ud800"
#: Characters filtered and drawn together, long single texts aside.
CHARS = 1 << 20
_PART = re.compile("▁+[^▁]*")
_CHAR = 21  # bits of a code point


class _Trie:
    """Pieces as a trie: child of (node, character) by open addressing."""

    def __init__(self, pieces: dict[str, int]):
        child: dict[int, int] = {}
        at: list[int] = [-1]
        for text, i in pieces.items():
            node = 0
            for c in text:
                key = node << _CHAR | ord(c)
                node = child.setdefault(key, len(at))
                if node == len(at):
                    at.append(-1)
            at[node] = i
        self.piece = np.array(at, np.int32)
        keys, values = np.array(list(child), np.int64), np.array(list(child.values()), np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several, the last stays
            put = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[put]] = values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def children(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by its character; -1 for none."""
        keys = nodes << _CHAR | chars
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        again = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[again]]
            hit = seen == keys[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (seen >= 0)]
        return out


class Pieces:
    """A vocabulary with weights. A piece id of n or more stands for the bytes
    of the character (id - n). A model without a piece for every byte is refused."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        byte = [-1] * 256
        self.out: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                self.out[i] = bytes([int(piece[3:5], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[piece] = i
                self.out[i] = piece.replace(MARK, " ").encode()
        if min(byte) < 0 or not self.ids:
            raise ValueError(f"{path} lacks pieces for some bytes, so it can't encode every text")
        self.byte = np.array(byte, np.int32)
        first = min(self.ids.values())
        self.weight = {i: float(-alpha * np.log(1 + i - first)) for i in self.ids.values()}
        self.log = np.zeros(n)
        self.log[list(self.weight)] = list(self.weight.values())
        self.rare = min(self.weight.values()) - 10 * alpha  # of each byte
        self.longest = max(map(len, self.ids))
        self.trie = _Trie(self.ids)
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", x) for x in self.ids)

    def lattices(self, parts: list[str]) -> _Lattices:
        return _Lattices(self, parts)

    def draw(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each text; keys: a 64-bit seed for each."""
        known: dict[str, int] = {}
        which: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                marked = MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)
                found = _PART.findall(marked) if self.apart else [marked]
                counts[k] = len(found)
                which += [known.setdefault(p, len(known)) for p in found]
        if not which:
            return [np.empty(0, np.int32) for _ in texts]
        grid = self.lattices(list(known))
        at = grid.end[np.array(which, np.int64)]
        place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mix(np.repeat(keys, counts) + place.astype(U) * U(0x9E3779B97F4A7C15))
        live, steps, length = np.arange(len(at)), [], np.zeros(len(at), np.int64)
        while len(live):
            u = (mix(seed[live] + U(len(steps) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> U(11)).astype(float) * 2.0**-53
            edge = grid.drawn(at[live], u)
            steps.append((live, grid.piece[edge]))
            length[live] += 1
            at[live] = grid.source[edge]
            live = live[at[live] > 0]
        stop = np.cumsum(length)
        ids = np.empty(int(stop[-1]), np.int32)
        for k, (which_live, p) in enumerate(steps):
            ids[stop[which_live] - 1 - k] = p
        last = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(counts)))]
        if (ids >= self.n).any():
            ids, last = self._with_bytes(ids, last)
        return [ids[a:b] for a, b in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]

    def _with_bytes(self, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n or more as the byte pieces of their characters."""
        char = np.where(ids >= self.n, ids - self.n, 0)
        char[char == ord(_OWN_MARK)] = ord(MARK)
        size = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        start = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(ids, size)
        for n, lead in enumerate((0, 0xC0, 0xE0, 0xF0), 1):
            of = np.flatnonzero((ids >= self.n) & (size == n))
            for j in range(n):
                bits = char[of] >> 6 * (n - 1 - j)
                out[start[of] + j] = self.byte[bits | lead if j == 0 else bits & 0x3F | 0x80]
        return out, start[last]


class _Lattices:
    """Filtered lattices of distinct parts. Node 0 is every part's start; the
    nodes after position 1, 2, ... of all parts follow, longest parts first.
    end: each part's last node; source, piece, share: of the edges, by the node
    they lead to; off: where each node's edges start."""

    def __init__(self, of: Pieces, parts: list[str]):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-sizes, kind="stable")
        code = np.frombuffer("".join([parts[k] for k in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = sizes[order]
        most, total = int(sizes[0]), len(code)
        part = np.repeat(np.arange(len(parts)), sizes)
        stop = np.cumsum(sizes)[part]
        step = np.arange(total) - (stop - sizes[part])
        longer = len(parts) - np.searchsorted(sizes[::-1], np.arange(1, most + 1), "left")  # parts of so many characters at least
        base = np.concatenate(([0], np.cumsum(longer))) + 1  # the first node after each number of characters, less one
        node = base[step] + part  # after this character
        self.end = np.empty(len(parts), np.int64)
        self.end[order] = base[sizes - 1] + np.arange(len(parts))
        source = np.where(step > 0, np.concatenate(([0], node[:-1])), 0)  # the node before this character

        found = []
        live, down = np.arange(total), np.zeros(total, np.int64)
        for width in range(1, of.longest + 1):
            if width > 1:
                inside = live + width - 1 < stop[live]
                live, down = live[inside], down[inside]
            down = of.trie.children(down, code[live + width - 1])
            keep = down >= 0
            if width == 1:
                alone = keep.copy()
                alone[keep] = of.trie.piece[down[keep]] >= 0
                odd = np.flatnonzero(~alone)
                found.append((node[odd], source[odd], (of.n + code[odd]).astype(np.int32)))
            live, down = live[keep], down[keep]
            if not len(live):
                break
            piece = of.trie.piece[down]
            whole = np.flatnonzero(piece >= 0)
            found.append((node[live[whole] + width - 1], source[live[whole]], piece[whole]))

        n_nodes = total + 1
        count = np.zeros(n_nodes + 1, np.int64)
        for to, _, _ in found:
            count[to + 1] += 1  # a width leads to a node once at most
        self.off = np.cumsum(count)
        fill = self.off[:-1].copy()
        n_edges = int(self.off[-1])
        self.source, self.piece = np.empty(n_edges, np.int64), np.empty(n_edges, np.int32)
        for to, at, piece in found:
            self.source[fill[to]], self.piece[fill[to]] = at, piece
            fill[to] += 1
        char = self.piece - of.n
        char[char == ord(_OWN_MARK)] = ord(MARK)
        weight = np.where(char < 0, of.log[np.minimum(self.piece, of.n - 1)], of.rare * (1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)))

        # forward: the log of the summed weights of all paths to a node
        log = np.zeros(n_nodes)
        cuts = self.off[np.append(base, n_nodes)].tolist()
        for k in range(most):
            a, b, lo, hi = cuts[k], cuts[k + 1], int(base[k]), int(base[k + 1])
            weight[a:b] += log[self.source[a:b]]
            log[lo:hi] = np.logaddexp.reduceat(weight[a:b], self.off[lo:hi] - a)
        # of each node's edges, the cumulated shares of that sum
        share = np.exp(weight - np.repeat(log[1:], count[2:]))
        run = np.cumsum(share)
        run -= np.repeat(np.concatenate(([0.0], run))[self.off[1:-1]], count[2:])
        run[self.off[2:] - 1] = 1.0
        self.share = run

    def drawn(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge into each node that u, from 0 to below 1, falls on."""
        edge = self.off[nodes]
        past = np.flatnonzero(self.share[edge] <= u)
        while len(past):
            edge[past] += 1
            past = past[self.share[edge[past]] <= u[past]]
        return edge


@cache
def pieces(path: str, alpha: float) -> Pieces:
    """One per worker process, file and alpha."""
    return Pieces(path, alpha)


def row_keys(keys: list, seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "little") for k in keys], U)


def decoded(model: Pieces, ids: np.ndarray) -> bytes:
    """UTF-8 of ids: bytes joined, marks as spaces, less the first space."""
    return b"".join(map(model.out.__getitem__, ids.tolist()))[1:]


def decode(model: Pieces, ids: np.ndarray) -> str:
    """The text of ids; bytes that aren't UTF-8, from ids of no encoding, become U+FFFD."""
    return decoded(model, ids).decode("utf-8", "replace")


def _batched(texts: list[str]) -> Iterator[slice]:
    a, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= CHARS:
            yield slice(a, k + 1)
            a, chars = k + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def _encoded(path: str, alpha: float, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, alpha)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = row_keys(batch.column(0).to_pylist(), seed)
            n, crc, same, raw = [], [], [], []
            for part in _batched(texts):
                for text, ids in zip(texts[part], model.draw(texts[part], keys[part]), strict=True):
                    wide = ids.astype("<u4").tobytes()
                    n.append(len(ids))
                    crc.append(zlib.crc32(wide))
                    same.append(decoded(model, ids) == text.encode())
                    raw.append(wide if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(raw, pa.binary())], ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"])

    return run


def sample_pieces(docs: DataFrame, model_path: str, alpha: float = 1.0, seed: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit
    integers), lossless (decoding the ids gave the text), ids (those bytes, if
    asked for), of every row.

    Null and empty texts have no piece. The row key is doc_id: rows of equal
    doc_id and text get equal ids, a null doc_id is a key like any other. Space
    marks of the text itself, and characters that the model lacks, become bytes.
    Texts of any length are one lattice, or one for each of their parts. An
    empty table gives an empty result. Other columns are not read. A model that
    lacks byte pieces is refused.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lean(_encoded(model_path, alpha, seed, with_ids)), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean, ids binary")
    return out if with_ids else out.drop("ids")
