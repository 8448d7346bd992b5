"""SimHash near-dedup by a byte-position inverted index with count filtering.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes
of its word shingles, repeats included. Fingerprints link when at most 3 bits
differ. Those bits lie in at most 3 of the 8 bytes, so linked fingerprints share
at least 5 positional bytes (the same byte at the same position): that is the
guaranteed count.

The index posts every distinct fingerprint under its positional bytes. A list of
one byte holds a 256th of all fingerprints, so lists are read three at a time:
5 shared bytes of 8 put at least 3 into one half of the positions, hence the
pair meets in a list that is the intersection of three lists of one half, of
which there are 4 for each half. There the shared positional bytes of a pair are
tallied over all positions; pairs that reach the guaranteed count are verified
on their bits. Lists that are still long are intersected with two more lists (2
of the 5 other positions are shared as well), and if that isn't enough, cut into
blocks that meet each other.

No list gives all its pairs: within a list, links are walked from fingerprint to
fingerprint, and each that is found is compared with those still unseen only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import discard, lean, small, workdir, written
from ferngraph.llm.components import components
from ferngraph.llm.textblocks import segments

#: Bits that may differ, and positional bytes that a linked pair shares at least.
BITS, BYTES = 3, 8
SHARED = BYTES - BITS
#: The three positions of a list, by half.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints of a list that one task compares with each other.
LONG_LIST = 4096
#: Lists up to this length are compared side by side, longer ones walked.
SHORT = 8
U = np.uint64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text; 0 if it has no words. A long text is
    read in segments, so that memory doesn't grow with its words."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    parts = [text] if len(text) <= 1 << 19 else (s.tobytes() for s in segments(np.frombuffer(text, np.uint8)))
    digest = xxhash.xxh64_intdigest
    for part in parts:
        words = held + part.lower().split()  # of bytes: A-Z, and white space 0x20 and 0x09-0x0D
        if len(words) >= width:
            hashes = np.array([digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)), strict=False)], U)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
            words = words[len(words) - width + 1 :]
        held = words
    if not n:
        return digest(b" ".join(held), seed) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), width) if t.is_valid else 0 for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, U).view(np.int64))], ["doc_id", "fp"])

    return run


def tally(differ: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs share, by the bits in which they differ."""
    return (differ.reshape(-1, 1).view(np.uint8) == 0).sum(1)


def linked(differ: np.ndarray) -> np.ndarray:
    """Pairs that reach the guaranteed count, verified on their bits."""
    ok = tally(differ) >= SHARED
    ok[ok] = np.bitwise_count(differ[ok]) <= BITS
    return ok


def walk(fp: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places in fp) that connect whatever links of this list connect; if
    sides are given, links between different sides only."""
    out: list[tuple[int, int]] = []
    unseen = np.arange(len(fp))
    while len(unseen):
        todo, unseen = [int(unseen[0])], unseen[1:]
        while todo and len(unseen):
            i = todo.pop()
            ok = linked(fp[unseen] ^ fp[i])
            if side is not None:
                ok &= side[unseen] != side[i]
            near = unseen[ok].tolist()
            out += [(i, j) for j in near]
            todo += near
            unseen = unseen[~ok]
    return out


def _links(by: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by list (columns `by`), then side, with rep and fp."""
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = [np.asarray(batch.column(c).to_numpy()) for c in (*by, "rep", "fp", "side")]
                if held is not None:
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                if not len(rows[0]):
                    continue
            elif held is None:
                return
            else:
                rows = held
            new = np.ones(len(rows[0]), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in rows[: len(by)]], axis=0)
            starts = np.flatnonzero(new)
            whole = int(starts[-1]) if batch is not None else len(rows[0])  # the last list may go on
            held = [x[whole:] for x in rows]
            rep, fp, side = (x[:whole] for x in rows[len(by) :])
            starts = np.append(starts[starts < whole], whole)
            size = np.diff(starts)
            a, b = _side_by_side(fp.view(U), side, starts, size)
            found = [np.stack((a, b), 1)]
            for k in np.flatnonzero(size > SHORT):
                s, e = starts[k], starts[k + 1]
                pairs = walk(fp[s:e].view(U), side[s:e] if side[s] != side[e - 1] else None)
                if pairs:
                    found.append(np.array(pairs) + s)
            pairs = np.concatenate(found)
            x, y = rep[pairs[:, 0]], rep[pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _side_by_side(fp: np.ndarray, side: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within short lists: each fingerprint with the 1st, 2nd, ... after it."""
    own = np.repeat(np.where(size <= SHORT, starts[1:], 0), size)  # the end of each row's list, if short
    mixed = np.repeat(side[starts[:-1]] != side[starts[1:] - 1], size)
    at = np.arange(len(fp))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, SHORT):
        i = at[at + k < own]
        if not len(i):
            break
        ok = linked(fp[i] ^ fp[i + k]) & ~(mixed[i] & (side[i] == side[i + k]))
        a.append(i[ok])
        b.append(i[ok] + k)
    return np.concatenate(a), np.concatenate(b)


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _list(positions) -> F.Column:
    """The positional bytes of a list as one number, and which positions they are."""
    key = F.lit(sum(1 << p for p in positions)).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def links(classes: DataFrame, work: str) -> DataFrame:
    """Links (a, b) between classes (rep, fp) of distinct fingerprints that
    connect all that link, each pair once."""
    lists = classes.select("rep", "fp", F.explode(F.array(*map(_list, TRIPLES))).alias("list"))
    sizes = written(lists.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > LONG_LIST), f"{work}/long")
    n_long = sizes.count()
    marked = lists.join(small(sizes, n_long), "list", "left")
    no = F.lit(0).cast("long")
    by = ["list", "one", "two"]
    rows = marked.where("n is null").select("list", no.alias("one"), no.alias("two"), "rep", "fp", no.alias("side"))
    if n_long:
        rest = marked.where("n is not null")
        # two more positions of those that the list doesn't have; the list names its own positions in its upper bits
        pairs = [p for p in combinations(range(BYTES), 2)]
        has = lambda p: F.shiftrightunsigned("list", 24).bitwiseAND(F.lit(sum(1 << x for x in p))) != 0
        finer = F.array_compact(F.array(*[F.when(~has(p), F.struct(F.lit(k).alias("pair"), F.shiftleft(_byte(p[0]), 8).bitwiseOR(_byte(p[1])).alias("bytes"))) for k, p in enumerate(pairs)]))
        rest = rest.select("rep", "fp", "list", F.explode(finer).alias("f")).select("rep", "fp", F.xxhash64("list", "f.pair", "f.bytes").alias("list"))
        rest = written(rest, f"{work}/finer")
        sizes = rest.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > LONG_LIST).select("list", F.ceil(2 * F.col("n") / LONG_LIST).alias("ways"))
        sizes = written(sizes, f"{work}/longer")
        rest = rest.join(small(sizes, sizes.count()), "list", "left").withColumn("ways", F.coalesce("ways", F.lit(1).cast("long")))
        rest = rest.withColumn("side", F.pmod(F.xxhash64("rep"), "ways"))
        rest = rest.withColumn("other", F.explode(F.sequence(no, F.col("ways") - 1)))
        rows = rows.unionByName(rest.select("list", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "rep", "fp", "side"))
    found = rows.repartition(*by).sortWithinPartitions(*by, "side", "fp").mapInArrow(lean(_links(by)), "a long, b long")
    return found.distinct()


def simhash(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over links.

    Texts without words, null ones too, have fingerprint zero and link like any
    other; of fewer words than `width`, the whole sequence is the one shingle.
    Rows that repeat a doc_id keep their own fingerprints and are linked through
    it. Rows without doc_id are left out. Other columns are not read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    work = workdir(spark, "simhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    fps = written(docs.mapInArrow(lean(_fingerprints(width)), "doc_id long, fp long"), f"{work}/fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), f"{work}/classes")
    found = written(links(classes.select("rep", "fp"), work), f"{work}/links")
    # copies, and documents of a repeated id: a doc_id is linked to the first of its fingerprint
    shared = classes.where("n > 1").select("fp", "rep")
    again = fps.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    same = fps.join(small(shared, shared.count()), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    odd = fps.join(again, "doc_id").join(classes.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = f"{work}/parts"
    known = written(components(found.unionByName(same).unionByName(odd), parts).withColumnRenamed("id", "doc_id"), f"{work}/components")
    discard(spark, parts)
    out = fps.join(small(known, known.count()), "doc_id", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))
