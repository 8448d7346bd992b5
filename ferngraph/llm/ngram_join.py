"""N-gram Jaccard join by parity sketches.

Every text is a set of hashed word shingles. A parity sketch starts as zeros
and every element flips the bit its hash names, so two sketches differ in at
most as many bits as the sets' symmetric difference has elements. Two forms are
used:

* A wide sketch, addressed by the whole 64-bit hash and cut into m blocks of
  equal address ranges. A block is kept as the XOR of one mixed word per set
  bit. Sets at Jaccard t or more with a and b elements differ in at most
  d = (1-t)/(1+t) * (a+b) elements, so at most d blocks differ: among each
  set's d+1 fullest blocks (an order of block contents, hence the same for all
  sets) at least one is common. Those blocks are the join keys, per size band
  [2^k, 2^(k+1)) of the larger set. Where a set has no more than d blocks that
  aren't empty, both sets of a pair that could be missed are such sets, and
  these also get their d+1 smallest hashes as keys.
* A folded sketch of PER_ELEMENT bits per element or more: candidates whose
  folded sketches differ in more than d bits are no links.

What remains is verified on the texts, so the result is exact up to 64-bit
hash collisions. Groups of copies are never expanded into all pairs. Equal sets
meet by an aggregate, and one of them stands for all. By the few leading keys of
each band, every set then meets one earlier set, which connects nearly all of
a group of near copies. All keys are only asked, by an aggregate, whether they
hold sets of several components; under the keys that do, pairs of different
components that pass the folded sketch are verified: of each component the
nearest one, then, of what is still apart, all that are left. Large buckets are cut into blocks of BUCKET sets,
those of a large component by themselves, and blocks of one component never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import discard, lean, small, workdir, written
from ferngraph.llm.components import components
from ferngraph.llm.textblocks import U, mix, shingle_sets

#: Sets of a bucket that one task tests against each other or another block.
BUCKET = 256
#: Rows of a leading key that meet in one task; more are dealt out by hash.
HOT = 1024
#: Bits per element of the folded sketch, and leading keys of a band.
PER_ELEMENT, LEADING = 2, 4
#: Smallest keys of each set by which a pair is recognised that meets twice.
FIRSTS = 8
_K = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], U)


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of a and b elements."""
    return (100 - percent) * (a + b) // (100 + percent)


def sketch_keys(u: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a set of sorted distinct hashes: the leading ones, and all."""
    n = len(u)
    most = 100 * n // percent
    if most_apart(n, most, percent) == 0:
        return np.empty(0, U), np.empty(0, U)  # it links with equal sets only
    keys, leading = [], []
    for k in range(n.bit_length() - 1, most.bit_length()):  # the bands of the larger sets it may link with
        low = 1 << k
        d = most_apart(n, min(most, 2 * low - 1), percent)
        if d == 0:
            continue
        band = U(low * int(_K[2]) & 0xFFFFFFFFFFFFFFFF)
        m = max(2, 5 * most_apart(low, 100 * low // percent, percent) // 2)
        block = ((u >> U(32)) * U(m)) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        content = np.bitwise_xor.reduceat(mix(u ^ _K[0]), starts)
        count = np.diff(starts, append=n)
        key = mix(content + block[starts] * _K[1] + band)
        key = key[np.lexsort((key, -count))[: d + 1]]
        leading.append(key[:LEADING])
        if len(starts) <= d:
            keys.append(mix((u[: d + 1] ^ _K[3]) + band))
        keys.append(key)
    return (np.concatenate(leading), np.concatenate(keys)) if keys else (np.empty(0, U), np.empty(0, U))


def folded_sketch(u: np.ndarray, per_element: int) -> bytes:
    """Parity of the elements at each of 64 or more bits, so many per element."""
    width = max(64, per_element << (len(u) - 1).bit_length())
    return np.packbits((np.bincount((u & U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


SETS = "doc_id long, n long, h1 long, h2 long, sketch binary, lead array<long>, keys array<long>"


def _lists(parts: list[np.ndarray], count: np.ndarray) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(flat))


def _sketches(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            size = np.zeros(len(ids), np.int64)
            h = np.zeros((2, len(ids)), U)
            first: dict[tuple[int, int, int], int] = {}  # of each distinct set, the row of the smallest doc_id: it has the keys
            made: dict[tuple[int, int, int], tuple] = {}
            doc = ids.to_numpy()
            for i, u in shingle_sets(batch.column(1), width):
                size[i] = n = len(u)
                if not n:
                    continue
                h[0, i], h[1, i] = u.sum(dtype=U), np.bitwise_xor.reduce(mix(u ^ _K[1]))
                one = (n, int(h[0, i]), int(h[1, i]))
                if one not in first:
                    lists = sketch_keys(u, percent)
                    made[one] = (folded_sketch(u, PER_ELEMENT) if len(lists[1]) else b"", *lists)
                if one not in first or doc[i] < doc[first[one]]:
                    first[one] = i
            rows = [(i, made[one]) for i, one in sorted((i, one) for one, i in first.items())]
            sketch: list[bytes] = [b""] * len(ids)
            count = np.zeros((2, len(ids)), np.int64)
            for i, (folded, lead, keys) in rows:
                sketch[i], count[0, i], count[1, i] = folded, len(lead), len(keys)
            each = [[x[k] for _, x in rows] for k in (1, 2)]
            cols = [ids, pa.array(size), *(pa.array(x.view(np.int64)) for x in h), pa.array(sketch, pa.binary()), *map(_lists, each, count)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SETS.split(", ")])

    return run


def _met(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, salt, n, doc_id) in that order: each row with the first of
        its run of like sizes, BUCKET rows at most, and with the row before."""
        held = None  # key, salt, n, doc_id, rank and run's first doc_id of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, n, doc = (batch.column(k).to_numpy() for k in range(4))
            if held is not None:
                key, salt, n, doc = (np.concatenate(([h], x)) for h, x in zip(held, (key, salt, n, doc)))
            same = np.concatenate(([False], (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])))
            idx = np.arange(len(key))
            rank = idx - np.maximum.accumulate(np.where(same, 0, idx))
            if held is not None:
                rank[: len(key) if same[1:].all() else 1 + int(np.argmin(same[1:]))] += held[4]
            goes_on = same & np.concatenate(([False], 100 * n[:-1] >= percent * n[1:])) & (rank % BUCKET != 0)
            start = np.maximum.accumulate(np.where(goes_on, 0, idx))
            first, before = doc[start], np.concatenate((doc[:1], doc[:-1]))
            if held is not None:
                first[start == 0] = held[5]
            held = tuple(int(x[-1]) for x in (key, salt, n, doc, rank, first))
            of = np.flatnonzero(goes_on)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((doc[of], doc[of]))), pa.array(np.concatenate((first[of], before[of])))], ["a", "b"])

    return run


class _Rows:
    """Rows of a bucket table as arrays, with the narrow sketches as one buffer."""

    def __init__(self, table: pa.Table, percent: int):
        table = table.combine_chunks()
        self.doc, self.n, self.percent = table["doc_id"].to_numpy(), table["n"].to_numpy(), percent
        col = table["sketch"].combine_chunks() if isinstance(table["sketch"], pa.ChunkedArray) else table["sketch"]
        col = col.cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        self.at, self.width = off[:-1], np.diff(off)
        self.buf = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the pairs' sizes and narrow sketches allow a link, and in
        how many bits the sketches differ."""
        p = self.percent
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (100 * small >= p * large) & (self.doc[i] != self.doc[j])
        most = (100 - p) * (small + large) // (100 + p)
        w = np.minimum(self.width[i], self.width[j])
        bits = np.zeros(len(i), np.int64)
        for width in np.unique(w[ok]):
            of = np.flatnonzero(ok & (w == width))
            step = max(1, (1 << 22) // max(1, int(width)))
            for k in range(0, len(of), step):
                part = of[k : k + step]
                bits[part] = np.bitwise_count(self._take(i[part], width) ^ self._take(j[part], width)).sum(1, dtype=np.int64)
                ok[part] = bits[part] <= most[part]
        return ok, bits

    def _take(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Sketches of these rows, folded to width bytes."""
        out = self.buf[self.at[rows][:, None] + np.arange(width)]
        wide = self.width[rows] > width
        for k in range(1, int(self.width[rows].max(initial=width)) // max(1, int(width))):
            more = wide & (self.width[rows] > k * width)
            out[more] ^= self.buf[self.at[rows[more]][:, None] + k * width + np.arange(width)]
        return out


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by these columns, many to a table."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        change = np.zeros(batch.num_rows, bool)
        for c, name in zip(cols, by, strict=True):
            change[1:] |= c[1:] != c[:-1]
            change[0] |= bool(held) and held[-1].column(name)[-1].as_py() != c[0]
        cut = np.flatnonzero(change)
        if len(cut) and (held or cut[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))])
            held, rows = [], 0
            batch = batch.slice(int(cut[-1]))
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in by:
        x = table[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _near_pairs(percent: int, nearest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a bucket, or of two blocks of it, that aren't connected and
        whose sketches allow a link, with the bits in which those differ: of
        each component (x) the nearest, or all of them (x is 0), but none that
        certainly meets again under a smaller key."""
        by = ["key", "one", "two"]
        for table in _groups(batches, by):
            rows, starts = _Rows(table, percent), _starts(table, by)
            key, label, block = (table[c].to_numpy() for c in ("key", "label", "mine"))
            one, two = table["one"].to_numpy(), table["two"].to_numpy()
            firsts = None if nearest else np.stack([table[f"k{k}"].to_numpy() for k in range(FIRSTS)], 1)
            found = []
            for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                if label[s:e].min() == label[s:e].max():
                    continue
                i, j = np.triu_indices(e - s, 1)
                i, j = i + s, j + s
                ok = label[i] != label[j]
                if one[s] != two[s]:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                ok, bits = rows.may_link(i, j)
                i, j, bits = i[ok], j[ok], bits[ok]
                if not nearest:
                    new = ~((firsts[i][:, :, None] == firsts[j][:, None, :]) & (firsts[i] < key[s])[:, :, None]).any((1, 2))
                    i, j, bits = i[new], j[new], bits[new]
                found.append((i, j, bits))
            i, j, bits = map(np.concatenate, zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
            x, y = rows.doc[i], rows.doc[j]
            x, y, of = np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64)
            if nearest:
                of, x, y, bits = np.concatenate((label[i], label[j])), np.tile(x, 2), np.tile(y, 2), np.tile(bits, 2)
                order = np.lexsort((y, x, bits, of))
                order = order[np.concatenate(([True], np.diff(of[order]) != 0))[: len(order)]]
                of, x, y, bits = of[order], x[order], y[order], bits[order]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (of, bits, x, y)], ["x", "bits", "a", "b"])

    return run


def _verified(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by pair: the pairs of which a text of one end links with
        a text of the other."""
        for table in _groups(batches, ["a", "b"]):
            table = table.combine_chunks()
            sets = [u for part in table["text"].chunks for _, u in shingle_sets(part, width)]
            a, b, own = (table[c].to_numpy() for c in ("a", "b", "doc_id"))
            starts = _starts(table, ["a", "b"])
            good = []
            for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                left, right = [sets[k] for k in range(s, e) if own[k] == a[s]], [sets[k] for k in range(s, e) if own[k] == b[s]]
                if any(_linked(x, y, percent) for x in left for y in right):
                    good.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b), written in a table, whose texts
    link. Reads the texts once, and moves only those of the pairs' ends."""
    ends = small(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id")), 2 * pairs.count())
    rows = docs.join(ends, "doc_id").select("a", "b", "doc_id", "text")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "doc_id").mapInArrow(lean(_verified(width, percent)), "a long, b long")


def _neighbours(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b): each set with the one that it meets most often
    under its leading keys. Keys of many rows are dealt out to several tasks,
    each key's rows in its own way."""
    lead = sets.select(F.explode("lead").alias("key"), "n", "doc_id")
    hot = lead.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT).select("key", F.ceil(F.col("rows") / HOT).alias("ways"))
    lead = lead.join(small(hot, hot.count()), "key", "left")
    lead = lead.select("key", F.coalesce(F.pmod(F.xxhash64("key", "doc_id"), "ways"), F.lit(0)).alias("salt"), "n", "doc_id")
    met = lead.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "doc_id").mapInArrow(lean(_met(percent)), "a long, b long")
    met = met.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    best = met.groupBy("a").agg(F.max(F.struct("n", -F.col("b"))).alias("m")).select("a", (-F.col("m.col2")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, c, doc_id, n, label) of buckets, c rows each, once for every
    pair of blocks that their own belongs to; mine names that block. Of a large
    bucket, labels of BUCKET rows or more have blocks of their own, which don't meet each other."""
    no = F.lit(0).cast("long")
    few = rows.where(F.col("c") <= BUCKET).select("key", no.alias("one"), no.alias("two"), no.alias("mine"), "doc_id", "n", "label")
    many = rows.where(F.col("c") > BUCKET)
    owners = many.groupBy("key", "label").agg(F.count("*").alias("c")).withColumn("owner", F.when(F.col("c") >= BUCKET, F.col("label")))
    layout = owners.groupBy("key", "owner").agg(F.ceil(F.sum("c") / BUCKET).alias("ways")).groupBy("key").agg(F.collect_list(F.struct("owner", "ways")).alias("layout"))
    code = lambda owner, k: F.xxhash64(F.coalesce(owner, F.lit(-1)), owner.isNull(), k.cast("long"))
    many = many.join(layout, "key").withColumn("owner", F.when(F.exists("layout", lambda x: x["owner"] == F.col("label")), F.col("label")))
    ways = F.get(F.filter("layout", lambda x: x["owner"].eqNullSafe(F.col("owner"))), F.lit(0))["ways"]
    many = many.withColumn("mine", code(F.col("owner"), F.pmod(F.xxhash64("doc_id"), ways)))
    met = F.filter("layout", lambda x: x["owner"].isNull() | ~x["owner"].eqNullSafe(F.col("owner")))
    other = F.flatten(F.transform(met, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["ways"] - 1), lambda k: code(x["owner"], k))))
    many = many.withColumn("other", F.explode(other))
    many = many.select("key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "doc_id", "n", "label")
    return few.unionByName(many)


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its shingle set) and
    component_id, the smallest doc_id reachable over links. Two documents link
    when 100 * shared shingles >= percent * shingles of either.

    Null and empty texts, and texts of white space, have no shingle and no
    link. Rows that repeat a doc_id are one document: it links if any of its
    texts does, and n_shingles is that of its largest set. Rows without doc_id
    are left out. Columns besides the two named are not read; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    work = workdir(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sets = written(docs.mapInArrow(lean(_sketches(width, percent)), SETS), f"{work}/sets")

    same = ["n", "h1", "h2"]
    classes = sets.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("b"), F.count("*").alias("copies")).where("copies > 1")
    classes = written(classes, f"{work}/classes")
    copies = sets.select("doc_id", *same).join(small(classes, classes.count()), same).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    copies = written(copies, f"{work}/copies")

    # a doc_id that repeats may be a copy by one of its texts only, so it keeps its keys
    again = sets.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    spare = copies.select(F.col("a").alias("doc_id")).distinct().join(again, "doc_id", "left_anti")
    keyed = sets.where(F.size("keys") > 0).join(small(spare, copies.count()), "doc_id", "left_anti")

    tests = written(_neighbours(keyed.select("doc_id", "n", "lead"), percent), f"{work}/tests-0")
    links = verify(docs, tests, width, percent)
    found = written(components(copies.unionByName(links), f"{work}/parts-0"), f"{work}/found-0")
    discard(spark, f"{work}/parts-0")

    # pairs under keys that hold several components: of each component the nearest other one, then all that are left
    sketches, by, done = sets.where(F.size("keys") > 0).select("doc_id", F.col("n").alias("n2"), "sketch"), ["key", "one", "two"], tests
    rows = keyed.select("doc_id", "n", "keys")
    for k, nearest in ((1, True), (2, False)):
        known = found.select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
        rows = rows.join(small(known, found.count()), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        if "keys" in rows.columns:
            rows = rows.select(F.explode("keys").alias("key"), "doc_id", "n", "label")
        mixed = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where("x < y").select("key", "c")
        mixed = written(mixed, f"{work}/mixed-{k}")
        rows = written(rows.join(small(mixed, mixed.count()), "key"), f"{work}/rows-{k}")
        blocks = _blocks(rows).join(sketches, "doc_id").where("n = n2").drop("n2")
        if not nearest:
            least = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("key")).alias("ks"))
            none = F.lit((1 << 63) - 1)  # smaller than no key
            blocks = blocks.join(least.select("doc_id", *[F.coalesce(F.get("ks", F.lit(i)), none).alias(f"k{i}") for i in range(FIRSTS)]), "doc_id")
        near = blocks.repartition(*by).sortWithinPartitions(*by, "doc_id").mapInArrow(lean(_near_pairs(percent, nearest)), "x long, bits long, a long, b long")
        near = near.groupBy("x").agg(F.min(F.struct("bits", "a", "b")).alias("m")).select("m.a", "m.b") if nearest else near.select("a", "b")
        tests = written(near.distinct().join(small(done, done.count()), ["a", "b"], "left_anti"), f"{work}/tests-{k}")
        done = done.unionByName(tests)
        more = verify(docs, tests, width, percent)
        edges = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        found = written(components(edges, f"{work}/parts-{k}"), f"{work}/found-{k}")
        discard(spark, f"{work}/parts-{k}", f"{work}/mixed-{k}")
        rows = rows.select("key", "doc_id", "n")

    out = sets.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    return out.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
q AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT y, root FROM q JOIN links ON x = id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CAST(min(root) AS BIGINT) AS component_id
FROM w JOIN q ON q.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY 1, 2
"""
