"""Vector codes: product quantisation trained with annular norm pruning.

A vector of integers is cut into equal parts, and every part position has a
codebook of ENTRIES entries. A part's nearest entry is found by norms: entries
are sorted by norm once a round; the entries nearest in norm give a first best
distance d; only entries whose norm is within d of the part's own can be as near
(the triangle inequality), and these are an interval of the sorted entries, found
by binary search. Exactly that annulus, both ends included, is evaluated in
integers. Bounds are widened by a rounding slack, so that no tie is lost.

The codebooks are a model of fixed size (parts x entries) and travel with the
tasks. A round sums up the parts of each entry within every task; the partial
sums meet by an aggregate on (part, entry, position).
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import lean, small, workdir, written
from ferngraph.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries, nearest in norm, that give the first best distance.
PROBE = 16
#: Rows whose annuli are evaluated together.
ROWS = 64
#: Larger components are cut to this, so that sums over all rows fit two decimals.
LARGEST = float(1 << 140)
_LIMB = 64
_LONG = (1 << 63) - 1


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        """entries: rows of integers, as objects where doubles can't hold their products."""
        self.entries = entries
        square = (entries * entries).sum(1)
        self.order = np.lexsort((np.arange(len(entries)), square.astype(float)))
        self.sorted, self.square = entries[self.order], square[self.order]
        self.norm = np.sqrt(self.square.astype(float))
        self.evaluated = 0

    def _distances(self, x: np.ndarray, square: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Exact squared distances of rows to the entries lo..hi - 1 in order of norm."""
        self.evaluated += len(x) * (hi - lo)
        return square[:, None] - 2 * (x @ self.sorted[lo:hi].T) + self.square[lo:hi]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, ties to the lower, and the exact
        squared distance."""
        n, k = len(x), len(self.norm)
        code, error = np.zeros(n, np.int64), np.zeros(n, x.dtype)
        square = (x * x).sum(1)
        norm = np.sqrt(square.astype(float))
        by_norm = np.argsort(norm, kind="stable")
        slack = 1e-9 * (norm + float(self.norm.max(initial=0.0))) + 1e-9
        for at in range(0, n, ROWS):
            rows = by_norm[at : at + ROWS]
            part, own, r = x[rows], square[rows], norm[rows]
            middle = int(np.searchsorted(self.norm, r[len(r) // 2]))
            first = max(0, min(middle - PROBE // 2, k - PROBE))
            best = self._distances(part, own, first, min(k, first + PROBE)).min(1)
            reach = np.sqrt(best.astype(float)) * (1 + 1e-9) + slack[rows]
            lo, hi = np.searchsorted(self.norm, r - reach, "left"), np.searchsorted(self.norm, r + reach, "right")
            low, high = int(lo.min()), int(hi.max())
            d = self._distances(part, own, low, high)
            at_entry = np.arange(low, high)
            inside = (at_entry >= lo[:, None]) & (at_entry < hi[:, None])
            best = np.minimum(best, np.where(inside, d, best[:, None]).min(1))
            tied = inside & (d == best[:, None])
            code[rows], error[rows] = np.where(tied, self.order[low:high], k).min(1), best
        return code, error


def _numbers(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whole doubles and codebooks as doubles if all distances are exact in
    them, else as Python's integers."""
    most = max([float(np.abs(x).max(initial=0.0)), *(float(max(map(abs, b.ravel()), default=0)) for b in books)])
    if 4.0 * most * most * max(1, x.shape[1] // max(1, len(books))) < float(1 << 52):
        return x, [b.astype(float) for b in books]
    return np.array([[int(v) for v in r] for r in x], object).reshape(x.shape), [b.astype(object) for b in books]


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


PARTIAL = "part int, entry int, at int, high decimal(38,0), low decimal(38,0), n long"


def _sums(books: list[np.ndarray]):
    """Of every part and entry the sum of its parts, position by position, over
    one task's rows."""
    parts, (k, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            x, own = _numbers(matrix(pa.chunked_array([batch.column(0)]), batch.num_rows), books)
            for p, (cols, book) in enumerate(zip(_parts(x, parts), own, strict=True)):
                code, _ = Codebook(book).nearest(cols)
                count[p] += np.bincount(code, minlength=k)
                if cols.dtype == object:
                    np.add.at(total[p], code, cols)
                else:
                    for d in range(width):
                        total[p, :, d] += np.bincount(code, cols[:, d], k).astype(np.int64)
        p, e = np.nonzero(count)
        values = [int(v) for v in total[p, e].ravel()]
        whole = lambda rows: pa.array([decimal.Decimal(v) for v in rows], pa.decimal128(38, 0))
        each = lambda rows: pa.array(np.repeat(rows, width).astype(np.int32))
        cols = [each(p), each(e), pa.array(np.tile(np.arange(width), len(p)).astype(np.int32)), whole(v >> _LIMB for v in values), whole(v & ((1 << _LIMB) - 1) for v in values), pa.array(np.repeat(count[p, e], width))]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PARTIAL.split(", ")])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _numbers(matrix(pa.chunked_array([batch.column(2)]), batch.num_rows), books)
            codes, errors = np.empty((batch.num_rows, len(books)), np.uint16), np.zeros(batch.num_rows, object)
            for p, (cols, book) in enumerate(zip(_parts(x, len(books)), own, strict=True)):
                codes[:, p], error = Codebook(book).nearest(cols)
                errors += error.astype(object) if error.dtype == object else error.astype(np.int64).astype(object)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([min(_LONG, int(e)) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (entries x width, Python's integers) of a table (vec_id, v) of
    whole doubles of one length."""
    seeds = [[int(x) for x in r.v] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = [np.array(b, object) for b in _parts(np.array(seeds, object), parts)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(lean(_sums(books)), PARTIAL).groupBy("part", "entry", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # parts x entries x width numbers at most, however many rows
            books[r.part][r.entry, r["at"]] = ((int(r.high) << _LIMB) + int(r.low)) // r.n
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def whole_vectors(table: DataFrame, scale: float, parts: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of vectors of finite components, of
    the most usual length that the parts divide (the smaller, if two are as usual)."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(f"v is not null and size(v) > 0 and size(v) % {parts} = 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    cut = lambda x: F.greatest(F.least(x * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    return rows.where(F.size("v") == (usual[0]["dim"] if usual else 0)).withColumn("v", F.transform("v", lambda x: whole(cut(x))))


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row per vector: vec_id, label, code (an entry of each part's
    codebook, two hex digits each), error (squared distance to those entries),
    label_error (error summed over equal labels, nulls together),
    codebooks_sha256.

    Codebooks start as the parts of the smallest vec_ids. Null vectors, vectors
    with null or non-finite components and vectors of an unusual length, or one
    that the parts don't divide, take no part; rows without id do, and come last
    as seeds. Rows that repeat an id are coded each, as seeds by their vectors.
    Fewer rows than entries make smaller codebooks, equal entries stay (the first
    of them is used), an empty table gives an empty result. Errors beyond a long
    are cut to it. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    spark = table.sparkSession
    rows = written(whole_vectors(table, scale, parts, id_col, vector_col, label_col), f"{workdir(spark, 'vector-codes')}/vectors")
    kind = rows.schema["label"].dataType.simpleString()
    if rows.isEmpty():
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = train(rows, parts, entries, rounds)
    coded = rows.select("vec_id", "label", "v").mapInArrow(lean(_codes(books)), f"vec_id long, label {kind}, code string, error long")
    coded = written(coded, f"{workdir(spark, 'vector-codes')}/codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = small(by_label, by_label.count())
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Every round as a block of common table expressions."""
    blocks = [
        """v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS (SELECT r, p, e[1 + p * (len(e) // 4):(p + 1) * (len(e) // 4)] AS s FROM v, range(4) t(p))",
        "b0 AS (SELECT p, r - 1 AS k, s AS c FROM x WHERE r <= 256)",
    ]
    for t in range(ROUNDS + 1):
        blocks.append(f"a{t} AS (SELECT r, p, min({{'d': d, 'k': k}}) AS m FROM (SELECT r, x.p, k, CAST(list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN b{t} b ON b.p = x.p) GROUP BY r, p)")
        if t < ROUNDS:
            blocks.append(f"""n{t} AS (SELECT p, k, list(q ORDER BY i) AS c FROM (SELECT a.p, a.m.k AS k, i, CAST(floor(sum(s[i])::DOUBLE / count(*)) AS BIGINT) AS q FROM a{t} a JOIN x ON x.r = a.r AND x.p = a.p, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{t + 1} AS (SELECT p, k, coalesce(n.c, b.c) AS c FROM b{t} b LEFT JOIN n{t} n USING (p, k))""")
    blocks.append(f"o AS (SELECT r, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    blocks.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"WITH {', '.join(blocks)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"


ORACLE = _oracle()
