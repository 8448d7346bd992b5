"""Exact top-k by inner product over vector-approximation files.

Vectors become integers, floor(scale * x). Each component is quantised to one
of 32 cells, cut at quantiles of a bounded sample; a vector's approximation is
its cell numbers, one byte each. Queries first scan the approximations alone, in
blocks: the corners of a vector's cell bound its score from both sides, and the
k-th largest lower bound of any block holds for all of them. Only vectors that
some query can't rule out by then are read, and each query reads its own in the
order of their upper bounds, best first, until the next bound is below the k-th
exact score. Blocks' lists are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import discard, lean, workdir, written
from ferngraph.llm.vectors import best, in_blocks, matrix, usable

CELLS, SAMPLE_ROWS = 32, 4096
#: Exact vectors read at a time.
STEP = 64


def cell_edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Per component, ascending integers: cell c holds edges[c] to
    edges[c + 1] - 1; the first and last edge hold every vector."""
    out = []
    for d in range(len(low)):
        inner = np.floor(np.quantile(sample[:, d], np.arange(1, CELLS) / CELLS))
        out.append(np.unique(np.concatenate(([low[d]], inner[(inner > low[d]) & (inner <= high[d])], [max(high[d] + 1, np.nextafter(high[d], np.inf))]))))
    return out


def _index(edges: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(2)]), batch.num_rows)
            codes = np.empty(x.shape, np.uint8)
            for d, e in enumerate(edges):
                codes[:, d] = np.searchsorted(e, x[:, d], "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "row", "cells"])

    return run


SURVIVORS = "query_id long, query long, _r int, _q int, kth double, rows array<long>, uppers array<double>"


def _bounds(edges: list[np.ndarray], k: int):
    """Of each query of a block: the k-th largest lower bound of its scores with
    the block's vectors, and the rows that may reach it."""
    most_of = [max(abs(e[0]), abs(e[-1] - 1)) for e in edges]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        q_ids, r_ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        out: list[list] = [[], [], [], [], []]
        if len(q_ids) and len(r_ids):
            q, numbers, q_rows = matrix(queries["v"], len(q_ids)), rows["row"].to_numpy(), queries["row"].to_numpy()
            cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.uint8).reshape(len(r_ids), -1)
            low = np.stack([e[cells[:, d]] for d, e in enumerate(edges)], 1)
            high = np.stack([e[cells[:, d] + 1] - 1 for d, e in enumerate(edges)], 1)
            most = float(max(most_of)) * float(np.abs(q).max(initial=0)) * q.shape[1]
            kind = np.float32 if most < 1 << 23 else np.float64
            slack = _slack(most)
            low, high = low.astype(kind), high.astype(kind)
            for at in range(0, len(q), 256):
                part = q[at : at + 256].astype(kind)
                plus, minus = np.maximum(part, 0), np.minimum(part, 0)
                upper, lower = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
                for j in range(len(part)):
                    other = r_ids != q_ids[at + j]
                    b = np.where(other, lower[j], -np.inf)
                    least = np.partition(b, len(b) - k)[len(b) - k] if other.sum() >= k else -np.inf
                    near = np.flatnonzero((upper[j] >= least - slack) & other)
                    for column, value in zip(out, (q_ids[at + j], q_rows[at + j], float(least), numbers[near], upper[j][near].astype(float)), strict=True):
                        column.append(value)
        n = len(out[0])
        lists = [pa.array(x, pa.list_(t)) for x, t in zip(out[3:], (pa.int64(), pa.float64()), strict=True)]
        blocks = [pa.array(np.full(n, rows[c][0].as_py() if rows.num_rows else 0, np.int32)) for c in ("_r", "_q")]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *blocks, pa.array(out[2], pa.float64()), *lists], [c.split()[0] for c in SURVIVORS.split(", ")])

    return run


def _slack(most: float) -> float:
    """By how much bounds of huge components are rounded."""
    return 0.0 if most < 1 << 52 else most * 1e-9


def _wanted(batches):
    """The rows that any of a batch's lists holds, once for each pair of blocks."""
    for batch in batches:
        pair = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
        flat, size = batch.column(2).flatten().to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
        of = np.repeat(pair, size)
        for one in np.unique(pair):
            rows = np.unique(flat[of == one])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x, np.int32)) for x in (one >> 32, one & 0xFFFFFFFF)] + [pa.array(rows)], ["_r", "_q", "row"])


def _exact(k: int, largest: float):
    """Of each query of a block the best of the block's vectors that were read."""

    def run(lists: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if lists.num_rows and vectors.num_rows:
            numbers = vectors["row"].to_numpy()
            order = np.argsort(numbers, kind="stable")
            numbers, ids, exact = numbers[order], vectors["vec_id"].to_numpy()[order], matrix(vectors["v"], len(order))[order]
            q, least = matrix(lists["v"], lists.num_rows), lists["least"].to_numpy()
            most = largest * float(np.abs(q).max(initial=0)) * q.shape[1]
            for j, (qid, rows, uppers) in enumerate(zip(lists["query_id"].to_pylist(), lists["rows"], lists["uppers"], strict=True)):
                near, bound = np.searchsorted(numbers, rows.values.to_numpy()), uppers.values.to_numpy()
                keep = np.flatnonzero(bound >= least[j] - _slack(most))
                keep = keep[np.lexsort((ids[near[keep]], -bound[keep]))]
                out += _read(qid, q[j], near[keep], bound[keep], exact, ids, k, _slack(most), most)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    return run


def _read(qid, q, near, upper, exact, ids, k, slack, most) -> list[tuple]:
    """The k best of the candidates `near`, ordered by their bounds `upper`."""
    scores, kth, at = np.empty(0), -np.inf, 0
    while at < len(near) and (len(scores) < k or upper[at] + slack >= kth):
        part = near[at : at + STEP]
        if most < 1 << 52:
            new = exact[part] @ q
        else:  # beyond the doubles that are whole numbers
            new = np.array([sum(int(x) * int(y) for x, y in zip(exact[p], q, strict=True)) for p in part], object)
        scores = np.concatenate((scores, new))
        at += len(part)
        if len(scores) >= k:
            kth = float(sorted(scores, reverse=True)[k - 1]) if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
    mine = ids[near[: len(scores)]]
    top = sorted(zip((-scores).tolist(), mine.tolist(), strict=True))[:k]
    return [(qid, i, max(-(1 << 63), min((1 << 63) - 1, int(-s)))) for s, i in top]


def top_k(table: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row where is_query
    holds, the k rows of highest integer inner product (all, if fewer), without
    the query's own id; ties to the smaller vec_id.

    Null vectors, vectors with null or non-finite components, rows without id
    and vectors of an unusual length take no part. Rows that repeat an id are
    candidates each. An empty table gives an empty result. Scores beyond a long
    are cut to it. Other columns are not read.
    """
    spark = table.sparkSession
    work = workdir(spark, "va-search")
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole; floor() would cut them to a long
    ints = usable(table, id_col, vector_col).select("vec_id", F.transform("v", lambda x: whole(x * scale)).alias("v"))
    ints = written(ints.select("vec_id", F.monotonically_increasing_id().alias("row"), "v"), f"{work}/vectors")
    ends = ints.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()
    if not ends:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = np.array([r.low for r in ends]), np.array([r.high for r in ends])
    sample = np.array([r.v for r in ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()])
    edges = cell_edges(sample, low, high)
    index = written(ints.mapInArrow(lean(_index(edges)), "vec_id long, row long, cells binary"), f"{work}/index")
    queries = ints.where(is_query)
    survivors = in_blocks(index, queries, index.count(), queries.count()).applyInArrow(_bounds(edges, k), SURVIVORS)
    survivors = written(survivors, f"{work}/survivors")
    least = survivors.groupBy("query").agg(F.max("kth").alias("least"))
    lists = survivors.join(least, "query")
    open_ = F.filter(F.arrays_zip("rows", "uppers"), lambda x: x["uppers"] >= F.col("least") - _slack(float(max(np.abs(low).max(), np.abs(high).max())) ** 2 * len(low)))
    lists = lists.withColumn("open", open_).where(F.size("open") > 0).select("query_id", "query", "_r", "_q", "least", F.col("open.rows").alias("rows"), F.col("open.uppers").alias("uppers"))
    lists = written(lists, f"{work}/lists")
    discard(spark, f"{work}/survivors")
    read = lists.select("_r", "_q", "rows").mapInArrow(_wanted, "_r int, _q int, row long").distinct().join(ints, "row").toDF("row", "_r", "_q", "vec_id", "v")
    lists = lists.join(queries.select(F.col("row").alias("query"), "v"), "query")
    largest = float(max(np.abs(low).max(), np.abs(high).max()))
    found = lists.groupBy("_r", "_q").cogroup(read.groupBy("_r", "_q")).applyInArrow(_exact(k, largest), "query_id long, vec_id long, score long")
    return best(found, k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""
