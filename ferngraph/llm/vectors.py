"""What the vector searches share: usable vectors as arrays, and the blocks by
which a stated query set meets all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors and queries of one block; a task holds one of each.
ROWS, QUERIES = 8192, 4096


def usable(table: DataFrame, id_col: str, vector_col: str, *also: str) -> DataFrame:
    """(vec_id, v) and columns that go along: rows with an id and a vector of
    finite components, of the most usual length (the smaller, if two are as usual)."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *also).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["dim"] if usual else 0))


def matrix(col: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list<double> column as rows of a matrix."""
    flat = np.concatenate([c.flatten().to_numpy() for c in col.chunks]) if rows else np.empty(0)
    return flat.reshape(rows, -1)


def in_blocks(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, key: str = "vec_id"):
    """Both sides, grouped so that every block of queries meets every block of
    rows once. Blocks are by hash of the id, so equal vectors spread."""
    row_blocks, query_blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES))
    block = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_r", block(row_blocks, key)).withColumn("_q", every(query_blocks))
    right = queries.withColumn("_q", block(query_blocks, key)).withColumn("_r", every(row_blocks))
    return left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q"))


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to
    the smaller vec_id."""
    from pyspark.sql import Window

    order: list[Column] = [F.col("score").desc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
