"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order of nearness. Inverted
files list, for each pivot, the vectors that have it among theirs and at what
place. A query reads the files of its own pivots and sums up the footrule
distance, the differences of places (a missing pivot counts as the place after
the last); the nearest share of each block by footrule is reranked by the
measure itself, on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import workdir, written
from ferngraph.llm.vectors import best, in_blocks, matrix, usable

#: Pivots, drawn from the vectors of the smallest hashes of vec_id; places kept of each permutation.
PIVOTS, PLACES = 512, 128
#: Share of the vectors of each block that are reranked, at every size; k at least.
SHARE = 0.2


def _permutations(pivots: np.ndarray, places: int):
    def run(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(1)]), batch.num_rows)
            near = x @ pivots.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :places].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o.tobytes() for o in order], pa.binary()), batch.column(1)], ["vec_id", "places", "v"])

    return run


def _search(n_pivots: int, places: int, share: float, k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, q_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        out: list[tuple] = []
        if len(ids) and len(q_ids):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], matrix(rows["v"], len(ids))[order]
            perms = np.frombuffer(b"".join(rows["places"].to_pylist()), np.uint16).reshape(len(ids), -1)[order]
            q, q_perms = matrix(queries["v"], len(q_ids)), np.frombuffer(b"".join(queries["places"].to_pylist()), np.uint16).reshape(len(q_ids), -1)
            norm = np.sqrt((x * x).sum(1))
            # the inverted files: postings (vector, place), by pivot
            by = np.argsort(perms.ravel(), kind="stable")
            vector, place = (by // places).astype(np.int32), (by % places).astype(np.int16)
            file = np.searchsorted(perms.ravel()[by], np.arange(n_pivots + 1))
            keep = max(k, math.ceil(share * len(ids)))
            for i, qid in enumerate(q_ids):
                posts = [slice(file[p], file[p + 1]) for p in q_perms[i]]
                vec = np.concatenate([vector[s] for s in posts])
                own = np.repeat(np.arange(places, dtype=np.int16), [s.stop - s.start for s in posts])
                saved = places - own - np.abs(own - np.concatenate([place[s] for s in posts]))
                gain = np.bincount(vec, saved, len(ids)).astype(np.int64) * len(ids) - np.arange(len(ids))  # less footrule, then smaller id
                own_rows = slice(*np.searchsorted(ids, (qid, qid + 1)))
                gain[own_rows] = -(1 << 62)
                near = np.argpartition(-gain, min(keep, len(ids)) - 1)[:keep]
                near = near[ids[near] != qid]  # its own rows, where others are fewer
                score = (x[near] * q[i]).sum(1) / (norm[near] * np.sqrt((q[i] * q[i]).sum()))
                top = np.lexsort((ids[near], -score))[:k]
                out += zip([qid] * len(top), ids[near[top]].tolist(), score[top].tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(table: DataFrame, is_query, k: int = 5, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine, in double precision):
    for every row where is_query holds, its k nearest found (all candidates, if
    fewer), without the query's own id; ties to the smaller vec_id.

    Null vectors, vectors of zeros or with null or non-finite components, rows
    without id and vectors of an unusual length take no part. Rows that repeat
    an id are candidates each. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = table.sparkSession
    work = workdir(spark, "permutation-index")
    rows = usable(table, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    rows = written(rows, f"{work}/vectors")
    drawn = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * PIVOTS).select("v").collect()]
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = np.array(list(dict.fromkeys(map(tuple, drawn)))[:PIVOTS])
    pivots /= np.sqrt((pivots * pivots).sum(1))[:, None]
    places = min(PLACES, len(pivots))
    index = written(rows.mapInArrow(_permutations(pivots, places), "vec_id long, places binary, v array<double>"), f"{work}/index")
    n, queries = index.count(), index.where(is_query)
    found = in_blocks(index, queries, n, queries.count()).applyInArrow(_search(len(pivots), places, share, k), "query_id long, vec_id long, score double")
    return best(found, k)
