"""Packing by concatenate and cut.

Pass one encodes every document once and keeps the ids with the document's
place among the tokens of its input partition. The partitions' token totals,
one number each, give by prefix sums where each partition starts; so every
document knows its place in the concatenation of all, and pass two cuts it at
multiples of the window, document by document, in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import lean, workdir, written
from ferngraph.llm.encode import encoder

ENCODED = "part long, doc_id long, at long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, tokens binary"


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            done = 0
            for ids, off in enc.column(batch.column(1), end_id):
                n = np.diff(off)
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off * enc.dtype.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                cols = [pa.array(np.full(len(n), part, np.int64)), batch.column(0).slice(done, len(n)), pa.array(at + off[:-1]), pa.array(n), raw]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "n_tokens", "ids"])
                at += len(ids)
                done += len(n)

    return run


def _cut(dtype: str, window: int, with_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, total = (batch.column(k).to_pylist() for k in range(3))
            rows: list[list] = [[] for _ in range(9)]
            for d, a, n, raw in zip(doc, at, total, batch.column(3).to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, window - (a + start) % window)
                    piece = ids[start : start + length].tobytes()
                    row = (d, start, length, zlib.crc32(piece), n, (a + start) // window, (a + start) % window, length < n, piece if with_tokens else None)
                    for col, v in zip(rows, row, strict=True):
                        col.append(v)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    return run


def prefix_sums(totals: DataFrame, by: str, count: str) -> DataFrame:
    """(by, base): the sum of all counts before each key, in ascending order.
    One row per input partition or file, so it is summed on the driver."""
    base, rows = 0, []
    for k, n in sorted(map(tuple, totals.select(by, count).collect())):
        rows.append((k, base))
        base += n
    return totals.sparkSession.createDataFrame(rows, f"{by} long, base long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, with_tokens: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of `window` tokens: doc_id, start,
    length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id, offset, boundary (the document was cut), tokens
    (those bytes, if asked for). Every document is followed by end_id; every
    sequence but the last is full.

    Null and empty texts are documents of the end id alone. Repeated rows are
    packed each; a null doc_id stays null. An empty table gives no piece.
    Columns besides the two named are not read.
    """
    spark = docs.sparkSession
    work = workdir(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = written(source.mapInArrow(lean(_encoded(tokenizer_path, end_id)), ENCODED), f"{work}/encoded")
    base = prefix_sums(encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n")
    placed = encoded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n_tokens", "ids")
    out = placed.mapInArrow(lean(_cut(encoder(tokenizer_path).dtype.str, window, with_tokens)), PIECES)
    return out if with_tokens else out.drop("tokens")
