"""Token ids as flat binary files, memory-mapped for reading.

A corpus is a folder of shards in ascending doc_id order. Shard k has
`k.ids` (unsigned 16- or 32-bit little-endian ids, by the vocabulary's size),
`k.offsets` (64-bit: where each document starts in the shard, and the end) and
`k.docs` (64-bit doc_ids). `manifest.json` lists the shards with their bases,
the tokens of all shards before, from prefix sums over the shards' totals.
A shard is written under a task attempt's own name and renamed when complete,
so a retried or doubled task leaves whole files only.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.llm.common import lean, ship, workdir
from ferngraph.llm.encode import encoder

#: Tokens read and checksummed at once.
STEP = 1 << 22


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _save(uri: str, name: str, parts: Iterator[memoryview] | list[bytes]) -> None:
    fs, folder = filesystem(uri)
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        for x in parts:
            f.write(x)
    fs.move(own, f"{folder}/{name}")


def _load(uri: str, name: str, dtype: str) -> np.ndarray:
    fs, folder = filesystem(uri)
    path = f"{folder}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        sizes: list[np.ndarray] = []
        docs: list[np.ndarray] = []

        def ids() -> Iterator[memoryview]:
            for batch in batches:
                docs.append(batch.column(0).to_numpy())
                for x, off in enc.column(batch.column(1), end_id):
                    sizes.append(np.diff(off))
                    yield memoryview(x).cast("B")

        _save(folder, f"{part:06d}.ids", ids())
        if sizes:
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<i8")
            _save(folder, f"{part:06d}.offsets", [offsets.tobytes()])
            _save(folder, f"{part:06d}.docs", [np.concatenate(docs).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"shard": [part], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    return run


@dataclass
class TokenFiles:
    """A written corpus."""

    folder: str
    dtype: str
    shards: list[dict]

    @classmethod
    def open(cls, folder: str) -> TokenFiles:
        fs, path = filesystem(folder)
        with fs.open_input_file(f"{path}/manifest.json") as f:
            m = json.loads(f.read())
        return cls(folder, m["dtype"], m["shards"])

    def digest(self, spark: SparkSession) -> DataFrame:
        """One row per document, from the files: doc_id, start (tokens of all
        documents before), n_tokens, ids_crc32, shard."""
        ship(spark)
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
        if not self.shards:
            return spark.createDataFrame([], schema)
        rows = spark.createDataFrame([(s["shard"], s["base"]) for s in self.shards], "shard long, base long")
        return rows.repartition(len(self.shards)).mapInArrow(lean(_read(self.folder, self.dtype)), schema)

    def tokens(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A shard's ids, offsets and doc_ids, memory-mapped."""
        name = f"{shard:06d}"
        return _load(self.folder, f"{name}.ids", self.dtype), _load(self.folder, f"{name}.offsets", "<i8"), _load(self.folder, f"{name}.docs", "<i8")


def _read(folder: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, off, docs = TokenFiles(folder, dtype, []).tokens(shard)
                crc = np.empty(len(docs), np.int64)
                at = 0
                while at < len(docs):
                    end = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
                    wide = memoryview(ids[off[at] : off[end]].astype("<u4")).cast("B")
                    cuts = ((off[at : end + 1] - off[at]) * 4).tolist()
                    for k in range(end - at):
                        crc[at + k] = zlib.crc32(wide[cuts[k] : cuts[k + 1]])
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(docs)), pa.array(base + off[:-1]), pa.array(np.diff(off)), pa.array(crc), pa.array(np.full(len(docs), shard, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode all documents and write them in ascending doc_id order, each
    followed by end_id.

    Null and empty texts are documents of the end id alone. Rows that repeat a
    doc_id are written each, in the order of their texts, null first. Rows
    without doc_id have no place in the order and are left out. An empty table
    gives a manifest without shards. Columns besides the two named are not read.
    """
    spark = docs.sparkSession
    folder = folder or workdir(spark, "token-files")
    ship(spark)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(ordered.mapInArrow(lean(_write(folder, tokenizer_path, end_id)), "shard long, n_docs long, n_tokens long").collect())
    base, listed = 0, []
    for s in shards:  # one row per shard
        listed.append({"shard": s.shard, "n_docs": s.n_docs, "n_tokens": s.n_tokens, "base": base})
        base += s.n_tokens
    dtype = encoder(tokenizer_path).dtype.str
    _save(folder, "manifest.json", [json.dumps({"dtype": dtype, "shards": listed}).encode()])
    return TokenFiles(folder, dtype, listed)
