"""A corpus pipeline: toxicity, line deduplication, near duplicates, personal
data, packing. Each stage reads what its predecessor kept, as written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.llm import line_dedup, ngram_join, packing, pii, toxicity
from ferngraph.llm.common import BROADCAST_ROWS, table, workdir, written


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated windows of lines go."""
    return _measured(line_dedup.dedup_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document of the smallest doc_id
    stays. Texts aren't moved while the documents to drop are few."""
    groups = ngram_join.ngram_join(docs, width=5, percent=80)
    drop = written(groups.where("component_id <> doc_id").select("doc_id"), f"{workdir(spark, 'near-duplicates')}/drop")
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets."""
    return _measured(pii.mask_pii(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece, with its tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048, with_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the model, the bootstrapped patterns or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    work = workdir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{work}/{k}")
    return docs
