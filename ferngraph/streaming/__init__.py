"""Facts that keep up with a folder: new files are parsed as they arrive."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferngraph.shipping import ship
from ferngraph.sources.gofacts import PARSED, SCHEMAS, _extract, facts_in


def follow_facts(spark: SparkSession, root: str, target: str, checkpoint: str, modules: list[tuple[str, str]] | None = None, **trigger) -> StreamingQuery:
    """Append the facts of every new Go file below root to Parquet folders, one
    per fact table, below target. Files are read once; the checkpoint makes a
    restarted query go on where it stopped."""
    ship(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.go").option("recursiveFileLookup", "true").load(root)
    files = files.where(~F.col("path").endswith("_test.go")).select("path", "content")
    parsed = files.mapInPandas(_extract(os.path.abspath(root), modules or [("", "")], ["./..."]), PARSED)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind in SCHEMAS:
            facts_in(batch, kind).write.mode("overwrite").parquet(f"{target}/{kind}/batch={number}")  # a batch run again replaces its own files
        batch.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
