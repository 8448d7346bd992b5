"""Shared plumbing of the corpus operators: the shared work folder, written
intermediate tables, and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph import shipping
from ferngraph.shipping import BATCH, give_back


def ship(spark: SparkSession) -> None:
    """What a session needs before these operators run: the package in the
    Python workers of every executor, and small batches for them."""
    shipping.ship(spark)
    spark.conf.set(*BATCH)


def lean(run: Callable) -> Callable:
    """A function over batches that gives memory back after each of them."""

    def wrapped(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return wrapped


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of this
    machine only where the setting is missing, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root."""
    ship(spark)
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and return it as read back: cuts lineage, and a lost
    executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that no later step reads."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side is broadcast only if it was counted and has at most so many rows of
#: two or three longs (about 100 MB as a hashed relation).
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast, if its counted rows are few; else as it is."""
    return F.broadcast(df) if rows <= most else df
