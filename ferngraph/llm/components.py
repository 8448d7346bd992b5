"""Connected components of an edge table by repeated contraction.

Every round each node points to its best neighbour, pointers are followed once
more, and the edges are rewritten between the nodes pointed to. The first round
prefers small ids (one round ends a star around its smallest node); later
rounds prefer small hashes, fresh each round, so long paths shrink by a constant
factor as well. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import written


def components(edges: DataFrame, work: str) -> DataFrame:
    """(id, component): for every node of an edge (columns a, b; long), the
    smallest id of its component. Loops, repeated edges and either direction
    are allowed, nulls are dropped; no edges give an empty table."""
    spark = edges.sparkSession
    pairs = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = written(edges.where("a is not null and b is not null and a <> b").select(*pairs(F.col("a"), F.col("b"))).distinct(), f"{work}/edges-0")
    labels, k = None, 0
    while not e.isEmpty():
        both = e.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("to")))
        rank = (lambda c: c) if k == 0 else (lambda c, k=k: F.xxhash64(F.lit(k), c))
        near = both.groupBy("id").agg(F.min(F.struct(rank(F.col("to")).alias("r"), F.col("to").alias("to"))).alias("m"))
        own = F.struct(rank(F.col("id")).alias("r"), F.col("id").alias("to"))
        hop = written(near.select("id", F.least(F.col("m"), own)["to"].alias("to")), f"{work}/hop-{k}")
        further = hop.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        point = written(hop.join(further, "to").select("id", F.col("to2").alias("to")), f"{work}/point-{k}")
        if labels is None:
            labels = point.withColumnRenamed("to", "root")
        else:
            labels = labels.join(point.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        labels = written(labels, f"{work}/labels-{k}")
        a, b = point.select(F.col("id").alias("a"), F.col("to").alias("ta")), point.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        e = e.join(a, "a").join(b, "b").where("ta <> tb").select(*pairs(F.col("ta"), F.col("tb"))).distinct()
        k += 1
        e = written(e, f"{work}/edges-{k}")
    if labels is None:
        return spark.createDataFrame([], "id long, component long")
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
