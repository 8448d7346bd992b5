"""Graph loops over the cluster, the same at every size.

A loop's tables are written to the shared folder, which cuts their lineage, and
are counted as they are written. Every round goes several steps before it writes,
so that a small graph takes few jobs; a frontier holds new nodes only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Steps that a round goes before it writes.
STEPS = 3
#: Rows that a task sorts or groups, about.
ROWS = 500_000
#: Counted rows of a side that is broadcast, at most.
FEW = 1_000_000
_folders: dict[str, str] = {}


def _folder(spark) -> str:
    """A folder of this application below spark.checkpoint.dir; of this machine
    only where the setting is missing, as in tests. It goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        _folders[app] = f"{root.rstrip('/')}/loops-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[app])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())

        def clear() -> None:
            try:
                files.delete(path, True)
            except Exception:  # noqa: BLE001  the JVM may have gone before
                pass

        atexit.register(clear)
    return _folders[app]


def cut(df: DataFrame, **sums) -> tuple[DataFrame, tuple[int, ...]]:
    """df as a written table, with its count and sums over its rows."""
    spark = df.sparkSession
    path, seen = f"{_folder(spark)}/{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(n) for n, c in sums.items()]).write.parquet(path)
    got = seen.get
    return spark.read.schema(df.schema).parquet(path), (got["_rows"] or 0, *(got[n] or 0 for n in sums))


def written_by(df: DataFrame, column: str) -> DataFrame:
    """df as a written table, a folder for each value of a column."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, rows: int) -> int:
    """How many parts that many rows are dealt into: 0, which leaves it to Spark,
    for those that one task can hold, else at least one a core."""
    return 0 if rows <= ROWS else max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys, about ROWS of its counted rows to a part, whatever its size."""
    parts = parts_of(df, rows)
    return df.repartition(parts, *keys) if parts else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a written table."""
    return cut(df)[0]


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, depth): every node reachable from the seeds (column id) over edges
    (src, dst), the seeds included at depth 0, by the fewest steps."""
    pairs = checkpointed(edges.select("src", "dst").distinct())
    seen, (n,) = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, k = seen, 0
    while n:
        found = None
        for _ in range(STEPS):
            k += 1
            near = pairs.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
            near = near.join(seen.select("id"), "id", "left_anti")
            if found is not None:
                near = near.join(found.select("id"), "id", "left_anti")
            frontier = near.withColumn("depth", F.lit(k))
            found = frontier if found is None else found.unionByName(frontier)
        found, (n,) = cut(found)
        frontier = found.where(F.col("depth") == k)
        seen = seen.unionByName(found)
        if not k % (16 * STEPS):  # else its plan grows with every round
            seen = checkpointed(seen)
    return seen


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that have ways in and out, STEPS times among those
    that are left, and their count."""
    for _ in range(STEPS):
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")
    edges, (n,) = cut(edges)
    return edges, n


@dataclass
class _Chains:
    """Nodes with one way out, taken from a graph: where they get (id, to) by 1,
    4, 16, ... steps; where those end (id, to) that leave; and the edges that
    lead to these from elsewhere (src, dst, to)."""

    levels: list[DataFrame]
    ends: DataFrame
    entries: DataFrame


def _compressed(edges: DataFrame, lone: DataFrame, n: int) -> tuple[DataFrame, int, DataFrame, _Chains]:
    """The graph without its n nodes that have one way out (id, to), where an
    edge to such a node leads to its chain's end instead; the cycles among these
    nodes (id, component); the chains. Steps are doubled twice a round, so that
    chains and cycles of any length take a round for each fourfold length."""
    levels, span = [checkpointed(lone.withColumn("low", F.col("id")))], 1
    while span < n:
        then = levels[-1].select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("low").alias("least"))
        far = levels[-1]
        for _ in range(STEPS):
            far = far.join(then, "to", "left").select("id", F.coalesce("then", "to").alias("to"), F.least("low", F.coalesce("least", "low")).alias("low"))
        levels.append(checkpointed(far))
        span *= STEPS + 1
    last, own = levels[-1], lone.select("id")
    rings = checkpointed(last.join(last.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select("id", F.col("low").alias("component")))
    ends = last.select("id", "to").join(own.withColumnRenamed("id", "to"), "to", "left_anti")
    outer = edges.join(own.withColumnRenamed("id", "src"), "src", "left_anti")
    led = outer.join(last.select(F.col("id").alias("dst"), "to"), "dst", "left").join(own.withColumnRenamed("id", "to"), "to", "left_anti")
    led = checkpointed(led.select("src", "dst", "to"))
    left, (n,) = cut(led.select("src", F.coalesce("to", "dst").alias("dst")).where("src <> dst").distinct())
    return left, n, rings, _Chains([x.select("id", "to") for x in levels], ends.select("id", "to"), led.where("to is not null"))


def _restored(found: DataFrame, chains: _Chains) -> DataFrame:
    """found (id, component) with the chains' nodes that lie on a cycle: those
    after an edge from the component to which the chain leads."""
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    back = chains.entries.join(of("src"), "src", "left").join(of("to"), "to", "left").withColumn("component", F.coalesce("of_to", "to"))
    back, (n,) = cut(back.where(F.coalesce("of_src", "src") == F.col("component")).select("dst", "to", "component"))
    if not n:
        return found
    marked = back.select(F.col("dst").alias("id"), "component").distinct()
    for level in chains.levels:
        step = new = marked
        for _ in range(STEPS):
            step = step.join(level, "id").select(F.col("to").alias("id"), "component")
            new = new.unionByName(step)
        marked = checkpointed(new.distinct().join(chains.ends.select("id"), "id", "left_semi"))
    heads = back.select(F.col("to").alias("id"), "component").distinct().join(found.select("id"), "id", "left_anti")
    return checkpointed(found.unionByName(marked).unionByName(heads))


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, c): the smallest id that reaches each node, itself included."""
    start = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    colour, changed = checkpointed(start.withColumn("c", F.col("id"))), 1
    while changed:
        new = colour.withColumn("old", F.col("c"))
        for _ in range(STEPS):
            heard = edges.join(new.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("h"))
            new = new.join(heard, "id", "left").select("id", F.least("c", F.coalesce("h", "c")).alias("c"), "old")
        new, (_, changed) = cut(new, changed=(F.col("c") != F.col("old")).cast("long"))
        colour = new.select("id", "c")
    return colour


def _reaching(same: DataFrame) -> DataFrame:
    """(id, component): nodes that reach their colour's namesake by edges
    (src, dst) within the colour cs, and the namesake."""
    back = checkpointed(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    names = same.select(F.col("cs").alias("id")).distinct()
    got = reach(back, names).select("id")
    own = same.select(F.col("src").alias("id"), F.col("cs").alias("component")).unionByName(same.select(F.col("dst").alias("id"), F.col("cs").alias("component"))).distinct()
    return own.join(got, "id")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each node's strongly connected
    component, over edges (src, dst). Rounds cut off nodes without a way in or
    out and compress chains of nodes with one way out. If both leave what there
    is, they colour it with the smallest id that reaches a node, and take the
    nodes of a colour that reach its namesake: these are its component."""
    pairs, (n, loops) = cut(edges.select("src", "dst").distinct(), loops=(F.col("src") == F.col("dst")).cast("long"))
    nodes = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    left, n = pairs.where("src <> dst"), n - loops
    found, taken = nodes.limit(0).withColumn("component", F.col("id")), []
    rounds = 0
    while n:
        rounds += 1
        out = left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("to"))
        ways = out.join(left.select(F.col("dst").alias("id"), F.lit(True).alias("into")).distinct(), "id", "full")
        ways, (_, k, loose) = cut(ways, lone=F.coalesce(F.col("n") == 1, F.lit(False)).cast("long"), loose=(F.col("n").isNull() | F.col("into").isNull()).cast("long"))
        if k and (8 * k >= n or rounds > 3):
            left, n, rings, chains = _compressed(left, ways.where("n = 1").select("id", "to"), k)
            taken.append(chains)
            found, rounds = checkpointed(found.unionByName(rings)), 0
        elif loose:
            left, n = _trimmed(left)
        else:
            colour = _coloured(left)
            ends = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
            same = checkpointed(ends.where("cs = cd").select("src", "dst", "cs"))
            new = checkpointed(_reaching(same))
            found, rounds = checkpointed(found.unionByName(new)), 0
            gone = new.select("id")
            left, (n,) = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    for chains in reversed(taken):
        found = _restored(found, chains)
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return nodes.join(found.join(least, "component").select("id", "least"), "id", "left").select("id", F.coalesce("least", "id").alias("component"))
