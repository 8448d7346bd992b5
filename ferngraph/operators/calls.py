"""Call-graph queries over call_edges (caller, callee, call_type, file, line,
site_ord); any edge list with these two node columns serves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferngraph.functions import anchor
from ferngraph.plans.graphs import FEW, checkpointed, cut, dealt, reach

HIERARCHY_DEPTH, CALLERS_DEPTH, PATH_DEPTH, PATHS = 3, (3, 8), (8, 12), (20, 100)


def hierarchy_depth(n: int) -> int:
    return n if 1 <= n <= HIERARCHY_DEPTH else HIERARCHY_DEPTH


def callers_depth(n: int) -> int:
    """Out of range falls back to the default, it isn't cut to the largest."""
    return n if 1 <= n <= CALLERS_DEPTH[1] else CALLERS_DEPTH[0]


def path_limits(depth: int, paths: int) -> tuple[int, int]:
    return (depth if 1 <= depth <= PATH_DEPTH[1] else PATH_DEPTH[0]), (paths if 1 <= paths <= PATHS[1] else PATHS[0])


def _walk(edges: DataFrame, roots: DataFrame, depth: int, at: str, to: str) -> DataFrame:
    """Edges met within depth steps from the roots, each (caller, callee) once:
    at its fewest steps, then at its first site. A level is one join with a
    frontier of nodes that are new; frontiers are written, so no level
    computes the ones before again. Edges are written as well, and
    dealt by their count: every node is in one frontier, so that no more rows than
    these come together."""
    edges, (rows,) = cut(edges)
    frontier, (n,) = cut(roots.select(F.col("id").alias(at)).distinct())
    seen, levels = None, []
    for k in range(1, depth + 1):
        near = (edges, F.broadcast(frontier)) if n <= FEW else (dealt(x, rows, at) for x in (edges, frontier))
        hop = DataFrame.join(*near, at).select(*edges.columns, F.lit(k).alias("depth"))
        levels.append(hop)
        if k < depth:
            seen = frontier if seen is None else seen.unionByName(frontier)
            frontier, (n,) = cut(hop.select(F.col(to).alias(at)).distinct().join(seen, at, "left_anti"))
            if not n:
                break
    every = dealt(reduce(DataFrame.unionByName, levels), rows, "caller", "callee")
    if "site_ord" not in every.columns:
        return every.groupBy(*edges.columns).agg(F.min("depth").alias("depth"))
    w = Window.partitionBy("caller", "callee").orderBy("depth", "site_ord")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hierarchy(edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """Edges whose caller is fewer than max_depth calls from the roots, with
    the fewest calls to each as depth."""
    return _walk(edges, roots, hierarchy_depth(max_depth), "caller", "callee")


def callers(edges: DataFrame, targets: DataFrame, max_depth: int = 3) -> DataFrame:
    """The same against the direction of calls."""
    return _walk(edges, targets, callers_depth(max_depth), "callee", "caller")


EDGE_ORDER = ("depth", "caller", "callee")


def with_anchor(edges: DataFrame) -> DataFrame:
    return edges.withColumn("anchor", anchor("file", "line", "callee"))


def summary(edges: DataFrame, by: str) -> DataFrame:
    """(key, n): edges by call_type, caller or callee."""
    return edges.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n"))


def full_summary(edges: DataFrame) -> DataFrame:
    """All three counts and the total, by grouping sets in one pass."""
    sets = edges.groupingSets([["call_type"], ["caller"], ["callee"], []], "call_type", "caller", "callee")
    level = F.grouping_id()
    kind = F.when(level == 3, "call_type").when(level == 5, "caller").when(level == 6, "callee").otherwise("total")
    return sets.agg(F.count("*").alias("n"), kind.alias("kind")).select("kind", F.coalesce(F.col("call_type").cast("string"), F.col("caller").cast("string"), F.col("callee").cast("string"), F.lit("")).alias("key"), "n")


def paths(edges: DataFrame, start: DataFrame, target: DataFrame, max_depth: int = 8, max_paths: int = 20) -> DataFrame:
    """(length, path): simple paths from start to target (tables of one id),
    shortest first, then by the path, at most max_paths. Nodes that can't reach
    the target in the steps left are dropped at every level, and no level is
    tried once shorter paths fill the quota. A path from a node to itself is
    never found."""
    depth, most = path_limits(max_depth, max_paths)
    pairs = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    pairs = checkpointed(pairs.distinct())
    left = checkpointed(reach(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), target).where(F.col("depth") < depth).select(F.col("id").alias("dst"), F.col("depth").alias("left")))
    goal = target.select(F.col("id").alias("goal"))
    open_paths = start.select(F.col("id").alias("src"), F.array("id").alias("path")).crossJoin(F.broadcast(goal.limit(1))).where("src <> goal")
    found, n = [], 0
    for k in range(1, depth + 1):
        step = open_paths.join(pairs, "src").where(~F.array_contains("path", F.col("dst")))
        step = step.join(left.where(F.col("left") <= depth - k), "dst").select(F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"), "goal")
        step, (rows, there) = cut(step, there=(F.col("src") == F.col("goal")).cast("long"))
        found.append(step.where("src = goal").select(F.lit(k).alias("length"), "path"))
        n += there
        open_paths = step.where("src <> goal")
        if n >= most or rows == there:
            break
    return reduce(DataFrame.unionByName, found).orderBy("length", "path").limit(most)


def cutoff_reason(n_paths: int, max_paths: int) -> str:
    if n_paths >= max_paths:
        return f"reached max_paths limit of {max_paths}"
    return "" if n_paths else "no path found within depth limit"


def call_type(is_go: Column, is_interface: Column) -> Column:
    """go statements are Goroutine, calls through interfaces Interface, all
    others, deferred ones too, Static."""
    return F.when(is_go, "Goroutine").when(is_interface, "Interface").otherwise("Static")


def class_hierarchy_edges(static: DataFrame, interface_calls: DataFrame, implementors: DataFrame) -> DataFrame:
    """Static edges and, for each call of an interface's method, an edge to that
    method of every implementor: (caller, call_type, ...) from interface_calls
    (caller, iface, method, ...) and implementors (iface, method, callee)."""
    dynamic = interface_calls.join(implementors, ["iface", "method"]).withColumn("call_type", call_type(F.col("call_type") == "Goroutine", F.lit(True)))
    return static.unionByName(dynamic.select(*static.columns))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return reach(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), seeds)
