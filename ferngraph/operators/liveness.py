"""Entrypoints and dead code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import anchor, is_exported, short_function_name
from ferngraph.plans.graphs import reach


def spawn_target(kind: Column, target: Column, fn: Column) -> Column:
    return F.when(kind.isin("static", "closure") & (F.coalesce(target, F.lit("")) != ""), target).when(kind == "closure", F.concat(F.lit("<closure in "), fn, F.lit(">"))).otherwise(F.concat(F.lit("<dynamic in "), fn, F.lit(">")))


def entrypoints(functions: DataFrame, go_sites: DataFrame) -> DataFrame:
    """(kind, function, package, file, line, anchor): main functions of main
    packages, one init per package, and each target of a go statement once per
    package, at its first site."""
    main = functions.where("name = 'main' and pkg_name = 'main' and coalesce(recv_type, '') = ''").select(F.lit("main").alias("kind"), F.col("fn_id").alias("function"), F.col("pkg_path").alias("package"), "file", "line")
    init = functions.where("name = 'init' and coalesce(recv_type, '') = ''").select(F.lit("init").alias("kind"), F.col("fn_id").alias("function"), F.col("pkg_path").alias("package"), "file", "line")
    init = init.groupBy("kind", "package").agg(F.min(F.struct("function", "file", "line")).alias("m")).select("kind", "m.function", "package", "m.file", "m.line")
    target = spawn_target(F.col("target_kind"), F.col("target"), F.col("fn_id"))
    spawned = go_sites.select(target.alias("function"), F.col("pkg_path").alias("package"), "file", "line", "ord")
    spawned = spawned.groupBy("package", "function").agg(F.min_by(F.struct("file", "line"), "ord").alias("at")).select(F.lit("goroutine_start").alias("kind"), "function", "package", "at.file", "at.line")
    rows = main.dropDuplicates(["kind", "function"]).unionByName(init).unionByName(spawned)
    return rows.withColumn("anchor", anchor("file", "line", short_function_name("function")))


def seeds(functions: DataFrame, go_sites: DataFrame) -> DataFrame:
    """(id): where execution starts."""
    own = functions.where("(name = 'main' and pkg_name = 'main') or name = 'init'").select(F.col("fn_id").alias("id"))
    return own.unionByName(go_sites.where("target is not null and target <> ''").select(F.col("target").alias("id"))).distinct()


def candidates(functions: DataFrame, include_exported: bool = False) -> DataFrame:
    """Functions that can be dead: declared ones but main, init, closures and
    instances of generic ones."""
    rows = functions.where("coalesce(synthetic, '') = '' and coalesce(parent_fn, '') = '' and coalesce(origin_fn, '') = '' and name not in ('main', 'init', '_', '')")
    rows = rows.withColumn("exported", is_exported("name", "recv_type"))
    return rows if include_exported else rows.where(~F.col("exported"))


def dead_of(facts, include_exported: bool = False) -> DataFrame:
    """Dead functions of a fact set (dead())."""
    functions = facts.roots("functions")
    nodes = candidates(functions, include_exported).withColumnRenamed("fn_id", "id")
    edges = facts.call_edges().select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    # a closure runs where it stands: its function reaches it
    inner = functions.where("parent_fn <> ''").select(F.col("parent_fn").alias("src"), F.col("fn_id").alias("dst"))
    # a method whose name is called on something unknown may be what is called, and values of package variables are made first of all
    maybe = facts.open_methods().select(F.lit("?").alias("src"), F.col("fn_id").alias("dst"))
    first = functions.sparkSession.createDataFrame([("?",)], "id string").unionByName(facts.roots("calls").select(F.concat("pkg_path", F.lit(".init")).alias("id")).distinct())
    start = seeds(functions, facts.go_sites()).unionByName(first)
    return dead(nodes, edges.unionByName(inner).unionByName(maybe), start)


def dead(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """nodes (id, ...) with kind: unreferenced if nothing calls them, else
    unreachable_from_entrypoint if no path from start (id) leads to them. A
    function that only calls itself is referenced. edges (src, dst)."""
    called = edges.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    live = reach(edges, start).select("id", F.lit(True).alias("live"))
    rows = nodes.join(called, "id", "left").join(live, "id", "left")
    kind = F.when(F.col("called").isNull(), "unreferenced").when(F.col("live").isNull(), "unreachable_from_entrypoint")
    return rows.withColumn("kind", kind).where("kind is not null").drop("called", "live")
