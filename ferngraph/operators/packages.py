"""Package queries over packages (pkg_path, module_path, is_root, first_file)
and imports (pkg_path, import_path, import_module, file, line, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import anchor, is_stdlib, path_matches
from ferngraph.plans.graphs import reach, strong_components


def visible_imports(imports: DataFrame, packages: DataFrame, include_stdlib: bool) -> DataFrame:
    """Imports without the standard library's, unless asked for. A package is
    of it if it is no root, has no module and its first segment no dot."""
    if include_stdlib:
        return imports
    roots = packages.where("is_root").select(F.col("pkg_path").alias("import_path")).distinct()
    own = imports.where((F.coalesce("import_module", F.lit("")) != "") | ~is_stdlib("import_path"))
    rest = imports.where((F.coalesce("import_module", F.lit("")) == "") & is_stdlib("import_path"))
    return own.unionByName(rest.join(roots, "import_path", "left_semi").select(*own.columns))


def dependencies(packages: DataFrame, imports: DataFrame, include_stdlib: bool = True) -> DataFrame:
    """(package, imports, file, line, anchor): every root package with its
    distinct imports, sorted; packages without any keep an empty array."""
    seen = visible_imports(imports, packages, include_stdlib).groupBy("pkg_path").agg(F.sort_array(F.collect_set("import_path")).alias("imports"))
    rows = packages.where("is_root").join(seen, "pkg_path", "left")
    line = F.when(F.coalesce("first_file", F.lit("")) == "", 0).otherwise(1)
    return rows.select(F.col("pkg_path").alias("package"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"), F.coalesce("first_file", F.lit("")).alias("file"), line.alias("line")).withColumn("anchor", anchor("file", "line", "package"))


def dependency_summary(packages: DataFrame, imports: DataFrame, include_stdlib: bool = True) -> DataFrame:
    """(package, n_imports) of every root package."""
    return dependencies(packages, imports, include_stdlib).select("package", F.size("imports").cast("long").alias("n_imports"))


def import_locations(imports: DataFrame) -> DataFrame:
    """Where each package imports another: its last place, by ord."""
    return imports.groupBy("pkg_path", "import_path").agg(F.max_by(F.struct("file", "line"), "ord").alias("at")).select("pkg_path", "import_path", "at.file", "at.line")


def direct_dependents(imports: DataFrame, target: str) -> DataFrame:
    """(package): importers of the target; none if it isn't known."""
    return imports.where(F.col("import_path") == target).select(F.col("pkg_path").alias("package")).distinct()


def transitive_dependents(imports: DataFrame, target: str) -> DataFrame:
    """(package): what reaches the target over more than one import. Direct
    importers are left out; in a cycle the target itself may be among them."""
    back = imports.select(F.col("import_path").alias("src"), F.col("pkg_path").alias("dst"))
    direct = direct_dependents(imports, target)
    closure = reach(back, direct.select(F.col("package").alias("id")))
    return closure.select(F.col("id").alias("package")).join(direct, "package", "left_anti")


def all_packages(packages: DataFrame, imports: DataFrame) -> DataFrame:
    """(pkg_path): the roots and all they import, directly or not."""
    roots = packages.where("is_root").select(F.col("pkg_path").alias("id"))
    return reach(imports.select(F.col("pkg_path").alias("src"), F.col("import_path").alias("dst")), roots).select(F.col("id").alias("pkg_path"))


def import_cycles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(size, members): strongly connected components of two or more, members
    sorted. Edges (src, dst) to nodes that aren't known are skipped; a node that
    imports itself is no cycle. Order by size, then the first member."""
    if nodes is not None:
        for end in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    parts = strong_components(edges).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return parts.where(F.size("members") >= 2).select(F.size("members").alias("size"), "members")


def violations(imports: DataFrame, packages: DataFrame, rules: DataFrame) -> DataFrame:
    """(from, to, import, rule, file, line) for rules (type, from, to): forbid
    reports imports that match `to`; allow_only and allow_prefix report imports
    of known packages that don't, the latter matching any path that starts so.
    Rules are configuration, so they are the broadcast side."""
    r = F.broadcast(rules.select(F.col("type").alias("rule"), F.col("from").alias("rule_from"), F.col("to").alias("to")))
    rows = import_locations(imports).join(r, path_matches("pkg_path", "rule_from"))
    match = F.when(F.col("rule") == "allow_prefix", F.col("import_path").startswith(F.col("to"))).otherwise(path_matches("import_path", "to"))
    rows = rows.withColumn("match", match)
    known = packages.where("is_root").select(F.col("pkg_path").alias("import_path")).distinct()
    forbidden = rows.where((F.col("rule") == "forbid") & F.col("match"))
    outside = rows.where(F.col("rule").isin("allow_only", "allow_prefix") & ~F.col("match")).join(known, "import_path", "left_semi")
    every = forbidden.unionByName(outside)
    out = every.select(F.col("pkg_path").alias("from"), "to", F.col("import_path").alias("import"), "rule", "file", "line")
    return out.withColumn("anchor", anchor("file", "line", "from"))


def violation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))
