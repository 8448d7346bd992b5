"""The registered queries over the driver's tables, each with the same question
in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.operators import calls, delivery, liveness, metrics, packages, state, surfaces, types
from ferngraph.plans import bindings as b
from ferngraph.plans.bindings import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

GRAPH = """g AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
ROOT = "r AS (SELECT src AS id FROM g GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
SINK = "s AS (SELECT dst AS id FROM g GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
CALLS = """c AS (
  SELECT g.src AS caller, g.dst AS callee,
    CASE p_size % 3 WHEN 0 THEN 'Static' WHEN 1 THEN 'Interface' ELSE 'Goroutine' END AS call_type
  FROM g JOIN part ON p_partkey = g.dst)"""
PACKAGES = "k AS (SELECT p_brand || '/' || p_type AS pkg_path, min(p_name) AS first_file FROM part GROUP BY 1)"
IMPORTS = """i AS (
  SELECT DISTINCT a.p_brand || '/' || a.p_type AS pkg_path, b.p_brand || '/' || b.p_type AS import_path
  FROM g JOIN part a ON a.p_partkey = g.src JOIN part b ON b.p_partkey = g.dst
  WHERE a.p_brand || '/' || a.p_type <> b.p_brand || '/' || b.p_type)"""
METRICS = """m AS (
  SELECT *, round(least(greatest((171 - 5.2 * ln(greatest(volume, 1)) - 0.23 * cyclomatic - 16.2 * ln(greatest(body_lines, 1))) * 100 / 171, 0), 100) * 100) / 100 AS maintainability,
    volume / 10 AS difficulty, volume * 2 AS effort
  FROM (SELECT p_partkey AS "function", p_brand AS package, coalesce(o, 0) + 1 AS cyclomatic, coalesce(n, 0) AS cognitive,
      CAST(p_size % 7 AS BIGINT) AS max_nesting, CAST(p_size AS BIGINT) AS body_lines, p_retailprice AS volume
    FROM part LEFT JOIN (SELECT src, count(*) AS o FROM g GROUP BY 1) x ON src = p_partkey
      LEFT JOIN (SELECT dst, count(*) AS n FROM g GROUP BY 1) y ON dst = p_partkey))"""
TOKENS = f"""t AS (
  SELECT conv_id AS fn_id, token, count(*) AS cnt, token IN ({", ".join(f"'{w}'" for w in b.STOP_WORDS)}) AS op
  FROM (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS token FROM conversations) WHERE token <> '' GROUP BY 1, 2)"""
HALSTEAD = """h AS (
  SELECT fn_id, count(*) FILTER (op) AS n1, count(*) FILTER (NOT op) AS n2,
    CAST(coalesce(sum(cnt) FILTER (op), 0) AS BIGINT) AS t1, CAST(coalesce(sum(cnt) FILTER (NOT op), 0) AS BIGINT) AS t2 FROM t GROUP BY 1)"""
HOPS = """e AS (
  SELECT event_id, ts, user_id AS "function", event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS field
  FROM events WHERE event_type <> 'view')"""
SPAWNS = """p AS (
  SELECT user_id FROM (SELECT user_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1
  HAVING coalesce(bool_or(t = 'signup' AND k < 3), false) OR (coalesce(bool_or(t = 'view' AND k < 15), false) AND coalesce(bool_or(t = 'click' AND k < 15), false)))"""
LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS arg0 FROM pages)"""


def query(sql: str, name: str = ""):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def _with(*parts: str, recursive: bool = False) -> str:
    *ctes, last = parts
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)} {last}"


# call graph


def _levels(depth: int, at: str = "src", to: str = "dst", start: str = "r") -> str:
    return f"""w AS (
  SELECT g.src, g.dst, 1 AS depth FROM g JOIN {start} ON g.{at} = {start}.id
  UNION SELECT g.src, g.dst, w.depth + 1 FROM w JOIN g ON g.{at} = w.{to} WHERE w.depth < {depth})"""


def _hierarchy_sql(depth: int) -> str:
    return _with(GRAPH, ROOT, _levels(depth), CALLS, "SELECT caller, callee, call_type, CAST(min(depth) AS INTEGER) AS depth FROM w JOIN c ON c.caller = w.src AND c.callee = w.dst GROUP BY 1, 2, 3", recursive=True)


def _callers_sql(depth: int) -> str:
    return _with(GRAPH, SINK, _levels(depth, "dst", "src", "s"), CALLS, "SELECT caller, callee, call_type, CAST(min(depth) AS INTEGER) AS depth FROM w JOIN c ON c.caller = w.src AND c.callee = w.dst GROUP BY 1, 2, 3", recursive=True)


def _hierarchy(spark, sf_dir, depth):
    c = b.calls(spark, sf_dir)
    return calls.hierarchy(c, b.root(c.select(F.col("caller").alias("src"))), depth)


def _callers(spark, sf_dir, depth):
    c = b.calls(spark, sf_dir)
    return calls.callers(c, b.root(c.select(F.col("callee").alias("src"))), depth)


for _name, _asked, _used in (("call_hierarchy_d3", 3, 3), ("call_hierarchy_d1", 1, 1), ("call_hierarchy_reset_depth", 9, 3)):
    query(_hierarchy_sql(_used), _name)(lambda s, d, n=_asked: _hierarchy(s, d, n))
for _name, _asked, _used in (("callers_d3", 3, 3), ("callers_d8", 8, 8), ("callers_reset_depth", 9, 3)):
    query(_callers_sql(_used), _name)(lambda s, d, n=_asked: _callers(s, d, n))


SITES = """c AS (
  SELECT a.l_partkey AS caller, b.l_partkey AS callee, min(a.l_orderkey * 10 + b.l_linenumber) AS site_ord FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""


@query(_with(GRAPH, ROOT, _levels(3), SITES, "SELECT caller, callee, site_ord, CAST(min(depth) AS INTEGER) AS depth FROM w JOIN c ON c.caller = w.src AND c.callee = w.dst GROUP BY 1, 2, 3", recursive=True))
def call_hierarchy_sites(spark, sf_dir):
    c = b.sites(spark, sf_dir)
    return calls.hierarchy(c, b.root(c.select(F.col("caller").alias("src"), "callee").distinct()), 3)


@query(_with(GRAPH, ROOT, _levels(3), CALLS, "SELECT call_type AS key, count(DISTINCT (caller, callee)) AS n FROM w JOIN c ON c.caller = w.src AND c.callee = w.dst GROUP BY 1", recursive=True))
def hierarchy_summary_by_type(spark, sf_dir):
    return calls.summary(_hierarchy(spark, sf_dir, 3), "call_type")


@query(_with(GRAPH, CALLS, """SELECT CASE WHEN grouping(call_type) = 0 THEN 'call_type' WHEN grouping(caller) = 0 THEN 'caller' WHEN grouping(callee) = 0 THEN 'callee' ELSE 'total' END AS kind,
  coalesce(CAST(call_type AS VARCHAR), CAST(caller AS VARCHAR), CAST(callee AS VARCHAR), '') AS key, count(*) AS n FROM c GROUP BY GROUPING SETS ((call_type), (caller), (callee), ())"""))
def call_summary_all(spark, sf_dir):
    return calls.full_summary(b.calls(spark, sf_dir))


@query(_with(GRAPH, ROOT, _levels(3), "SELECT src AS caller, dst AS callee, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 10 OFFSET 5", recursive=True))
def hierarchy_window(spark, sf_dir):
    rows = _hierarchy(spark, sf_dir, 3).select("caller", "callee", "depth")
    return delivery.window(rows, [F.col(c) for c in calls.EDGE_ORDER], delivery.Options(offset=5, limit=10))


def _paths_sql(depth: int, most: int) -> str:
    return _with(GRAPH, ROOT, "z AS (SELECT max(dst) AS id FROM g JOIN r ON r.id <> dst WHERE dst IN (SELECT b.dst FROM g a JOIN g b ON b.src = a.dst JOIN r ON a.src = r.id))", f"""w AS (
  SELECT g.src, g.dst AS at, [g.src, g.dst] AS path, 1 AS length FROM g JOIN r ON g.src = r.id
  UNION ALL SELECT w.src, g.dst, list_append(path, g.dst), length + 1 FROM w JOIN g ON g.src = w.at, z
  WHERE length < {depth} AND w.at <> z.id AND NOT list_contains(path, g.dst))""", f"SELECT CAST(length AS INTEGER) AS length, array_to_string(path, '>') AS path FROM (SELECT * FROM w, z WHERE w.at = z.id ORDER BY length, w.path LIMIT {most})", recursive=True)


def _paths(spark, sf_dir, depth, most):
    c = b.graph(spark, sf_dir).withColumnsRenamed({"src": "caller", "dst": "callee"})
    start = b.root(c.select(F.col("caller").alias("src")))
    one = c.join(start.select(F.col("id").alias("caller")), "caller").select(F.col("callee").alias("caller"))
    two = one.join(c, "caller").select(F.col("callee").alias("id")).join(start, "id", "left_anti")
    target = two.agg(F.max("id").alias("id"))
    found = calls.paths(c, start, target, depth, most)
    return found.select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


for _name, _depth, _most in (("call_paths_d4", 4, 100), ("call_paths_d3", 3, 20), ("call_paths_shortest", 3, 1)):
    query(_paths_sql(_depth, _most), _name)(lambda s, d, n=_depth, m=_most: _paths(s, d, n, m))

REACH = "q AS (SELECT id FROM r UNION SELECT g.dst FROM q JOIN g ON g.src = q.id)"


@query(_with(GRAPH, ROOT, REACH, "SELECT id FROM q", recursive=True))
def reachable_closure(spark, sf_dir):
    c = b.calls(spark, sf_dir)
    return calls.reachable(c, b.root(c.select(F.col("caller").alias("src")))).select("id")


# liveness

SEEDS = "r AS (SELECT p_partkey AS id FROM part WHERE p_size = 1)"


def _dead(spark, sf_dir, exported=True):
    g, part = b.graph(spark, sf_dir), table(spark, sf_dir, "part")
    nodes = part.where("p_size <> 1").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"), (F.col("p_size") % 2 == 0).alias("exported"))
    nodes = nodes if exported else nodes.where("not exported")
    return liveness.dead(nodes, g, part.where("p_size = 1").select(F.col("p_partkey").alias("id")))


def _dead_sql(where: str) -> str:
    return _with(GRAPH, SEEDS, REACH, f"""SELECT kind, id, package, exported FROM (SELECT p_partkey AS id, p_brand AS package, p_size % 2 = 0 AS exported,
    CASE WHEN p_partkey NOT IN (SELECT dst FROM g) THEN 'unreferenced' WHEN p_partkey NOT IN (SELECT id FROM q) THEN 'unreachable_from_entrypoint' END AS kind
  FROM part WHERE p_size <> 1) WHERE {where}""", recursive=True)


@query(_dead_sql("kind = 'unreferenced' AND NOT exported"))
def dead_unreferenced(spark, sf_dir):
    return _dead(spark, sf_dir, False).where("kind = 'unreferenced'")


@query(_dead_sql("kind = 'unreachable_from_entrypoint' AND NOT exported"))
def dead_unreachable(spark, sf_dir):
    return _dead(spark, sf_dir, False).where("kind = 'unreachable_from_entrypoint'")


@query(_dead_sql("kind IS NOT NULL"))
def dead_include_exported(spark, sf_dir):
    return _dead(spark, sf_dir)


@query("""WITH p AS (SELECT p_brand, p_type, p_size, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS k, p_partkey FROM part)
SELECT 'init' AS kind, p_brand AS package, min(k) AS "function", CAST(min(p_partkey) AS INTEGER) AS line FROM p WHERE p_size = 2 GROUP BY 2
UNION ALL SELECT 'main', p_brand, k, CAST(p_partkey AS INTEGER) FROM p WHERE p_size = 1
UNION ALL SELECT 'goroutine_start', p_brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '<dynamic in ' || k || '>' END, CAST(min(p_partkey) AS INTEGER) FROM p WHERE p_size BETWEEN 3 AND 6 GROUP BY 2, 3""")
def entrypoints(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fn = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    line = F.col("p_partkey").cast("int").alias("line")
    name = F.when(F.col("p_size") == 1, "main").when(F.col("p_size") == 2, "init").otherwise("f")
    functions = part.select(fn.alias("fn_id"), name.alias("name"), F.col("p_brand").alias("pkg_path"), F.lit("main").alias("pkg_name"), F.lit("").alias("recv_type"), F.lit("").alias("file"), line)
    static = F.col("p_size") % 2 == 0
    sites = part.where("p_size between 3 and 6").select(fn.alias("fn_id"), F.col("p_brand").alias("pkg_path"), F.when(static, F.col("p_type")).alias("target"), F.when(static, "static").otherwise("dynamic").alias("target_kind"), F.lit("").alias("file"), line, F.col("p_partkey").alias("ord"))
    return liveness.entrypoints(functions, sites).select("kind", "package", "function", "line")


# packages


@query(_with(GRAPH, PACKAGES, IMPORTS, "SELECT k.pkg_path AS package, first_file AS file, coalesce(string_agg(import_path, ',' ORDER BY import_path), '') AS imports FROM k LEFT JOIN i USING (pkg_path) GROUP BY 1, 2"))
def deps_list(spark, sf_dir):
    rows = packages.dependencies(b.packages(spark, sf_dir), b.imports(spark, sf_dir))
    return rows.select("package", "file", F.array_join("imports", ",").alias("imports"))


@query(_with(GRAPH, PACKAGES, IMPORTS, "SELECT k.pkg_path AS package, count(import_path) AS n_imports FROM k LEFT JOIN (SELECT * FROM i WHERE import_path LIKE '%.%' OR import_path IN (SELECT pkg_path FROM k WHERE pkg_path LIKE '%BRASS%' OR pkg_path LIKE '%STEEL%' OR pkg_path LIKE 'Brand#1%')) USING (pkg_path) WHERE pkg_path LIKE '%BRASS%' OR pkg_path LIKE '%STEEL%' OR pkg_path LIKE 'Brand#1%' GROUP BY 1"))
def deps_exclude_stdlib(spark, sf_dir):
    own = F.col("pkg_path").contains("BRASS") | F.col("pkg_path").contains("STEEL") | F.col("pkg_path").startswith("Brand#1")
    pk = b.packages(spark, sf_dir).withColumn("is_root", own)
    return packages.dependency_summary(pk, b.imports(spark, sf_dir), include_stdlib=False)


@query(_with(GRAPH, PACKAGES, IMPORTS, "SELECT k.pkg_path AS package, count(import_path) AS n_imports FROM k LEFT JOIN i USING (pkg_path) GROUP BY 1"))
def deps_summary(spark, sf_dir):
    return packages.dependency_summary(b.packages(spark, sf_dir), b.imports(spark, sf_dir))


TARGET = "Brand#11/STANDARD"
DIRECT = f"d AS (SELECT DISTINCT pkg_path AS package FROM i WHERE import_path = '{TARGET}')"


@query(_with(GRAPH, IMPORTS, DIRECT, "SELECT package FROM d"))
def revdeps_direct(spark, sf_dir):
    return packages.direct_dependents(b.imports(spark, sf_dir), TARGET)


@query(_with(GRAPH, IMPORTS, DIRECT, "q AS (SELECT package FROM d UNION SELECT i.pkg_path FROM q JOIN i ON i.import_path = q.package)", "SELECT package FROM q WHERE package NOT IN (SELECT package FROM d)", recursive=True))
def revdeps_transitive(spark, sf_dir):
    return packages.transitive_dependents(b.imports(spark, sf_dir), TARGET)


CYCLES = """v AS (SELECT src AS a, dst AS z FROM g UNION SELECT v.a, g.dst FROM v JOIN g ON g.src = v.z),
  mutual AS (SELECT DISTINCT x.a, x.z FROM v x JOIN v y ON x.a = y.z AND x.z = y.a),
  comp AS (SELECT a, least(a, min(z)) AS c FROM mutual GROUP BY 1)"""
CYCLES_LAST = "SELECT CAST(count(*) AS INTEGER) AS size, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS members FROM comp GROUP BY c HAVING count(*) >= 2"


def _cycles(g):
    return packages.import_cycles(g).select("size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(_with(GRAPH, CYCLES, CYCLES_LAST, recursive=True))
def import_cycles(spark, sf_dir):
    return _cycles(b.graph(spark, sf_dir))


FIRST = """g AS (
  SELECT a.l_partkey AS src, min({'o': a.l_orderkey * 10 + b.l_linenumber, 'd': b.l_partkey}).d AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1)"""


@query(_with(FIRST, CYCLES, CYCLES_LAST, recursive=True))
def import_cycles_sparse(spark, sf_dir):
    return _cycles(b.first_graph(spark, sf_dir))


RULES = {"forbid": ("Brand#1/", "Brand#2/"), "allow_only": ("Brand#3/", "Brand#4/"), "allow_prefix": ("Brand#5/", "Brand#1")}


def _rules(spark, *kinds):
    return spark.createDataFrame([(k, *RULES[k]) for k in kinds], "type string, `from` string, `to` string")


def _violations(spark, sf_dir, *kinds):
    return packages.violations(b.imports(spark, sf_dir), b.packages(spark, sf_dir), _rules(spark, *kinds)).select("from", "to", "import", "rule")


def _violation_sql(kind: str) -> str:
    frm, to = RULES[kind]
    match = {"forbid": f"starts_with(import_path, '{to}')", "allow_only": f"NOT starts_with(import_path, '{to}')", "allow_prefix": f"NOT starts_with(import_path, '{to}')"}[kind]
    return f"""SELECT pkg_path AS "from", '{to}' AS "to", import_path AS "import", '{kind}' AS rule FROM i WHERE starts_with(pkg_path, '{frm}') AND {match}"""


for _kind in RULES:
    query(_with(GRAPH, IMPORTS, _violation_sql(_kind)), f"boundary_{_kind}")(lambda s, d, k=_kind: _violations(s, d, k))


@query(_with(GRAPH, IMPORTS, "SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(map(_violation_sql, RULES)) + ") GROUP BY 1"))
def boundary_counts(spark, sf_dir):
    return packages.violation_counts(_violations(spark, sf_dir, *RULES))


# types


def _topology(spark, sf_dir, methods):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = rows.select(F.lit("").alias("pkg_path"), F.col("o_custkey").alias("type_name"), F.lit("value").alias("recv_kind"), F.col("p_type").alias("method"), F.lit("").alias("sig")).distinct()
    kinds = sets.select("pkg_path", "type_name", F.lit("struct").alias("kind")).distinct()
    need = spark.createDataFrame([(m, "") for m in methods], "method string, sig string")
    return types.implementors(kinds, sets, need).select(F.col("type_name").alias("struct"))


HAS = "x AS (SELECT DISTINCT o_custkey AS struct, p_type AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


@query(_with(HAS, "SELECT struct FROM x WHERE m IN ('ECONOMY', 'STANDARD') GROUP BY 1 HAVING count(*) = 2"))
def interface_topology(spark, sf_dir):
    return _topology(spark, sf_dir, ["ECONOMY", "STANDARD"])


@query(_with(HAS, "SELECT DISTINCT struct FROM x"))
def interface_empty(spark, sf_dir):
    return _topology(spark, sf_dir, [])


# metrics


def _duplicates(spark, sf_dir, least):
    groups = metrics.duplicate_groups(metrics.fingerprints(b.bodies(spark, sf_dir)), least)
    where = F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["package"], x["function"].cast("string"))), ",")
    return groups.select("signature", "body_hash", F.col("body_lines").cast("long").alias("body_lines"), "count", where.alias("locations"))


def _duplicates_sql(least: int) -> str:
    return f"""WITH d AS (SELECT doc_id, source, lang, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS h, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> '')
SELECT lang AS signature, h AS body_hash, CAST(max(n) AS BIGINT) AS body_lines, count(*) AS "count", string_agg(source || ':' || doc_id, ',' ORDER BY source, doc_id) AS locations FROM d WHERE n >= {least} GROUP BY 1, 2 HAVING count(*) >= 2"""


for _name, _asked, _used in (("duplicates", 0, 3), ("duplicates_min_lines", 10, 10)):
    query(_duplicates_sql(_used), _name)(lambda s, d, n=_asked: _duplicates(s, d, n))


@query(_with(GRAPH, METRICS, 'SELECT "function", package, cyclomatic, cognitive, volume, maintainability FROM m WHERE cyclomatic >= 2 AND cognitive >= 1 AND volume >= 950 AND maintainability <= 75'))
def complexity_filter(spark, sf_dir):
    rows = metrics.complexity_filter(b.metrics(spark, sf_dir), 2, 1, 950, 75)
    return rows.select("function", "package", "cyclomatic", "cognitive", "volume", "maintainability")


def _sort_sql(mode: str) -> str:
    name, up = metrics.SORTS[mode]
    order = f'"{name}" {"ASC" if up else "DESC"}' + ("" if mode == "name" else ', cognitive DESC, cyclomatic DESC, body_lines DESC, "function"')
    return _with(GRAPH, METRICS, f'SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, "function" FROM m QUALIFY place <= 20')


def _top(spark, sf_dir, mode):
    from pyspark.sql import Window

    order = metrics.complexity_order(mode)
    top = b.metrics(spark, sf_dir).orderBy(*order).limit(20)  # numbered after the cut: twenty rows
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "function")


for _mode in metrics.SORTS:
    query(_sort_sql(_mode), f"complexity_top_{_mode}")(lambda s, d, m=_mode: _top(s, d, m))


@query(_with(GRAPH, METRICS, """SELECT package, count(*) AS functions, CAST(sum(cyclomatic) AS BIGINT) AS total_cyclomatic, CAST(sum(cognitive) AS BIGINT) AS total_cognitive, max(cyclomatic) AS max_cyclomatic, max(cognitive) AS max_cognitive, avg(cyclomatic) AS average_cyclomatic, avg(cognitive) AS average_cognitive,
  round(CAST(sum(CAST(volume AS DECIMAL(20,2))) AS DOUBLE) * 100) / 100 AS total_volume, round(CAST(sum(CAST(volume AS DECIMAL(20,2))) AS DOUBLE) / count(*) * 100) / 100 AS average_volume, round(CAST(sum(CAST(maintainability AS DECIMAL(20,2))) AS DOUBLE) / count(*) * 100) / 100 AS average_maintainability,
  arg_max("function", (cognitive, cyclomatic, -"function")) AS max_function, max(volume) AS max_volume, arg_max("function", (volume, -"function")) AS max_halstead_function,
  min(maintainability) AS min_maintainability, arg_min("function", (maintainability, "function")) AS min_maintainability_function FROM m GROUP BY 1"""))
def complexity_rollup(spark, sf_dir):
    rows = b.metrics(spark, sf_dir)
    out = metrics.rollup(rows).withColumn("max_halstead_function", F.col("max_halstead_function").cast("long"))
    return out.select("package", "functions", "total_cyclomatic", "total_cognitive", "max_cyclomatic", "max_cognitive", "average_cyclomatic", "average_cognitive", "total_volume", "average_volume", "average_maintainability", "max_function", "max_volume", "max_halstead_function", "min_maintainability", "min_maintainability_function")


@query(_with(TOKENS, HALSTEAD, """SELECT fn_id, n1, n2, t1, t2, round(coalesce(CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2(n1 + n2) END, 0) * 100) / 100 AS volume,
  round(CASE WHEN n2 > 0 THEN (n1 / 2.0) * (CAST(t2 AS DOUBLE) / n2) ELSE 0 END * 100) / 100 AS difficulty,
  round(round(coalesce(CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2(n1 + n2) END, 0) * CASE WHEN n2 > 0 THEN (n1 / 2.0) * (CAST(t2 AS DOUBLE) / n2) ELSE 0 END * 100) / 100, 1) AS effort FROM h"""))
def halstead(spark, sf_dir):
    rows = metrics.halstead(metrics.halstead_counts(b.tokens(spark, sf_dir)))
    return rows.withColumn("effort", F.round("effort", 1))


@query(_with(GRAPH, METRICS, 'SELECT "function", maintainability FROM m'))
def maintainability(spark, sf_dir):
    return b.metrics(spark, sf_dir).select("function", "maintainability")


# surfaces


def _route_calls(spark, sf_dir):
    link = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("arg0"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    n = F.length("arg0")
    return link.select(
        "page_id", F.concat(F.lit('"'), "arg0", F.lit('"')).alias("arg0"), pick(SELECTORS, F.col("page_id")).alias("sel_name"), pick(RECEIVERS, n).alias("recv_ident"), pick(RECEIVER_PACKAGES, F.col("page_id")).alias("recv_pkg"),
        (n % 3 + 1).alias("n_args"), F.lit(True).alias("arg0_is_string"), pick(("ident", "func_lit", "call"), n).alias("arg1_kind"), F.lit("h").alias("arg1_name"), F.lit("").alias("file"), F.lit(0).alias("line"),
    )


SELECTORS, RECEIVERS = ("HandleFunc", "GET", "Post", "Any", "Close", "All"), ("http", "myMux", "r", "apiRouter")
RECEIVER_PACKAGES = ("", "net/http", "github.com/go-chi/chi/v5", "", "example.com/x", "", "github.com/fasthttp/router")
ROUTE_SQL = f"""calls AS (SELECT page_id, arg0 AS path, {list(SELECTORS)}[page_id % 6 + 1] AS sel, {list(RECEIVERS)}[length(arg0) % 4 + 1] AS recv, {list(RECEIVER_PACKAGES)}[page_id % 7 + 1] AS pkg, length(arg0) AS n FROM l),
routes AS (SELECT page_id, path, CASE sel WHEN 'HandleFunc' THEN 'ANY' WHEN 'Post' THEN 'POST' WHEN 'Any' THEN 'ANY' WHEN 'All' THEN 'ANY' ELSE sel END AS method,
  CASE n % 3 WHEN 0 THEN 'h' WHEN 1 THEN '<inline>' ELSE '<unknown>' END AS handler,
  CASE WHEN pkg = 'net/http' THEN 'net/http' WHEN pkg LIKE 'github.com/go-chi/chi%' THEN 'chi' WHEN pkg LIKE 'github.com/fasthttp/router%' THEN 'fasthttp'
    WHEN sel = 'HandleFunc' THEN CASE WHEN recv IN ('myMux', 'apiRouter') THEN 'gorilla/mux' ELSE 'net/http' END
    WHEN sel = 'All' THEN 'fiber' WHEN sel = 'Any' THEN 'echo' WHEN sel = 'GET' THEN 'gin' WHEN sel = 'Post' THEN 'chi' ELSE 'unknown' END AS framework
  FROM calls WHERE sel <> 'Close' AND n % 3 + 1 >= 2)"""


@query(_with(LINKS, ROUTE_SQL, "SELECT method, path, handler, framework FROM routes"))
def routes(spark, sf_dir):
    return surfaces.routes(_route_calls(spark, sf_dir)).select("method", "path", "handler", "framework")


@query(_with(LINKS, ROUTE_SQL, "SELECT framework, method, count(*) AS n FROM routes GROUP BY 1, 2"))
def route_frameworks(spark, sf_dir):
    return surfaces.routes(_route_calls(spark, sf_dir)).groupBy("framework", "method").agg(F.count("*").alias("n"))


def _grpc(spark, sf_dir):
    """Services are suppliers, named nation.supplier; methods the part types
    they supply; registrations all order lines."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("v"), F.col("s_suppkey").cast("string"), F.lit("."), F.col("n_name"))
    services = s.select(F.col("s_suppkey").cast("string").alias("pkg_path"), F.lit("D").alias("desc_name"), name.alias("service"))
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    methods = parts.groupBy(F.col("l_suppkey").cast("string").alias("pkg_path"), F.col("p_type").alias("method")).agg((F.max("p_size") % 2 == 0).alias("server_streams"), (F.min("p_size") % 2 == 0).alias("client_streams"))
    methods = methods.withColumn("desc_name", F.lit("D"))
    funcs = services.select("pkg_path", F.concat(F.lit("Register"), "pkg_path", F.lit("Server")).alias("func_name"), "desc_name")
    by = F.col("l_suppkey").cast("string")
    calls_ = lines.select(
        F.when(F.col("l_quantity") > 25, by).otherwise("").alias("callee_pkg"), F.concat(F.lit("Register"), by, F.lit("Server")).alias("callee_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("&srv"), (F.col("l_partkey") % 4).cast("string")).alias("implementation"),
    )
    return services, methods, surfaces.registrations(calls_, funcs, services)


GRPC = """sv AS (SELECT s_suppkey, 'v' || s_suppkey || '.' || n_name AS service, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
rg AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS ord, '&srv' || (l_partkey % 4) AS impl FROM lineitem),
im AS (SELECT service, n_name, string_agg(impl, ',' ORDER BY o, impl) AS impls FROM (SELECT service, n_name, impl, min(ord) AS o FROM sv JOIN rg ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) GROUP BY 1, 2),
mt AS (SELECT l_suppkey, p_type AS method, max(p_size) % 2 = 0 AS ss, min(p_size) % 2 = 0 AS cs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
un AS (SELECT n_name, max(impls) AS impls FROM im WHERE n_name IN (SELECT n_name FROM sv GROUP BY 1 HAVING count(*) = 1) GROUP BY 1 HAVING count(*) = 1),
ep AS (SELECT sv.service, method, CASE WHEN ss AND cs THEN 'bidi_stream' WHEN ss THEN 'server_stream' WHEN cs THEN 'client_stream' ELSE 'unary' END AS rpc_type,
  '/' || sv.service || '/' || method AS full_method, coalesce(im.impls, un.impls, '') AS implementations
  FROM sv JOIN mt ON l_suppkey = s_suppkey LEFT JOIN im ON im.service = sv.service LEFT JOIN un ON un.n_name = sv.n_name)"""


def _endpoints(spark, sf_dir):
    services, methods, regs = _grpc(spark, sf_dir)
    rows = surfaces.endpoints(services, methods, surfaces.implementations(regs))
    return rows.withColumn("implementations", F.array_join("implementations", ","))


@query(_with(GRPC, "SELECT *, implementations <> '' AS registered FROM ep"))
def grpc_endpoints(spark, sf_dir):
    return _endpoints(spark, sf_dir)


@query(_with(GRPC, "SELECT service, impl AS implementation, count(*) AS n FROM rg JOIN sv ON l_suppkey = s_suppkey GROUP BY 1, 2"))
def grpc_registrations(spark, sf_dir):
    return _grpc(spark, sf_dir)[2].groupBy("service", "implementation").agg(F.count("*").alias("n"))


@query(_with(GRPC, """SELECT * FROM (SELECT 'endpoint' AS kind, service, full_method AS name FROM ep UNION ALL SELECT DISTINCT 'registration', service, impl FROM rg JOIN sv ON l_suppkey = s_suppkey)
  ORDER BY kind, service, name LIMIT 25 OFFSET 10"""))
def grpc_union_page(spark, sf_dir):
    services, methods, regs = _grpc(spark, sf_dir)
    ends = surfaces.endpoints(services, methods, surfaces.implementations(regs)).select(F.lit("endpoint").alias("kind"), "service", F.col("full_method").alias("name"))
    every = ends.unionByName(regs.select(F.lit("registration").alias("kind"), "service", F.col("implementation").alias("name")).distinct())
    return delivery.window(every, [F.col(c) for c in ("kind", "service", "name")], delivery.Options(offset=10, limit=25))


# state


def _events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("function"), F.col("event_type").alias("kind"), k.alias("field"))


def _hops(spark, sf_dir, mode):
    return state.dedupe(_events(spark, sf_dir).where("kind <> 'view'"), mode, ("ts", "event_id"))


for _mode, _keys in (("none", "event_id"), ("function_field", '"function", field'), ("function_kind_field", '"function", kind, field')):
    query(_with(HOPS, f'SELECT event_id, "function", kind, field FROM e QUALIFY row_number() OVER (PARTITION BY {_keys} ORDER BY ts, event_id) = 1'), f"lifecycle_{_mode}")(lambda s, d, m=_mode: _hops(s, d, m).select("event_id", "function", "kind", "field"))


@query(_with(HOPS, """SELECT 'kind' AS what, kind AS key, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'function', CAST("function" AS VARCHAR), count(*) FROM e GROUP BY 2
  UNION ALL SELECT 'field', CAST(field AS VARCHAR), count(*) FROM e WHERE field IS NOT NULL GROUP BY 2"""))
def lifecycle_summary(spark, sf_dir):
    return state.hop_summary(_hops(spark, sf_dir, "none"))


@query(_with(SPAWNS, "SELECT 'High' AS risk_level, e.user_id AS \"function\", e.event_id AS line FROM events e JOIN (SELECT user_id FROM events WHERE event_type = 'purchase') s ON s.user_id = e.user_id WHERE e.event_type = 'click' AND e.user_id NOT IN (SELECT user_id FROM p)"))
def risks(spark, sf_dir):
    e = _events(spark, sf_dir)
    guard = e.select(F.col("function").alias("fn_id"), F.expr("kind = 'signup' and field < 3").alias("is_atomic"), F.expr("kind = 'view' and field < 15").alias("is_lock"), F.expr("kind = 'click' and field < 15").alias("is_unlock"))
    sites = e.where("kind = 'purchase'").select(F.col("function").alias("target"))
    stores = e.where("kind = 'click'").select(F.col("function").alias("fn_id"), F.lit("S").alias("struct"), F.lit("f").alias("field"), F.lit("").alias("file"), F.col("event_id").alias("line"))
    return state.risks(sites, stores, state.protected(guard)).select("risk_level", "function", "line")


# delivery


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 15 OFFSET 30")
def page_offset_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return delivery.window(rows, [F.col("p_name"), F.col("p_partkey")], delivery.Options(offset=30, limit=40, max_items=15))


@query("SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 120) ORDER BY p_partkey LIMIT 50 OFFSET 50")
def cursor_chunk(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey")
    o = delivery.Options(chunk_size=80, max_items=120)
    first = delivery.deliver(rows, ["p_partkey"], "parts", F.col("p_partkey").cast("string"), o)
    second = delivery.deliver(rows, ["p_partkey"], "parts", F.col("p_partkey").cast("string"), delivery.Options(chunk_size=80, max_items=120, cursor=first.next_cursor))
    return spark.createDataFrame(second.rows, rows.schema)


@query("""SELECT n AS page, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS r, count(*) OVER () AS total FROM lineitem),
  (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS n) WHERE r >= n * (total // 3) AND r < n * (total // 3) + 40""")
def pages_by_key(spark, sf_dir):
    """Pages from the start, a third and two thirds of all lines, whose first key is one of three."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    held = delivery.Order(lines, ["l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], F.col("l_orderkey").cast("string"), ("l_extendedprice",))
    pages = [held.rows(k * (held.total // 3), k * (held.total // 3) + 40).select(F.lit(k).alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice") for k in range(3)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query(_with(GRAPH, ROOT, _levels(1), "x AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS e FROM w)", "y AS (SELECT src AS label, e, 0 AS p FROM x UNION ALL SELECT dst, e, 1 FROM x)", "f AS (SELECT label, min((e, p)) AS m FROM y GROUP BY 1)", """SELECT CAST(label AS VARCHAR) AS label, 'n' || (row_number() OVER (ORDER BY m) - 1) AS id FROM f""", recursive=True))
def json_graph_nodes(spark, sf_dir):
    edges = _hierarchy(spark, sf_dir, 1).select(F.col("caller").alias("from"), F.col("callee").alias("to"))
    return delivery.graph_nodes(edges, ["from", "to"]).withColumn("label", F.col("label").cast("string"))


@query(_with(GRAPH, ROOT, _levels(2), CALLS,
    "x AS (SELECT caller, callee, call_type, row_number() OVER (ORDER BY min(depth), caller, callee) AS e FROM w JOIN c ON c.caller = w.src AND c.callee = w.dst GROUP BY 1, 2, 3 QUALIFY e <= 50)",
    "y AS (SELECT caller AS label, e, 0 AS p FROM x UNION ALL SELECT callee, e, 1 FROM x)",
    "f AS (SELECT label, row_number() OVER (ORDER BY min((e, p))) - 1 AS k FROM y GROUP BY 1)",
    "l AS (SELECT 'n' || a.k AS s, 'n' || z.k AS t, call_type FROM x JOIN f a ON a.label = caller JOIN f z ON z.label = callee)",
    """m AS (SELECT 0 AS part, 0 AS pos, '%% calls' AS line UNION ALL SELECT 1, 0, 'graph TD' UNION ALL SELECT 2, k, '  n' || k || '["' || label || '"]' FROM f
    UNION ALL SELECT 3, row_number() OVER (ORDER BY s, t, call_type), '  ' || s || ' -->|' || call_type || '| ' || t FROM l)""",
    "SELECT CAST(row_number() OVER (ORDER BY part, pos) - 1 AS INTEGER) AS n, line FROM m", recursive=True))
def mermaid_lines(spark, sf_dir):
    rows = _hierarchy(spark, sf_dir, 2).orderBy(*calls.EDGE_ORDER).limit(50).collect()
    d = delivery.Diagram("calls", "TD")
    for r in rows:
        d.edge(str(r.caller), str(r.callee), r.call_type)
    return spark.createDataFrame(list(enumerate(d.render("mermaid").splitlines())), "n int, line string")

