"""Go sources that Spark makes from the driver's tables, and what the tools find
in them. A part is a package of its own, with a chain of calls as long as its
size says; its least supplier is a package that it imports and whose types it
holds; part types are interfaces of a shared package, which has generic types and
functions as well; parts of even size are run by a main package. The SQL computes
from the tables what the sources must lead to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.operators import calls, liveness, packages, resolve, state, surfaces, types
from ferngraph.plans.bindings import table
from ferngraph.plans.catalogue import query
from ferngraph.sources.gofacts import CODE, DECLARED, PACKAGES, changed_files, go_facts
from ferngraph.sources.gotypes import FactSet

PART = """package p{k}

import (
	"m/s{s}"
	"m/t"
{next}{back})

type Node struct {
	Count int
	next  *Node
	own   *s{s}.Owner
}

func New() *Node              { return &Node{Count: {z}} }
func (n *Node) Next() *Node   { return n.next }
func (n *Node) Touch()        { n.Count++ }
func (n *Node) {m}() int      { return n.Count }
func (n *Node) Meet(o *Node)  { o.Touch() }
func chain()                  { New(){nexts}.Touch() }
func held()                   { New().own.Tell() }
func used()                   { t.Use{m}(New()) }
func boxed()                  { t.Wrap(New()).Get().Touch() }
func weigh(n int) *Node       { return New() }
func mapped(xs []int)         { for _, x := range t.Map(xs, weigh) { x.Next() } }
func ranged(m map[int]*Node)  { for _, v := range m { v.Touch() } }
func switched(y any)          { switch x := y.(type) { case *Node: x.Next(); case *s{s}.Owner: x.Tell() } }
func value()                  { f := New().Meet; f(nil) }
func pair() (int, *Node)      { return 1, nil }
func several()                { _, x := pair(); x.Touch() }
func shadowed()               { x := New(); { x := s{s}.Make(); x.Tell() }; x.Next() }
func unused()                 { lost() }
func lost()                   {}
{init}
func All() {
	chain(); held(); used(); boxed(); mapped(nil); ranged(nil); switched(nil); value(); several(); shadowed()
{start}}
"""
DOTS = """package p{k}

import . "m/s{s}"

func dots() { Hello(); Make().Tell() }
"""
MAIN = """package main

import (
	"net/http"

	"github.com/go-chi/chi/v5"

	"m/p{k}"
	"m/s{s}"
)

type impl struct{}

func (impl) Get() {}

func home() {}

func routes(r chi.Router) { r.Get("/x{k}", home) }

func main() {
	p{k}.All()
	http.HandleFunc("/p{k}", home)
	s{s}.RegisterS{s}Server(nil, &impl{})
}
"""
SUPPLIER = """package s{k}

import "google.golang.org/grpc"

type Owner struct{ Name string }

func Hello()           {}
func Make() *Owner     { return &Owner{} }
func (o *Owner) Tell() { o.Name = "x" }

type Server interface{ Get() }

var Desc = grpc.ServiceDesc{
	ServiceName: "{nation}.v{k}",
	HandlerType: (*Server)(nil),
	Methods:     []grpc.MethodDesc{{MethodName: "Get", Handler: get}},
	Streams:     []grpc.StreamDesc{{StreamName: "Feed", Handler: feed, ServerStreams: {up}, ClientStreams: true}},
}

func RegisterS{k}Server(r grpc.ServiceRegistrar, x Server) { r.RegisterService(&Desc, x) }
"""
TYPE = """package t

type {m}er interface{ {m}() int }

func Use{m}(x {m}er) int { return x.{m}() }
"""
SHARED = """package t

type Box[V any] struct{ v V }

func (b *Box[V]) Get() V     { return b.v }
func Wrap[V any](v V) *Box[V] { return &Box[V]{v: v} }
func Map[X, Y any](xs []X, f func(X) Y) []Y {
	var out []Y
	for _, x := range xs {
		out = append(out, f(x))
	}
	return out
}
"""


def filled(template: str, **columns: Column) -> Column:
    """A text with columns in the places of their names in braces."""
    pieces = re.split(r"\{(" + "|".join(columns) + r")\}", template)
    return F.concat(*[columns[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces)])


def sources(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """(path, content) of the code base; edited: the names that a dot import
    brings in have changed for every tenth supplier, large parts have one more
    function, and the smallest ones' second files are gone."""
    least = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type").join(least, "p_partkey", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    k, z, s, m = F.col("p_partkey"), F.col("p_size"), F.col("s"), F.initcap("p_type")
    text = lambda c: F.concat(F.lit('\t"m/p'), c.cast("string"), F.lit('"\n'))
    when = lambda c, x: F.when(c, x).otherwise("")
    start = F.when(z % 3 == 0, "\tgo New().Touch()\n").when(z % 3 == 1, "\tgo func() { weigh(1) }()\n").otherwise("")
    body = filled(PART, k=k, s=s, z=z, m=m, nexts=F.repeat(F.lit(".Next()"), (z % 12 + 1).cast("int")), next=when(z % 3 == 0, text(k + 1)), back=when((z % 2 == 0) & (k > 0), text(k - 1)), init=when(z % 5 == 0, F.lit("func init() {}")), start=start)
    place = lambda folder, name, key: F.concat(F.lit(f"/made/{folder}"), key.cast("string"), F.lit(f"/{name}.go"))
    files = part.select(F.explode(F.array(F.struct(place("p", "a", k).alias("path"), body.alias("t")), F.struct(place("p", "b", k).alias("path"), filled(DOTS, k=k, s=s).alias("t")))).alias("f")).select("f.*")
    mains = part.where(z % 2 == 0).select(place("p", "cmd/main", k).alias("path"), filled(MAIN, k=k, s=s).alias("t"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    up = F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false")
    suppliers = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(place("s", "a", F.col("s_suppkey")).alias("path"), filled(SUPPLIER, k=F.col("s_suppkey"), nation=F.col("nation"), up=up).alias("t"))
    kinds = part.select(m.alias("m")).distinct().select(F.concat(F.lit("/made/t/"), F.lower("m"), F.lit(".go")).alias("path"), filled(TYPE, m=F.col("m")).alias("t"))
    shared = table(spark, sf_dir, "region").limit(1).select(F.lit("/made/t/shared.go").alias("path"), F.lit(SHARED).alias("t"))  # once
    if edited:
        more = lambda rows, when, text: rows.withColumn("t", F.when(when, F.concat("t", F.lit(text))).otherwise(F.col("t")))
        key = lambda folder: F.regexp_extract("path", rf"^/made/{folder}(\d+)/", 1).cast("long")
        large, small = (part.where(w).select("p_partkey") for w in (z >= 45, z <= 3))
        files = files.withColumn("p_partkey", key("p")).join(large.withColumn("large", F.lit(True)), "p_partkey", "left").join(small.withColumn("small", F.lit(True)), "p_partkey", "left")
        files = files.where("small is null or path like '%/a.go'")
        files = more(files, F.col("large") & F.col("path").endswith("/a.go"), "\nfunc added() { lost() }\n").select("path", "t")
        suppliers = more(suppliers, key("s") % 10 == 0, "\nfunc Extra() {}\n")
    every = files.unionByName(mains).unionByName(suppliers).unionByName(kinds).unionByName(shared)
    return every.select("path", F.col("t").cast("binary").alias("content"))


_made: dict[tuple[str, str], FactSet] = {}


def facts_of(spark: SparkSession, sf_dir: str, kinds: frozenset[str] = CODE) -> FactSet:
    """The facts of the code base, as far as a query needs them; the latest ones
    are kept, and serve those that need fewer."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made or not kinds <= set(_made[key].tables):
        _made.clear()
        _made[key] = go_facts(spark, "/made", None, [("", "m")], sources(spark, sf_dir), kinds=kinds)
    return _made[key]


def reloaded(spark: SparkSession, sf_dir: str) -> tuple[FactSet, FactSet]:
    """The facts before and after the edit, the latter by what has changed."""
    before = facts_of(spark, sf_dir, DECLARED)
    return before, go_facts(spark, "/made", None, [("", "m")], sources(spark, sf_dir, True), before, DECLARED)


# what must come out, by the tables alone

BASE = """u AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey AS k, p_size AS z, coalesce(s, 0) AS s, upper(p_type[1]) || lower(p_type[2:]) AS m, 'm/p' || p_partkey AS pkg, '(*m/p' || p_partkey || '.Node).' AS node,
  '(*m/s' || coalesce(s, 0) || '.Owner).Tell' AS tell, 'm/s' || coalesce(s, 0) AS sup FROM part LEFT JOIN u ON l_partkey = p_partkey)"""
_CALLS = {
    "chain": "pkg || '.New':1 node || 'Next':z%12+1 node || 'Touch':1", "held": "pkg || '.New':1 tell:1", "used": "pkg || '.New':1 'm/t.Use' || m:1",
    "boxed": "pkg || '.New':1 'm/t.Wrap':1 '(*m/t.Box).Get':1 node || 'Touch':1", "weigh": "pkg || '.New':1", "mapped": "'m/t.Map':1 node || 'Next':1", "ranged": "node || 'Touch':1",
    "switched": "node || 'Next':1 tell:1", "value": "pkg || '.New':1 node || 'Meet':1", "several": "pkg || '.pair':1 node || 'Touch':1", "shadowed": "pkg || '.New':1 sup || '.Make':1 tell:1 node || 'Next':1",
    "unused": "pkg || '.lost':1", "dots": "sup || '.Hello':1 sup || '.Make':1 tell:1", "All": " ".join(f"pkg || '.{x}':1" for x in "chain held used boxed mapped ranged switched value several shadowed".split()),
}


def _edges_sql() -> str:
    rows = [f"(pkg || '.{f}', {c}, 'Static', {n})" for f, each in _CALLS.items() for c, n in re.findall(r"([^:]+):(\S+)\s*", each)]
    return f"""{BASE}, e AS (
  SELECT caller, callee, call_type, CAST(n AS BIGINT) AS n FROM p, LATERAL (VALUES {", ".join(rows)}, (node || 'Meet', node || 'Touch', 'Static', 1)) v(caller, callee, call_type, n)
  UNION ALL SELECT pkg || '.All', pkg || '.New', 'Static', 1 FROM p WHERE z % 3 = 0 UNION ALL SELECT pkg || '.All', node || 'Touch', 'Goroutine', 1 FROM p WHERE z % 3 = 0
  UNION ALL SELECT pkg || '.All', pkg || '.All$1', 'Goroutine', 1 FROM p WHERE z % 3 = 1 UNION ALL SELECT pkg || '.All$1', pkg || '.weigh', 'Static', 1 FROM p WHERE z % 3 = 1
  UNION ALL SELECT 'm/t.Map', pkg || '.weigh', 'Static', 1 FROM p UNION ALL SELECT 'm/t.Use' || m, node || m, 'Interface', 1 FROM p
  UNION ALL SELECT pkg || '/cmd.main', c, 'Static', 1 FROM p, LATERAL (VALUES (pkg || '.All'), ('net/http.HandleFunc'), (sup || '.RegisterS' || s || 'Server')) v(c) WHERE z % 2 = 0)"""


EDGES = _edges_sql()


@query(f"WITH {EDGES} SELECT * FROM e")
def made_call_edges(spark, sf_dir):
    """Chains of any length, fields, ranges, switches, several results, values of
    methods, shadowed and dotted names, interfaces, generic types and functions."""
    return facts_of(spark, sf_dir).call_edges().groupBy("caller", "callee", "call_type").agg(F.count("*").alias("n"))


def _mains(spark, sf_dir):
    return facts_of(spark, sf_dir)["functions"].where("name = 'main'").select(F.col("fn_id").alias("id"))


def _pairs(spark, sf_dir):
    return facts_of(spark, sf_dir).call_edges().select("caller", "callee", "call_type").distinct()


_WALK = "w AS (SELECT caller, callee, call_type, 1 AS depth FROM e WHERE {start} UNION SELECT e.caller, e.callee, e.call_type, depth + 1 FROM w JOIN e ON e.{at} = w.{to} WHERE depth < {depth})"


def _walk_sql(start: str, at: str, to: str, depth: int) -> str:
    return f"WITH RECURSIVE {EDGES}, {_WALK.format(start=start, at=at, to=to, depth=depth)} SELECT caller, callee, call_type, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2, 3"


@query(_walk_sql("ends_with(caller, '.main')", "caller", "callee", 3))
def made_hierarchy(spark, sf_dir):
    return calls.hierarchy(_pairs(spark, sf_dir), _mains(spark, sf_dir), 3)


@query(_walk_sql("starts_with(callee, '(*m/s') AND ends_with(callee, '.Tell')", "callee", "caller", 2))
def made_callers(spark, sf_dir):
    edges = _pairs(spark, sf_dir)
    tell = facts_of(spark, sf_dir)["functions"].where("name = 'Tell'").select(F.col("fn_id").alias("id"))
    return calls.callers(edges, tell, 2)


@query(f"""WITH {EDGES}, x AS (SELECT min(pkg) AS pkg FROM p WHERE z % 2 = 0), w AS (SELECT pkg FROM x)
SELECT CAST(3 AS INTEGER) AS length, pkg || '/cmd.main>' || pkg || '.All>' || f || '>' || t AS path FROM x JOIN p USING (pkg), LATERAL (SELECT DISTINCT e.caller AS f, e.callee AS t FROM e WHERE e.callee = node || 'Next' AND e.caller IN (SELECT callee FROM e y WHERE y.caller = pkg || '.All')) v""")
def made_paths(spark, sf_dir):
    """Ways from a main function to a method, three calls long."""
    first = _mains(spark, sf_dir).orderBy("id").limit(1)
    node = first.select(F.concat(F.lit("(*"), F.regexp_replace("id", r"/cmd\.main$", ""), F.lit(".Node).Next")).alias("id"))
    found = calls.paths(_pairs(spark, sf_dir), first, node, 3, 100)
    return found.select("length", F.array_join("path", ">").alias("path"))


_SETS = """SELECT pkg || '.' || f AS fn, pkg FROM p, LATERAL (VALUES ('chain'), ('held'), ('used'), ('boxed'), ('mapped'), ('ranged'), ('switched'), ('value'), ('several'), ('shadowed'), ('pair')) v(f) WHERE z % 2 = 1"""


@query(f"""WITH {BASE}
SELECT 'unreachable_from_entrypoint' AS kind, fn AS "function" FROM ({_SETS})
UNION ALL SELECT 'unreachable_from_entrypoint', pkg || '.lost' FROM p
UNION ALL SELECT 'unreachable_from_entrypoint', pkg || '.weigh' FROM p WHERE NOT EXISTS (SELECT 1 FROM p WHERE z % 2 = 0) AND z % 3 <> 1
UNION ALL SELECT 'unreferenced', pkg || f FROM p, LATERAL (VALUES ('.unused'), ('.dots')) v(f)
UNION ALL SELECT 'unreferenced', f FROM p, LATERAL (VALUES ('(' || pkg || '/cmd.impl).Get'), (pkg || '/cmd.home'), (pkg || '/cmd.routes')) v(f) WHERE z % 2 = 0""")
def made_dead_code(spark, sf_dir):
    return liveness.dead_of(facts_of(spark, sf_dir)).select("kind", F.col("id").alias("function"))


@query(f"""WITH {BASE}
SELECT 'main' AS kind, pkg || '/cmd' AS package, pkg || '/cmd.main' AS "function" FROM p WHERE z % 2 = 0 UNION ALL SELECT 'init', pkg, pkg || '.init' FROM p WHERE z % 5 = 0
UNION ALL SELECT 'goroutine_start', pkg, node || 'Touch' FROM p WHERE z % 3 = 0 UNION ALL SELECT 'goroutine_start', pkg, pkg || '.All$1' FROM p WHERE z % 3 = 1""")
def made_entrypoints(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    return liveness.entrypoints(facts.roots("functions"), facts.go_sites()).select("kind", "package", "function")


@query(f"""WITH {BASE} SELECT 'm/' || 'p' || k || '.Node' AS struct, 'Count' AS field, node || 'Touch' AS "function", 'p' || k || '/a.go' AS file FROM p WHERE z % 3 = 0""")
def made_risks(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    stores = facts.instrs().where("op = 'Store' and field <> ''")
    guard = state.protected(state.classify_calls(facts.roots("calls").select(F.col("caller").alias("fn_id"), "callee_str", "method_name")))
    return state.risks(facts.go_sites().where("target <> ''"), stores, guard).select("struct", "field", "function", "file")


@query(f"""WITH {BASE} SELECT kind, struct, field, "function" FROM (
  SELECT unnest(['Instantiate', 'FieldMutation', 'FieldMutation', 'InterfaceHandoff']) AS kind, pkg || '.Node' AS struct, unnest(['', 'Count', 'Count', '']) AS field, unnest([pkg || '.New', pkg || '.New', node || 'Touch', pkg || '.used']) AS "function" FROM p
  UNION ALL SELECT unnest(['Instantiate', 'FieldMutation']), 'm/s' || s_suppkey || '.Owner', unnest(['', 'Name']), unnest(['m/s' || s_suppkey || '.Make', '(*m/s' || s_suppkey || '.Owner).Tell']) FROM supplier)""")
def made_lifecycles(spark, sf_dir):
    """Of all structs Node and Owner."""
    instrs = facts_of(spark, sf_dir).instrs()
    return state.hops(instrs, "Node").unionByName(state.hops(instrs, "Owner")).select("kind", "struct", "field", "function")


# types and names


@query(f"WITH {BASE} SELECT 'm/t.' || m || 'er' AS iface, pkg AS package, 'Node' AS struct FROM p UNION ALL SELECT 'm/s' || s_suppkey || '.Server', pkg || '/cmd', 'impl' FROM supplier, p WHERE z % 2 = 0")
def made_topology(spark, sf_dir):
    """All interfaces with all structs that implement them."""
    facts = facts_of(spark, sf_dir, DECLARED)
    known = facts["types"].where("kind = 'interface'").select(F.concat_ws(".", "pkg_path", "type_name").alias("iface"))
    needs = facts.interfaces.join(known, "iface", "left_semi").select("iface", "method", "sig")
    return types.all_implementors(facts["types"], facts.method_sets(), needs).select("iface", F.col("pkg_path").alias("package"), F.col("type_name").alias("struct"))


@query(f"""WITH {BASE}, f AS (SELECT pkg || '.' || x AS id, 'p' || k || '.' || x AS asked FROM p, LATERAL (VALUES ('chain'), ('Nowhere'), ('node.touch')) v(x)),
a AS (SELECT asked, CASE WHEN ends_with(asked, 'Nowhere') THEN NULL WHEN ends_with(asked, 'touch') THEN (SELECT min(node || 'Touch') FROM p) ELSE id END AS fn FROM f)
SELECT asked, CAST(CASE WHEN fn IS NULL THEN NULL WHEN ends_with(asked, 'touch') THEN 3 ELSE 1 END AS INTEGER) AS stage, CASE WHEN fn IS NULL THEN 0 WHEN ends_with(asked, 'touch') THEN (SELECT count(*) FROM p) ELSE 1 END AS n, fn AS fn_id FROM a
UNION ALL SELECT 's' || s_suppkey || '.HELLO', 3, 1, 'm/s' || s_suppkey || '.Hello' FROM supplier UNION ALL SELECT 'Owner.Tell', 1, (SELECT count(*) FROM supplier), (SELECT min('(*m/s' || s_suppkey || '.Owner).Tell') FROM supplier)""")
def made_function_names(spark, sf_dir):
    """Many spellings at once: of each its stage, how many functions it means,
    and the first. Folded, any method of a qualified name's last part counts."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    asked = part.select(F.explode(F.array(*[F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(x)) for x in (".chain", ".Nowhere", ".node.touch")])).alias("asked"))
    asked = asked.unionByName(supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".HELLO")).alias("asked"))).unionByName(supplier.limit(1).select(F.lit("Owner.Tell").alias("asked")))
    return resolve.resolve_all(facts_of(spark, sf_dir, DECLARED)["functions"], asked).select("asked", "stage", "n", "fn_id")


@query(f"""WITH {BASE} SELECT pkg || '.Node' AS type, recv_kind, method FROM p, LATERAL (VALUES ('Next'), ('Touch'), (m), ('Meet')) v(method), (SELECT 'ptr' AS recv_kind) UNION ALL SELECT 'm/s' || s_suppkey || '.Owner', 'ptr', 'Tell' FROM supplier
UNION ALL SELECT pkg || '/cmd.impl', r, 'Get' FROM p, (VALUES ('ptr'), ('value')) v(r) WHERE z % 2 = 0 UNION ALL SELECT 'm/t.Box', 'ptr', 'Get'""")
def made_method_sets(spark, sf_dir):
    return facts_of(spark, sf_dir, DECLARED).method_sets().select(F.concat_ws(".", "pkg_path", "type_name").alias("type"), "recv_kind", "method")


# packages

_IMPORTED = f"""{BASE}, i AS (
  SELECT pkg, sup AS dep FROM p UNION SELECT pkg, 'm/t' FROM p UNION SELECT pkg, 'm/p' || (k + 1) FROM p WHERE z % 3 = 0 UNION SELECT pkg, 'm/p' || (k - 1) FROM p WHERE z % 2 = 0 AND k > 0
  UNION SELECT pkg || '/cmd', unnest([pkg, sup, 'github.com/go-chi/chi/v5']) FROM p WHERE z % 2 = 0 UNION SELECT 'm/s' || s_suppkey, 'google.golang.org/grpc' FROM supplier)"""


@query(f"WITH {_IMPORTED}, a AS (SELECT DISTINCT pkg FROM i UNION SELECT 'm/t') SELECT pkg AS package, coalesce(string_agg(dep, ',' ORDER BY dep), '') AS imports FROM a LEFT JOIN i USING (pkg) GROUP BY 1")
def made_dependencies(spark, sf_dir):
    facts = facts_of(spark, sf_dir, PACKAGES)
    return packages.dependencies(facts.packages(), facts["imports"], False).select("package", F.array_join("imports", ",").alias("imports"))


@query(f"WITH RECURSIVE {_IMPORTED}, q AS (SELECT pkg FROM i WHERE dep = 'm/s1' UNION SELECT i.pkg FROM q JOIN i ON i.dep = q.pkg) SELECT 'direct' AS kind, pkg AS package FROM i WHERE dep = 'm/s1' UNION ALL SELECT 'transitive', pkg FROM q WHERE pkg NOT IN (SELECT pkg FROM i WHERE dep = 'm/s1')")
def made_dependents(spark, sf_dir):
    imports = facts_of(spark, sf_dir, PACKAGES)["imports"]
    direct = packages.direct_dependents(imports, "m/s1").select(F.lit("direct").alias("kind"), "package")
    return direct.unionByName(packages.transitive_dependents(imports, "m/s1").select(F.lit("transitive").alias("kind"), "package"))


@query(f"""WITH {BASE}, x AS (SELECT k, sum(CASE WHEN mutual THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run FROM (SELECT k, coalesce(lag(z) OVER (ORDER BY k) % 3 = 0 AND z % 2 = 0, false) AS mutual FROM p))
SELECT CAST(count(*) AS INTEGER) AS size, string_agg('m/p' || k, ',' ORDER BY 'm/p' || k) AS members FROM x GROUP BY run HAVING count(*) > 1""")
def made_import_cycles(spark, sf_dir):
    facts = facts_of(spark, sf_dir, PACKAGES)
    edges = facts["imports"].select(F.col("pkg_path").alias("src"), F.col("import_path").alias("dst")).distinct()
    rows = packages.import_cycles(edges, facts.packages().select(F.col("pkg_path").alias("id")))
    return rows.select("size", F.array_join(F.array_sort("members"), ",").alias("members"))


@query(f"""WITH {_IMPORTED} SELECT pkg AS "from", dep AS "import", 'forbid' AS rule FROM i WHERE dep = 'm/t' UNION ALL SELECT pkg, dep, 'allow_prefix' FROM i WHERE starts_with(dep, 'm/') AND NOT starts_with(dep, 'm/p')""")
def made_boundaries(spark, sf_dir):
    facts = facts_of(spark, sf_dir, PACKAGES)
    rules = spark.createDataFrame([("forbid", "m/", "m/t"), ("allow_prefix", "m/", "m/p")], "type string, `from` string, `to` string")
    return packages.violations(facts["imports"], facts.packages(), rules).select("from", "import", "rule")


# surfaces


@query(f"""WITH {BASE} SELECT 'ANY' AS method, '/p' || k AS path, 'home' AS handler, 'net/http' AS framework FROM p WHERE z % 2 = 0 UNION ALL SELECT 'GET', '/x' || k, 'home', 'chi' FROM p WHERE z % 2 = 0""")
def made_routes(spark, sf_dir):
    return surfaces.routes(facts_of(spark, sf_dir).route_calls()).select("method", "path", "handler", "framework")


@query(f"""WITH {BASE}, s AS (SELECT s_suppkey AS k, n_name || '.v' || s_suppkey AS service FROM supplier JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT DISTINCT s FROM p WHERE z % 2 = 0)
SELECT service, method, CASE WHEN method = 'Get' THEN 'unary' WHEN k % 2 = 0 THEN 'bidi_stream' ELSE 'client_stream' END AS rpc_type, '/' || service || '/' || method AS full_method, CASE WHEN k IN (SELECT s FROM r) THEN '&impl{{}}' ELSE '' END AS implementations
FROM s, (VALUES ('Get'), ('Feed')) v(method)""")
def made_grpc(spark, sf_dir):
    facts = facts_of(spark, sf_dir, DECLARED)
    regs = surfaces.registrations(facts.roots("grpc_register_calls"), facts.roots("grpc_register_funcs"), facts.roots("grpc_services"))
    services = facts.roots("grpc_services").select("pkg_path", "desc_name", "service")
    ends = surfaces.endpoints(services, facts.roots("grpc_methods").drop("is_root"), surfaces.implementations(regs))
    return ends.select("service", "method", "rpc_type", "full_method", F.array_join("implementations", ",").alias("implementations"))


# reload


@query(f"""WITH {BASE} SELECT '/made/p' || k || '/a.go' AS path, CASE WHEN z >= 45 THEN 'parsed' ELSE 'kept' END AS state FROM p
UNION ALL SELECT '/made/p' || k || '/b.go', CASE WHEN z <= 3 THEN 'dropped' WHEN s % 10 = 0 THEN 'parsed' ELSE 'kept' END FROM p UNION ALL SELECT '/made/p' || k || '/cmd/main.go', 'kept' FROM p WHERE z % 2 = 0
UNION ALL SELECT '/made/s' || s_suppkey || '/a.go', CASE WHEN s_suppkey % 10 = 0 THEN 'parsed' ELSE 'kept' END FROM supplier
UNION ALL SELECT DISTINCT '/made/t/' || lower(m) || '.go', 'kept' FROM p UNION ALL SELECT '/made/t/shared.go', 'kept'""")
def made_reload(spark, sf_dir):
    """Files that an edit makes be parsed again: their own text, or the names
    that their dot import brings in, changed."""
    return changed_files(*reloaded(spark, sf_dir))


@query(f"""WITH {BASE} SELECT pkg || f AS fn_id, change FROM p, LATERAL (VALUES ('.added', 'added', z >= 45), ('.dots', 'dropped', z <= 3)) v(f, change, yes) WHERE yes
UNION ALL SELECT 'm/s' || s_suppkey || '.Extra', 'added' FROM supplier WHERE s_suppkey % 10 = 0""")
def made_reload_functions(spark, sf_dir):
    """Functions that came and went with the edit."""
    before, after = (x["functions"].select("fn_id") for x in reloaded(spark, sf_dir))
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("dropped")))
