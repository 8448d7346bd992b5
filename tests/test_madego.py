"""Queries over sources that Spark makes from the tables, with what DuckDB
computes from the same tables; operators over many names and interfaces."""

import duckdb
import pytest

from ferngraph.operators import calls, resolve, types
from ferngraph.plans import catalogue, madego  # noqa: F401
from ferngraph.sources.gofacts import go_facts

SMALLEST = "/root/testdata/sf0.001"
ASKED = ("made_call_edges", "made_callers", "made_dead_code", "made_entrypoints", "made_risks", "made_lifecycles", "made_topology", "made_function_names", "made_import_cycles", "made_routes", "made_grpc", "made_dependents", "made_reload", "made_reload_functions")


@pytest.mark.parametrize("name", ASKED)
def test_made_sources(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "nation", "lineitem", "orders", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SMALLEST)
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    assert rows == sorted(map(repr, want.fetchall())) and rows


def test_interfaces_by_their_rarest_method(spark):
    sets = [("p", t, k, m, s) for t, ks, ms in (("A", "value ptr", "Close:() Read:(int)"), ("B", "ptr", "Close:() Read:(int)"), ("C", "value ptr", "Close:()"), ("D", "value", "Close:() Read:(bool)")) for k in ks.split() for m, s in (x.split(":") for x in ms.split())]
    sets += [("p", "E", "value", "Close", "()"), ("p", "E", "ptr", "Read", "(int)"), ("p", "I", "value", "Close", "()")]
    kinds = [("p", t, "struct") for t in "ABCDE"] + [("p", "I", "interface")]
    needs = [("closer", "Close", "()"), ("both", "Close", "()"), ("both", "Read", "(int)"), ("none", "Write", "()"), ("none", "Close", "()")]
    got = types.all_implementors(spark.createDataFrame(kinds, "pkg_path string, type_name string, kind string"), spark.createDataFrame(sets, "pkg_path string, type_name string, recv_kind string, method string, sig string"), spark.createDataFrame(needs, "iface string, method string, sig string"))
    assert {(r.iface, r.type_name) for r in got.collect()} == {*(("closer", t) for t in "ABCDE"), ("both", "A"), ("both", "B")}


FUNCTIONS = [  # fn_id, name, pkg_path, pkg_name, recv_type, is_root, synthetic
    ("x/a.Run", "Run", "x/a", "a", "", True, ""),
    ("x/b.Run", "Run", "x/b", "b", "", False, ""),
    ("(*x/a.T).Run", "Run", "x/a", "a", "*x/a.T", True, ""),
    ("x/a.Walk", "Walk", "x/a", "a", "", True, ""),
    ("x/a.walk", "walk", "x/a", "a", "", True, "made"),
    ("x/b.Other", "Other", "x/b", "b", "", False, ""),
    *((f"x/c{k}.Same", "Same", f"x/c{k}", f"c{k}", "", True, "") for k in range(25)),
]


def test_many_names_as_one_by_one(spark):
    functions = spark.createDataFrame(FUNCTIONS, "fn_id string, name string, pkg_path string, pkg_name string, recv_type string, is_root boolean, synthetic string")
    asked = ["Run", "a.Run", "b.Run", "T.Run", "(*T).Run", "t.run", "x.Run", "WALK", "walk", "Other", "b.other", "Same", "c3.Same", "Nowhere", "zz.run", "x/a.Walk"]
    got = {r.asked: r for r in resolve.resolve_all(functions, spark.createDataFrame([(a,) for a in asked] + [(None,), ("Run",)], "asked string")).collect()}
    assert set(got) == set(asked)
    for a in asked:
        one = sorted((r.fn_id, r.stage) for r in resolve.candidates(functions, a).collect())
        assert got[a].n == len(one), a
        assert (got[a].fn_id, got[a].stage) == (one[0] if one else (None, None)), a
        assert (got[a].others or []) == ([f for f, _ in one][:20] if len(one) > 1 else []), a


FUNCTION = "fn_id string, name string, pkg_path string, pkg_name string, recv_type string, is_root boolean, synthetic string"


def _most_rows(node) -> int:
    """The most rows that a node of an executed plan made."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _most_rows(node.plan())
    made = node.metrics().get("numOutputRows")
    kids = node.children()
    return max([made.get().value() if made.isDefined() else 0, *(_most_rows(kids.apply(i)) for i in range(kids.size()))])


def test_names_that_end_alike_are_not_multiplied(spark):
    """Where n names end with the name of n methods, no step has n times n rows."""
    n = 500
    functions = spark.createDataFrame([(f"(*x/p{k}.Node).Touch", "Touch", f"x/p{k}", f"p{k}", f"*x/p{k}.Node", True, "") for k in range(n)], FUNCTION)
    got = resolve.resolve_all(functions, spark.createDataFrame([(f"q{k}.node.touch",) for k in range(n)], "asked string"))
    rows = got.collect()
    assert len(rows) == n and {(r.stage, r.n, r.fn_id) for r in rows} == {(3, n, "(*x/p0.Node).Touch")}
    assert all(len(r.others) == 20 and r.others == sorted(r.others) for r in rows)
    assert _most_rows(got._jdf.queryExecution().executedPlan()) < 20 * n


def test_interfaces_that_nothing_calls_meet_no_types(spark, monkeypatch):
    """n interfaces with a method that n types have, of which one is called: no
    step has n times n rows, and the call leads to all types."""
    n = 60
    of = lambda k: f"package q{k}\n\ntype Server interface{{ Get() }}\n\ntype impl struct{{}}\n\nfunc (impl) Get() {{}}\n"
    texts = {f"/x/q{k}/a.go": of(k) for k in range(n)} | {"/x/r/a.go": 'package r\n\nimport "m/q0"\n\nfunc Run(s q0.Server) { s.Get() }\n'}
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")
    seen, made = [], calls.class_hierarchy_edges
    monkeypatch.setattr(calls, "class_hierarchy_edges", lambda static, through, impl: seen.append(impl) or made(static, through, impl))
    got = go_facts(spark, "/x", None, [("", "m")], files).call_edges().collect()
    assert {(r.caller, r.callee, r.call_type) for r in got} == {("m/r.Run", f"(m/q{k}.impl).Get", "Interface") for k in range(n)}
    assert len(seen[0].collect()) == n
    assert _most_rows(seen[0]._jdf.queryExecution().executedPlan()) < 10 * n
