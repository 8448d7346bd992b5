import random

import pytest

from ferngraph.operators import calls, liveness, packages
from ferngraph.plans import bindings, catalogue, graphs

SMALLEST = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def call_edges(spark, pairs):
    return spark.createDataFrame([(a, b, "Static", "f.go", k + 1, k) for k, (a, b) in enumerate(pairs)], "caller string, callee string, call_type string, file string, line int, site_ord int")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_hierarchy_depths(spark):
    chain = call_edges(spark, [("Root", "A"), ("A", "B"), ("B", "C"), ("C", "D")])
    got = {(r.caller, r.callee): r.depth for r in calls.hierarchy(chain, ids(spark, "Root"), 3).collect()}
    assert got == {("Root", "A"): 1, ("A", "B"): 2, ("B", "C"): 3}
    assert calls.hierarchy_depth(9) == 3 and calls.callers_depth(9) == 3 and calls.callers_depth(8) == 8 and calls.path_limits(0, 500) == (8, 20)


def test_self_recursion_has_one_edge(spark):
    loop = call_edges(spark, [("Root", "Loop"), ("Loop", "Loop"), ("Loop", "Loop")])
    assert calls.hierarchy(loop, ids(spark, "Root"), 3).count() == 2


def test_callers(spark):
    fan = call_edges(spark, [("Root1", "T"), ("Root2", "T"), ("Root3", "T"), ("X", "Root1")])
    assert {r.caller for r in calls.callers(fan, ids(spark, "T"), 1).collect()} == {"Root1", "Root2", "Root3"}
    assert calls.callers(fan, ids(spark, "T"), 2).count() == 4


def test_paths(spark):
    diamond = call_edges(spark, [("A", "B1"), ("A", "B2"), ("B1", "C"), ("B2", "C"), ("C", "A")])
    got = [list(r.path) for r in calls.paths(diamond, ids(spark, "A"), ids(spark, "C")).collect()]
    assert got == [["A", "B1", "C"], ["A", "B2", "C"]]
    assert calls.paths(diamond, ids(spark, "A"), ids(spark, "C"), 8, 1).count() == 1
    assert calls.paths(diamond, ids(spark, "A"), ids(spark, "A")).count() == 0
    assert calls.cutoff_reason(1, 1) and calls.cutoff_reason(0, 5) and not calls.cutoff_reason(2, 5)


def brute_reach(pairs, start):
    depth, frontier = dict.fromkeys(start, 0), set(start)
    while frontier:
        frontier = {b for a, b in pairs if a in frontier} - set(depth)
        depth |= dict.fromkeys(frontier, max(depth.values()) + 1)
    return depth


def test_reach(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")])
    assert {(r.id, r.depth) for r in graphs.reach(e, ids(spark, "a")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [tuple(r) for r in graphs.reach(e, ids(spark, "z", "z")).collect()] == [("z", 0)] and graphs.reach(e, ids(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_reach_and_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range((30, 50, 120)[seed])] + [(f"p{k}", f"p{k + 1}") for k in range(7)]
    e = edges(spark, pairs)
    assert {x.id: x.depth for x in graphs.reach(e, ids(spark, "n1", "p0")).collect()} == brute_reach(pairs, ["n1", "p0"])
    names = {x for p in pairs for x in p}
    far = {x: set(brute_reach(pairs, [x])) for x in names}
    assert {x.id: x.component for x in graphs.strong_components(e).collect()} == {x: min(y for y in names if y in far[x] and x in far[y]) for x in names}


def test_components(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c"), ("e", "e"), ("d", "f"), ("f", "g"), ("g", "h"), ("h", "f")])
    want = {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "f", "g": "f", "h": "f"}
    assert {r.id: r.component for r in graphs.strong_components(e).collect()} == want


def test_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("a", "ext"), ("s", "s")])
    got = packages.import_cycles(e, ids(spark, "a", "b", "c", "d", "s")).orderBy("size", "members").collect()
    assert [list(r.members) for r in got] == [["a", "b"], ["c", "d"]]
    assert packages.import_cycles(edges(spark, [("a", "a")])).count() == 0


def test_dead_code(spark):
    e = edges(spark, [("main", "used"), ("deadCaller", "deadTarget"), ("orphan", "orphan")])
    nodes = ids(spark, "used", "deadCaller", "deadTarget", "orphan")
    got = {r.id: r.kind for r in liveness.dead(nodes, e, ids(spark, "main")).collect()}
    assert got == {"deadCaller": "unreferenced", "deadTarget": "unreachable_from_entrypoint", "orphan": "unreachable_from_entrypoint"}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A cycle of 300 with a way round some of it, chains into it and out of it:
    rounds follow the logarithm of its length."""
    pairs = [(k, (k + 1) % 300) for k in range(300)] + [(10, 400), (400, 401), (401, 250), (20, 410), (410, 411)] + [(k, k + 1) for k in range(500, 700)] + [(700, 5)]
    tables, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df, **sums: tables.append(1) or cut(df, **sums))
    got = {r.id: r.component for r in graphs.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: 0 if x < 300 or x in (400, 401) else x for x in {x for p in pairs for x in p}}
    assert len(tables) < 40


def test_rows_are_dealt_by_their_count(spark, monkeypatch):
    """Joins and groups of a walk have parts for their rows, not a fixed number."""
    plain = {tuple(r) for r in catalogue.QUERIES["callers_d3"](spark, SMALLEST).collect()}
    monkeypatch.setattr(graphs, "ROWS", 200)
    for few in (graphs.FEW, 5):
        monkeypatch.setattr(calls, "FEW", few)
        monkeypatch.setattr(bindings, "FEW", few)
        got = catalogue.QUERIES["callers_d3"](spark, SMALLEST)
        assert {tuple(r) for r in got.collect()} == plain and got.rdd.getNumPartitions() > 8
    assert bindings.graph(spark, SMALLEST).rdd.getNumPartitions() > 8


def test_no_trimming_where_nothing_is_loose(spark, monkeypatch):
    monkeypatch.setattr(graphs, "_trimmed", None)
    pairs = [(k, (k + s) % 12) for k in range(12) for s in (1, 2)]
    assert {tuple(r) for r in graphs.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()} == {(k, 0) for k in range(12)}
