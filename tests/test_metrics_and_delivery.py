import pytest
from pyspark.sql import functions as F

from ferngraph import functions as fn
from ferngraph.operators import delivery, metrics, resolve, state


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_halstead(spark):
    rows = [("f", "operator", ":=", 1), ("f", "operator", "+", 1), ("f", "operator", "return", 1), ("f", "operand", "total", 2), ("f", "operand", "a", 1), ("f", "operand", "b", 1)]
    r = metrics.halstead(metrics.halstead_counts(spark.createDataFrame(rows, "fn_id string, kind string, token string, cnt int"))).first()
    assert (r.n1, r.t1, r.n2, r.t2, r.volume, r.difficulty, r.effort) == (3, 3, 3, 4, 18.09, 2.0, 36.19)


def test_rounding_is_half_away_from_zero_on_the_hundredfold(spark):
    assert one(spark, fn.round2(F.col("v")), v=1.005) == 1.0


def test_duplicates(spark):
    rows = [("p", "A", "s", "x  y\n z", 3), ("p", "B", "s", "x y z", 4), ("p", "C", "t", "x y z", 4), ("p", "D", "s", "q", 2), ("p", "E", "s", "q", 2)]
    prints = metrics.fingerprints(spark.createDataFrame(rows, "package string, function string, signature string, body_text string, body_lines int"))
    got = metrics.duplicate_groups(prints, 0, ("package", "function")).collect()
    assert [(r.signature, r["count"], [x.function for x in r.locations]) for r in got] == [("s", 2, ["A", "B"])]


def test_names(spark):
    assert one(spark, fn.dot_identifier("v"), v="hello world-123") == "helloworld123"
    assert one(spark, fn.dot_identifier("v"), v="9start") == "_9start"
    assert one(spark, fn.short_function_name("v"), v="a.b.C") == "C"
    assert one(spark, fn.short_type_name("v"), v="(*pkg.T)") == "T"
    assert one(spark, fn.collapse_spaces("v"), v=" a\t\n b ") == "a b"
    assert one(spark, fn.is_stdlib("v"), v="net/http") and not one(spark, fn.is_stdlib("v"), v="x.io/y")


FUNCTIONS = "fn_id string, name string, pkg_path string, pkg_name string, recv_type string, synthetic string, is_root boolean"


def test_resolving(spark):
    f = spark.createDataFrame(
        [("m/p.Run", "Run", "m/p", "p", "", "", True), ("(*m/p.T).Save", "Save", "m/p", "p", "*m/p.T", "", True), ("dep.Run", "Run", "dep", "dep", "", "", False), ("m/q.Go", "Go", "m/q", "q", "", "", True), ("m/r.Go", "Go", "m/r", "r", "", "", True)],
        FUNCTIONS,
    )
    assert resolve.resolve(f, "Run") == "m/p.Run"
    for spelling in ("T.Save", "(*T).Save", "Save", "p.T.Save", "t.save"):
        assert resolve.resolve(f, spelling) == "(*m/p.T).Save"
    with pytest.raises(resolve.Ambiguous):
        resolve.resolve(f, "Go")
    with pytest.raises(resolve.NotFound):
        resolve.resolve(f, "Nope")


def test_window_bounds():
    o = delivery.Options
    assert delivery.bounds(10, o()) == (0, 10)
    assert delivery.bounds(10, o(offset=3, limit=2)) == (3, 5)
    assert delivery.bounds(10, o(offset=3, limit=5, max_items=4)) == (3, 7)
    assert delivery.bounds(10, o(offset=-1, limit=-2)) == (0, 10)
    assert delivery.bounds(2, o(offset=5)) == (2, 2)


def test_chunks_reassemble(spark):
    df = spark.range(0, 23).select(F.col("id"))
    seen, cursor = [], ""
    while True:
        page = delivery.deliver(df, ["id"], "x", F.col("id").cast("string"), delivery.Options(chunk_size=10, cursor=cursor))
        seen += [r.id for r in page.rows]
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert seen == list(range(23))
    first = delivery.deliver(df, ["id"], "x", F.col("id").cast("string"), delivery.Options(chunk_size=10))
    with pytest.raises(delivery.CursorError, match="invalidated"):
        delivery.deliver(df.where("id < 20"), ["id"], "x", F.col("id").cast("string"), delivery.Options(chunk_size=10, cursor=first.next_cursor))
    for bad in ("###", delivery.base64.urlsafe_b64encode(b"[]").decode(), delivery.base64.urlsafe_b64encode(b'{"v":2,"o":0,"t":1,"f":"x"}').decode()):
        with pytest.raises(delivery.CursorError):
            delivery.decode_cursor(bad)


def test_chunk_size_is_capped(monkeypatch):
    assert delivery.clamp_chunk(500) == 50 and delivery.clamp_chunk(0) == 0
    monkeypatch.setenv(delivery.CHUNK_ENV, "70")
    assert delivery.clamp_chunk(500) == 70


def test_diagrams():
    d = delivery.Diagram("9 lives", "TD")
    d.node("a", "root")
    d.edge("a", "b", 'x|"y"', "dashed")
    d.edge("a", "b")
    assert d.render("mermaid").splitlines()[:5] == ["%% 9 lives", "graph TD", '  n0["a"]', '  n1["b"]', "  n0 --> n1"]
    assert "  n0 -.->|x/'y'| n1" in d.render("mermaid") and "  class n0 root" in d.render("mermaid")
    assert d.render("dot").startswith("digraph _9lives {\n  rankdir=LR;")
    assert '"class":"root"' in d.render("json-graph")
    assert delivery.parse_format(" MMD ") == "mermaid" and delivery.parse_format("graphviz") == "dot" and delivery.parse_format("") == ""
    with pytest.raises(ValueError):
        delivery.parse_format("svg")


def test_lifecycle_and_risks(spark):
    instrs = spark.createDataFrame(
        [("New", 1, "Alloc", "m/p.User", "", False, "a.go", 1), ("New", 2, "Store", "m/p.User", "Name", False, "a.go", 2), ("New", 3, "Store", "m/p.User", "Name", False, "a.go", 3), ("Run", 4, "Call", "m/p.User", "", True, "a.go", 9), ("Run", 5, "Call", "m/p.User", "", False, "a.go", 10)],
        "fn_id string, ord int, op string, struct string, field string, iface_param boolean, file string, line int",
    )
    rows = state.hops(instrs, "User")
    assert rows.count() == 4 and state.dedupe(rows, "function_kind_field").count() == 3 and state.dedupe(rows, "none").count() == 4
    assert state.max_hops(0) == 500 and state.max_hops(99_999) == 20_000
    calls = state.classify_calls(spark.createDataFrame([("G", "(*sync.Mutex).Lock", "Lock"), ("G", "(*sync.Mutex).Unlock", "Unlock"), ("H", "(*sync.Mutex).Lock", "Lock")], "fn_id string, callee_str string, method_name string"))
    sites = spark.createDataFrame([("G",), ("H",), ("H",)], "target string")
    stores = spark.createDataFrame([("G", "S", "n", "a.go", 1), ("H", "S", "n", "a.go", 2)], "fn_id string, struct string, field string, file string, line int")
    assert [(r.function, r.risk_level) for r in state.risks(sites, stores, state.protected(calls)).collect()] == [("H", "High")] * 2


def test_pages_of_a_written_order(spark):
    rows = [(k % 3, -k * 7 % 50, f"r{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, name string")
    want = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    held = delivery.Order(df, ["a", "b", "name"], F.col("name"), ("b",), parts=7)
    assert held.total == 200 and held.first == want[0][2] and held.last == want[-1][2]
    for start, end in ((0, 5), (13, 13), (60, 140), (195, 200), (190, 400), (300, 310)):
        assert [tuple(r) for r in held.rows(start, end).collect()] == want[start:end]
    orders, cursor, got, pages = delivery.Orders(), "", [], 0
    while pages == 0 or cursor:
        page = delivery.deliver(df, ["a", "b", "name"], "x", F.col("name"), delivery.Options(chunk_size=30, cursor=cursor, max_items=100), ("b",), orders)
        got, cursor, pages = got + [tuple(r) for r in page.rows], page.next_cursor, pages + 1
    assert got == want[:100] and pages == 4 and page.total == 100 and len(orders.held) == 1
    with pytest.raises(delivery.CursorError):
        delivery.deliver(df.limit(150), ["a", "b", "name"], "x", F.col("name"), delivery.Options(chunk_size=30, cursor=delivery.encode_cursor(30, 200, "0")), ("b",), orders)
    none = delivery.deliver(df.where("a > 9"), ["name"], "x", F.col("name"), delivery.Options(chunk_size=5), (), orders)
    assert none.rows == [] and none.total == 0 and not none.has_more
