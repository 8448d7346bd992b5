from ferngraph.operators import packages, surfaces, types

IMPORTS = "pkg_path string, import_path string, import_module string, file string, line int, ord int"
PACKAGES = "pkg_path string, module_path string, is_root boolean, first_file string"


def imports(spark, pairs):
    return spark.createDataFrame([(a, b, "", f"{a}.go", 3, 0) for a, b in pairs], IMPORTS)


def roots(spark, *names):
    return spark.createDataFrame([(n, "m", True, f"{n}/a.go") for n in names], PACKAGES)


def test_dependencies(spark):
    i = imports(spark, [("ex.com/app", "fmt"), ("ex.com/app", "ex.com/core"), ("ex.com/app", "ex.com/core")])
    p = roots(spark, "ex.com/app", "ex.com/core")
    rows = {r.package: r for r in packages.dependencies(p, i, include_stdlib=False).collect()}
    assert list(rows["ex.com/app"].imports) == ["ex.com/core"] and list(rows["ex.com/core"].imports) == []
    assert rows["ex.com/app"].anchor == "[Context Anchor] ex.com/app/a.go:1 ex.com/app"


def test_dependents(spark):
    i = imports(spark, [("app", "core"), ("util", "core"), ("mid", "app"), ("top", "mid")])
    assert {r.package for r in packages.direct_dependents(i, "core").collect()} == {"app", "util"}
    assert {r.package for r in packages.transitive_dependents(i, "core").collect()} == {"mid", "top"}
    assert packages.direct_dependents(i, "nothing").count() == 0


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "type string, `from` string, `to` string")


def test_boundaries(spark):
    i = imports(spark, [("infra", "domain"), ("api", "domain"), ("infra2", "domain"), ("infra/x", "fmt"), ("infra/x", "api")])
    p = roots(spark, "infra", "api", "domain", "infra2", "infra/x")
    found = packages.violations(i, p, rules(spark, ("forbid", "infra", "domain"))).collect()
    assert [(r["from"], r["import"], r.line) for r in found] == [("infra", "domain", 3)]
    found = packages.violations(i, p, rules(spark, ("allow_only", "infra/", "domain"))).collect()
    assert [(r["from"], r["import"]) for r in found] == [("infra/x", "api")]
    found = packages.violations(i, p, rules(spark, ("allow_prefix", "infra/", "dom"), ("forbid", "infra/", "fmt"))).collect()
    assert sorted((r["from"], r["import"], r.rule) for r in found) == [("infra/x", "api", "allow_prefix"), ("infra/x", "fmt", "forbid")]


def test_later_import_place_holds(spark):
    rows = [("a", "b", "", "x.go", 3, 0), ("a", "b", "", "y.go", 9, 1)]
    got = packages.import_locations(spark.createDataFrame(rows, IMPORTS)).collect()
    assert [(r.file, r.line) for r in got] == [("y.go", 9)]


def test_division(spark):
    structs = spark.createDataFrame([("p", t, "struct") for t in ("Base", "Buffered", "Other")], "pkg_path string, type_name string, kind string")
    sets = spark.createDataFrame([("p", "Base", "value", "Write", "()"), ("p", "Buffered", "ptr", "Write", "()"), ("p", "Buffered", "ptr", "Close", "()"), ("p", "Other", "value", "Write", "(int)")], "pkg_path string, type_name string, recv_kind string, method string, sig string")
    need = spark.createDataFrame([("Write", "()")], "method string, sig string")
    assert {r.type_name for r in types.implementors(structs, sets, need).collect()} == {"Base", "Buffered"}
    assert types.implementors(structs, sets, need.limit(0)).count() == 3


CALLS = "sel_name string, recv_ident string, recv_pkg string, n_args int, arg0_is_string boolean, arg0 string, arg1_kind string, arg1_name string, file string, line int"


def test_routes(spark):
    rows = [
        ("HandleFunc", "http", "", 2, True, '"/a"', "ident", "home", "m.go", 4),
        ("HandleFunc", "myMux", "", 2, True, "`/raw`", "func_lit", "", "m.go", 5),
        ("GET", "r", "github.com/labstack/echo/v4", 2, True, '"/b"', "selector", "h.B", "m.go", 6),
        ("Get", "r", "", 1, True, '"/one"', "ident", "x", "m.go", 7),
        ("Get", "r", "", 2, False, "x", "ident", "x", "m.go", 8),
        ("Fetch", "r", "", 2, True, '"/no"', "ident", "x", "m.go", 9),
    ]
    got = sorted((r.path, r.method, r.framework, r.handler) for r in surfaces.routes(spark.createDataFrame(rows, CALLS)).collect())
    assert got == [("/a", "ANY", "net/http", "home"), ("/b", "GET", "echo", "h.B"), ("`/raw`", "ANY", "gorilla/mux", "<inline>")]


def test_grpc(spark):
    services = spark.createDataFrame([("p1", "D", "alpha.Greeter"), ("p2", "D", "beta.Greeter")], "pkg_path string, desc_name string, service string")
    methods = spark.createDataFrame([("p1", "D", "Hi", False, False), ("p2", "D", "Chat", True, True)], "pkg_path string, desc_name string, method string, server_streams boolean, client_streams boolean")
    funcs = spark.createDataFrame([("p1", "RegisterGreeterServer", "D"), ("p2", "RegisterGreeterServer", "D")], "pkg_path string, func_name string, desc_name string")
    calls = spark.createDataFrame([("p1", "RegisterGreeterServer", 1, "&a{}"), ("p2", "RegisterGreeterServer", 2, "&b{}"), ("p2", "RegisterGreeterServer", 3, "&b{}")], "callee_pkg string, callee_name string, ord int, implementation string")
    regs = surfaces.registrations(calls, funcs, services)
    got = {r.service: r for r in surfaces.endpoints(services, methods, surfaces.implementations(regs)).collect()}
    assert list(got["alpha.Greeter"].implementations) == ["&a{}"] and list(got["beta.Greeter"].implementations) == ["&b{}"]
    assert got["beta.Greeter"].rpc_type == "bidi_stream" and got["alpha.Greeter"].full_method == "/alpha.Greeter/Hi" and got["alpha.Greeter"].registered
