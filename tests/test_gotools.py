"""The tools over a small code base (tests/gotree.py), with stated results."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferngraph.operators import delivery, resolve
from ferngraph.sources import catalog, config, gofacts
from ferngraph.sources.gofacts import SLICE, _extract, go_facts, import_name, matches, normal_patterns, unquoted
from tests.gotree import tree

SHOP = "ex.com/shop"
CASES: dict[str, tuple] = {}


def states(schema: str, rows: list[tuple], name: str = ""):
    """A stated result; f(engine, folder) gives tuples, in any order."""

    def register(f):
        CASES[name or f.__name__] = f, rows
        return f

    return register


def _items(found: dict, *columns: str) -> list[tuple]:
    return [tuple(r.get(c) for c in columns) for r in found["items"]]


def p(*names: str) -> list[str]:
    return [f"{SHOP}{n}" for n in names]


# packages

_IMPORTS = {"": "core store", "/cmd/serve": "core rpc", "/core": "", "/ring/a": "ring/b", "/ring/b": "ring/a", "/rpc": "", "/store": "core"}
_OTHERS = {"": "github.com/go-chi/chi/v5 github.com/labstack/echo/v4", "/cmd/serve": "google.golang.org/grpc", "/rpc": "google.golang.org/grpc"}
_STDLIB = {"": "fmt net/http", "/core": "fmt", "/store": "io sync sync/atomic"}
_FILES = {"": "main.go", "/cmd/serve": "cmd/serve/main.go", "/core": "core/core.go", "/ring/a": "ring/a/a.go", "/ring/b": "ring/b/b.go", "/rpc": "rpc/rpc.go", "/store": "store/store.go"}


def _listed(k: str, stdlib: bool) -> str:
    own = [f"{SHOP}/{x}" for x in _IMPORTS[k].split()]
    return ",".join(sorted(own + _OTHERS.get(k, "").split() + (_STDLIB.get(k, "").split() if stdlib else [])))


for _name, _std in (("go_dependencies", False), ("go_dependencies_stdlib", True)):
    states("package string, imports string, file string, line long", [(SHOP + k, _listed(k, _std), _FILES[k], 1) for k in _IMPORTS], _name)(
        lambda e, root, std=_std: [(a, ",".join(b), c, d) for a, b, c, d in _items(e.get_package_dependencies(root, include_stdlib=std), "package", "imports", "file", "line")]
    )


@states("key string, n long", [("packages", 7), ("imports", 17), *((SHOP + k, len(_listed(k, True).split(",")) if _listed(k, True) else 0) for k in _IMPORTS)])
def go_dependency_summary(e, root):
    s = e.get_package_dependencies(root, include_stdlib=True, summary=True, limit=2)["summary"]
    return [("packages", s["total_packages"]), ("imports", s["total_imports"]), *s["imports_by_package"].items()]


@states("package string, total long, truncated boolean", [(f"{SHOP}/cmd/serve", 7, True), (f"{SHOP}/core", 7, True)])
def go_dependency_window(e, root):
    found = e.get_package_dependencies(root, offset=1, limit=2)
    return [(r["package"], found["total"], found["truncated"]) for r in found["items"]]


@states("page long, package string", [(1, f"{SHOP}"), (1, f"{SHOP}/cmd/serve"), (1, f"{SHOP}/core"), (2, f"{SHOP}/ring/a"), (2, f"{SHOP}/ring/b"), (2, f"{SHOP}/rpc"), (3, f"{SHOP}/store")])
def go_dependency_cursor(e, root):
    rows, cursor, page = [], "", 1
    while page == 1 or cursor:
        found = e.get_package_dependencies(root, chunk_size=3, cursor=cursor)
        rows += [(page, r["package"]) for r in found["items"]]
        cursor, page = found["next_cursor"], page + 1
    return rows


@states("kind string, package string", [("direct", SHOP), ("direct", f"{SHOP}/cmd/serve"), ("direct", f"{SHOP}/store")])
def go_dependents(e, root):
    found = e.find_reverse_dependencies(root, f"{SHOP}/core", include_transitive=True)
    return [("direct", r["package"]) for r in found["items"]] + [("transitive", x) for x in found["transitive"]]


@states("kind string, package string", [("direct", f"{SHOP}/cmd/serve"), ("direct", f"{SHOP}/rpc")])
def go_dependents_of_a_library(e, root):
    found = e.find_reverse_dependencies(root, "google.golang.org/grpc", include_transitive=True, limit=5)
    return [("direct", r["package"]) for r in found["items"]] + [("transitive", x) for x in found["transitive"]]


@states("members string", [(f"{SHOP}/ring/a,{SHOP}/ring/b",)])
def go_import_cycles(e, root):
    return [(",".join(c["members"]),) for c in e.detect_import_cycles(root)["cycles"]]


_RULES = [{"type": "forbid", "from": f"{SHOP}/store", "to": f"{SHOP}/core"}, {"type": "allow_only", "from": f"{SHOP}/cmd/", "to": f"{SHOP}/core"}, {"type": "allow_prefix", "from": SHOP, "to": f"{SHOP}/c"}]


@states(
    "from string, import string, rule string, to string, file string, line long",
    [
        (f"{SHOP}/store", f"{SHOP}/core", "forbid", f"{SHOP}/core", "store/store.go", 8),
        (f"{SHOP}/cmd/serve", f"{SHOP}/rpc", "allow_only", f"{SHOP}/core", "cmd/serve/main.go", 7),
        (SHOP, f"{SHOP}/store", "allow_prefix", f"{SHOP}/c", "main.go", 11),
    ],
)
def go_boundaries(e, root):
    return _items(e.check_architecture_boundaries(root, _RULES), "from", "import", "rule", "to", "file", "line")


@states("violation_count long, checked_packages long, without_rules long", [(3, 7, 0)])
def go_boundary_totals(e, root):
    found = e.check_architecture_boundaries(root, _RULES, limit=1)
    return [(found["violation_count"], found["checked_packages"], e.check_architecture_boundaries(root)["total"])]


# types

_SAVERS = [("/cmd/serve", "server", 10), ("/core", "Deep", 25), ("/core", "Item", 9), ("/core", "Other", 39), ("/core", "Wrapped", 21)]
_DISKS = [("/store", "Disk", 25), ("/store", "Tape", 35)]
for _name, _asked, _patterns, _found in (
    ("go_topology", "Saver", None, _SAVERS),
    ("go_topology_narrow", "Saver", ["./core"], [x for x in _SAVERS if x[0] == "/core"]),
    ("go_topology_embedded", "RW", None, _DISKS),
    ("go_topology_standard", "Streams", None, _DISKS),
    ("go_topology_qualified", f"{SHOP}/store.W", None, _DISKS),
    ("go_topology_rpc", "GreeterServer", None, [("/cmd/serve", "server", 10)]),
):
    states("package string, struct string, line long", [(SHOP + a, b, c) for a, b, c in _found], _name)(
        lambda e, root, asked=_asked, patterns=_patterns: _items(e.get_interface_topology(root, asked, patterns), "package", "struct", "line")
    )


# calls

ITEM, OTHER, NOTIFY = f"(*{SHOP}/core.Item).Save", f"({SHOP}/core.Other).Save", f"(*{SHOP}/core.Owner).Notify"
DISK = f"(*{SHOP}/store.Disk)"
_EDGES = [
    (f"{SHOP}.init", f"{SHOP}.build", "Static", 14),
    (f"{SHOP}.init$1", f"{SHOP}.first", "Static", 14),
    (f"{SHOP}.build", f"{SHOP}.init$1", "Static", 16),
    (f"{SHOP}.build", f"{SHOP}.first", "Static", 16),
    (f"{SHOP}.main", ITEM, "Static", 25),
    (f"{SHOP}.main", f"{SHOP}.worker", "Goroutine", 26),
    (f"{SHOP}.main", f"{SHOP}.worker", "Goroutine", 27),
    (f"{SHOP}.main", f"{SHOP}.main$1", "Goroutine", 28),
    (f"{SHOP}.main$1", f"{SHOP}.helper", "Static", 28),
    (f"{SHOP}.main", "net/http.HandleFunc", "Static", 29),
    (f"{SHOP}.main", "github.com/go-chi/chi/v5.NewRouter", "Static", 30),
    (f"{SHOP}.main", "fmt.Println", "Static", 37),
    (f"{SHOP}.newWeb", "github.com/labstack/echo/v4.New", "Static", 40),
    (ITEM, "fmt.Println", "Static", 16),
    (f"{DISK}.counted", "sync/atomic.AddInt64", "Static", 48),
    (f"{SHOP}/cmd/serve.main", "google.golang.org/grpc.NewServer", "Static", 15),
    (f"{SHOP}.main", f"{SHOP}.newWeb", "Static", 33),
    (f"{SHOP}.main", f"{SHOP}.keep", "Static", 35),
    (f"{SHOP}.main", f"{SHOP}.run", "Static", 36),
    (f"{SHOP}.keep", ITEM, "Interface", 42),
    (f"{SHOP}.keep", OTHER, "Interface", 42),
    (f"{SHOP}.run", f"{DISK}.Write", "Interface", 46),
    (f"{SHOP}.run", f"{SHOP}.run", "Static", 49),
    (f"{SHOP}.deadCaller", f"{SHOP}.deadTarget", "Static", 54),
    (ITEM, NOTIFY, "Static", 17),
    (f"{SHOP}/store.Start", f"{DISK}.locked", "Goroutine", 56),
    (f"{SHOP}/store.Start", f"{DISK}.counted", "Goroutine", 57),
    (f"{SHOP}/store.Start", f"{DISK}.loose", "Goroutine", 58),
    (f"{SHOP}/store.Start", ITEM, "Interface", 60),
    (f"{SHOP}/store.Start", OTHER, "Interface", 60),
    (f"{SHOP}/store.Start", f"{SHOP}/store.shut", "Static", 61),
    (f"{SHOP}/store.shut", f"({SHOP}/store.Disk).Close", "Interface", 65),
    (f"{SHOP}/cmd/serve.main", f"{SHOP}/rpc.RegisterGreeterServer", "Static", 16),
    (f"{SHOP}/ring/a.A", f"{SHOP}/ring/b.B", "Static", 5),
    (f"{SHOP}/ring/b.B", f"{SHOP}/ring/a.A", "Static", 5),
]


@states("caller string, callee string, call_type string, line long", _EDGES)
def go_call_edges(e, root):
    return e._facts(root, None).call_edges().select("caller", "callee", "call_type", "line").collect()


_ONE = [(1, *x) for x in _EDGES if x[0] == f"{SHOP}.main" and x[3] != 27]
_TWO = [(2, *x) for x in _EDGES if x[0] in (ITEM, f"{SHOP}.keep", f"{SHOP}.main$1", f"{SHOP}.run", f"{SHOP}.newWeb", f"{SHOP}.worker")]
for _name, _depth, _rows in (("go_hierarchy_d1", 1, _ONE), ("go_hierarchy_d2", 2, _ONE + _TWO)):
    states("depth long, caller string, callee string, call_type string, line long", _rows, _name)(
        lambda e, root, depth=_depth: _items(e.analyze_call_hierarchy(root, f"{SHOP}.main", depth), "depth", "caller", "callee", "call_type", "line")
    )


@states("what string, key string, n long", [("by_call_type", "Goroutine", 2), ("by_call_type", "Static", 7), ("by_caller", f"{SHOP}.main", 9), *(("by_callee", x[2], 1) for x in _ONE), ("total", "", 9)])
def go_hierarchy_summary(e, root):
    s = e.analyze_call_hierarchy(root, f"{SHOP}.main", 1, summary=True)["summary"]
    return [(k, x, n) for k in ("by_call_type", "by_caller", "by_callee") for x, n in s[k].items()] + [("total", "", s["total_edges"])]


_CALLERS = [(1, ITEM, NOTIFY), (2, f"{SHOP}.keep", ITEM), (2, f"{SHOP}.main", ITEM), (2, f"{SHOP}/store.Start", ITEM)]
for _name, _asked in (("go_callers", "Owner.Notify"), ("go_callers_pointer", "(*Owner).Notify"), ("go_callers_folded", "owner.notify"), ("go_callers_full", NOTIFY)):
    states("depth long, caller string, callee string", _CALLERS, _name)(lambda e, root, asked=_asked: _items(e.find_callers(root, asked, 2), "depth", "caller", "callee"))


@states("path string", [(" > ".join((f"{SHOP}.main", ITEM, NOTIFY)),), (" > ".join((f"{SHOP}.main", f"{SHOP}.keep", ITEM, NOTIFY)),)])
def go_call_paths(e, root):
    return [(" > ".join(x["steps"]),) for x in e.find_call_path(root, f"{SHOP}.main", "Notify")["paths"]]


@states("asked string, n long, reason string", [("one", 1, "reached max_paths limit of 1"), ("none", 0, "no path found within depth limit"), ("itself", 0, "no path found within depth limit")])
def go_call_path_cutoffs(e, root):
    asked = {"one": (f"{SHOP}.main", "Notify", 8, 1), "none": ("worker", "Notify", 8, 5), "itself": ("run", "run", 8, 5)}
    found = {k: e.find_call_path(root, *x) for k, x in asked.items()}
    return [(k, len(x["paths"]), x["cutoff_reason"]) for k, x in found.items()]


@states("asked string, outcome string", [("main", "Ambiguous"), ("Nowhere", "NotFound"), ("Item.Save", ITEM), ("core.First", f"{SHOP}/core.First"), ("FIRST", "Ambiguous"), ("storage.Start", f"{SHOP}/store.Start")])
def go_function_names(e, root):
    found = []
    for asked in ("main", "Nowhere", "Item.Save", "core.First", "FIRST", "storage.Start"):
        try:
            found.append((asked, resolve.resolve(e._facts(root, None)["functions"], asked)))
        except LookupError as x:
            found.append((asked, type(x).__name__))
    return found


# state

_HOPS = [
    ("FieldMutation", "Name", ITEM, "core/core.go", 15),
    ("FieldMutation", "Name", f"{SHOP}.main", "main.go", 24),
    ("Instantiate", "", f"{SHOP}.main", "main.go", 24),
    ("InterfaceHandoff", "", f"{SHOP}.main", "main.go", 35),
    ("InterfaceHandoff", "", f"{SHOP}.main", "main.go", 37),
    ("FieldMutation", "Name", f"{SHOP}.worker", "main.go", 52),
    ("Instantiate", "", f"{SHOP}.worker", "main.go", 52),
    ("Instantiate", "", f"{SHOP}/store.Start", "store/store.go", 59),
    ("InterfaceHandoff", "", f"{SHOP}/store.Start", "store/store.go", 59),
]
for _mode, _keep in (("none", range(9)), ("function_field", (0, 1, 2, 5, 6, 7)), ("function_kind_field", (0, 1, 2, 3, 5, 6, 7, 8))):
    states("kind string, field string, function string, file string, line long", [_HOPS[k] for k in _keep], f"go_lifecycle_{_mode}")(
        lambda e, root, mode=_mode: _items(e.trace_struct_lifecycle(root, "Item", dedupe_mode=mode), "kind", "field", "function", "file", "line")
    )


@states("hops long, total long, truncated boolean", [(2, 9, True)])
def go_lifecycle_cap(e, root):
    found = e.trace_struct_lifecycle(root, "Item", max_hops=2)
    return [(len(found["items"]), found["total_before_truncate"], found["truncated"])]


@states("what string, key string, n long", [("kind", "FieldMutation", 3), ("kind", "Instantiate", 3), ("kind", "InterfaceHandoff", 3), ("function", ITEM, 1), ("function", f"{SHOP}.main", 4), ("function", f"{SHOP}.worker", 2), ("function", f"{SHOP}/store.Start", 2), ("field", "Name", 3)])
def go_lifecycle_summary(e, root):
    s = e.trace_struct_lifecycle(root, "Item", summary=True)["summary"]
    return [(what, k, n) for what in ("kind", "function", "field") for k, n in s[f"total_by_{what}"].items()]


@states("struct string, field string, function string, line long", [(f"{SHOP}/core.Item", "Name", f"{SHOP}.worker", 52), (f"{SHOP}/core.Item", "Name", f"{SHOP}.worker", 52), (f"{SHOP}/store.Disk", "size", f"{DISK}.loose", 52)])
def go_risks(e, root):
    return [(r["struct"], r["field"], r["function"], r["line"]) for r in e.detect_concurrency_risks(root)["risks"]]


# surfaces

_STARTS = [
    ("goroutine_start", SHOP, f"{SHOP}.main$1", 28),
    ("goroutine_start", SHOP, f"{SHOP}.worker", 26),
    *(("goroutine_start", f"{SHOP}/store", f"{DISK}.{m}", n) for m, n in (("locked", 56), ("counted", 57), ("loose", 58))),
    ("init", SHOP, f"{SHOP}.init", 19),
    ("main", SHOP, f"{SHOP}.main", 23),
    ("main", f"{SHOP}/cmd/serve", f"{SHOP}/cmd/serve.main", 14),
]
for _name, _patterns, _packages in (("go_entrypoints", None, None), ("go_entrypoints_narrow", ["./store"], [f"{SHOP}/store"])):
    states("kind string, package string, function string, line long", [x for x in _STARTS if not _packages or x[1] in _packages], _name)(
        lambda e, root, patterns=_patterns: _items(e.list_entrypoints(root, patterns), "kind", "package", "function", "line")
    )


@states("method string, path string, handler string, framework string, line long", [("ANY", "/home", "home", "net/http", 29), ("GET", "/items", "core.List", "chi", 31), ("ANY", "`/raw`", "<inline>", "chi", 32), ("GET", "/web", "<unknown>", "echo", 34)])
def go_routes(e, root):
    return _items(e.list_http_routes(root), "method", "path", "handler", "framework", "line")


@states("routes long", [(0,)])
def go_routes_narrow(e, root):
    return [(e.list_http_routes(root, ["./core/..."])["total"],)]


@states("service string, method string, rpc_type string, full_method string, registered boolean, implementations string, line long", [("shop.v1.Greeter", m, kind, f"/shop.v1.Greeter/{m}", True, "&server{}", 5) for m, kind in (("Hello", "unary"), ("Talk", "bidi_stream"), ("Feed", "server_stream"))])
def go_grpc_endpoints(e, root):
    return [(r["service"], r["method"], r["rpc_type"], r["full_method"], r["registered"], ",".join(r["implementations"]), r["line"]) for r in e.list_grpc_endpoints(root)["endpoints"]]


@states("service string, method string, implementation string, file string, line long", [("shop.v1.Greeter", "RegisterGreeterServer", "&server{}", "cmd/serve/main.go", 16)])
def go_grpc_registrations(e, root):
    return [tuple(r[c] for c in ("service", "method", "implementation", "file", "line")) for r in e.list_grpc_endpoints(root)["registrations"]]


@states("desc string, service string, method string, handler string, is_stream boolean, proto string", [("Greeter_ServiceDesc", "shop.v1.Greeter", m, f"_Greeter_{m}", m != "Hello", "greeter.proto") for m in ("Hello", "Talk", "Feed")])
def go_grpc_descriptors(e, root):
    facts = e._facts(root, None)
    return facts["grpc_services"].join(facts["grpc_methods"], ["pkg_path", "desc_name"]).select("desc_name", "service", "method", "handler", "is_stream", "proto_file").collect()


# liveness and scores

_DEAD = [
    *(("unreferenced", x, exported) for x, exported in ((f"{SHOP}.deadCaller", False), (f"(*{SHOP}/cmd/serve.server).Hello", False), (f"{SHOP}/core.First", True), (f"{SHOP}/core.List", True), (f"{SHOP}/core.Second", True), (f"{SHOP}/core.unused", False), (f"{DISK}.Read", True), (f"({SHOP}/store.Bare).Close", True), (f"{SHOP}/store.Start", True))),
    *(("unreachable_from_entrypoint", x, exported) for x, exported in ((f"{SHOP}.deadTarget", False), (f"{SHOP}/ring/a.A", True), (f"{SHOP}/ring/b.B", True), (f"({SHOP}/store.Disk).Close", True), (f"{SHOP}/store.shut", False))),
]
for _name, _exported in (("go_dead_code", False), ("go_dead_code_exported", True)):
    states("kind string, function string, exported boolean", [x for x in _DEAD if _exported or not x[2]], _name)(
        lambda e, root, exported=_exported: _items(e.find_dead_code(root, include_exported=exported), "kind", "function", "exported")
    )


@states("signature string, body_lines long, count long, locations string", [("([]int)(int)", 7, 2, f"{SHOP}/core.First:47,{SHOP}/core.Second:55")])
def go_duplicates(e, root):
    return [(r["signature"], r["body_lines"], r["count"], ",".join(f"{x['function']}:{x['line']}" for x in r["locations"])) for r in e.find_duplicate_methods(root)["items"]]


_SCORES = [
    (f"{SHOP}/core.unused", 6, 7, 3, 13),
    (f"{SHOP}.run", 3, 3, 1, 7),
    (f"{SHOP}/core.First", 2, 1, 1, 7),
    (f"{SHOP}/core.Second", 2, 1, 1, 7),
]


@states("function string, cyclomatic long, cognitive long, max_nesting long, body_lines long", _SCORES)
def go_complexity(e, root):
    return _items(e.compute_complexity_metrics(root, limit=4), "function", "cyclomatic", "cognitive", "max_nesting", "body_lines")


@states("function string, cyclomatic long, cognitive long", [x[:3] for x in _SCORES[:2]])
def go_complexity_thresholds(e, root):
    return _items(e.compute_complexity_metrics(root, min_cyclomatic=3, min_cognitive=3), "function", "cyclomatic", "cognitive")


@states("function string, volume double, difficulty double, maintainability double", [(f"{SHOP}.first", 2.0, 0.5, 97.76), (f"{SHOP}.helper", 0.0, 0.0, 99.87)])
def go_halstead(e, root):
    rows = e.compute_complexity_metrics(root, ["."], sort_by="name")["items"]
    return [(r["function"], r["volume"], r["difficulty"], r["maintainability"]) for r in rows if r["function"] in p(".first", ".helper")]


@states("package string, functions long, total_cyclomatic long, total_cognitive long, max_function string", [(f"{SHOP}/core", 7, 14, 9, f"{SHOP}/core.unused"), (SHOP, 12, 14, 3, f"{SHOP}.run")])
def go_package_rollup(e, root):
    return [tuple(r[c] for c in ("package", "functions", "total_cyclomatic", "total_cognitive", "max_function")) for r in e.compute_complexity_metrics(root, include_packages=True, limit=1)["packages"][:2]]


# facts

@states("package string, name string, file string", [(SHOP + k, {"": "main", "/cmd/serve": "main", "/store": "storage"}.get(k, k.rsplit("/", 1)[-1]), f) for k, f in _FILES.items()])
def go_files(e, root):
    return e._facts(root, None)["files"].select("pkg_path", "pkg_name", "file").collect()


@states("file string, line long", [("core/bad.go", 3)])
def go_unreadable_files(e, root):
    return [(r.file, int(r.message.split()[1].rstrip(":"))) for r in e._facts(root, None)["errors"].collect()]


_TYPES = {"core": {"Saver": "interface", "Item": "struct", "Wrapped": "struct", "Deep": "struct", "Hidden": "struct", "Both": "struct", "Other": "struct", "Owner": "struct"}, "store": {"R": "interface", "W": "interface", "RW": "interface", "Streams": "interface", "Disk": "struct", "Tape": "struct", "Bare": "struct"}, "rpc": {"GreeterServer": "interface"}, "cmd/serve": {"server": "struct"}}


@states("package string, type string, kind string", [(f"{SHOP}/{k}", t, kind) for k, ts in _TYPES.items() for t, kind in ts.items()])
def go_types(e, root):
    return e._facts(root, None)["types"].select("pkg_path", "type_name", "kind").collect()


_SAVE = {"Item": "ptr", "Wrapped": "ptr", "Deep": "value ptr", "Other": "value ptr"}


@states("type string, recv_kind string", [(t, k) for t, ks in _SAVE.items() for k in ks.split()])
def go_method_sets(e, root):
    """Of Save: promoted through values and pointers, hidden by a field, lost to a tie."""
    return e._facts(root, None).method_sets().where(f"pkg_path = '{SHOP}/core' and method = 'Save'").select("type_name", "recv_kind").collect()


@states("import_path string, name string", [("github.com/go-chi/chi/v5", "chi"), ("gopkg.in/yaml.v3", "yaml"), ("net/http", "http"), ("v2", "v2")])
def go_import_names(e, root):
    return [(x, import_name(x)) for x in ("github.com/go-chi/chi/v5", "gopkg.in/yaml.v3", "net/http", "v2")]


@states("literal string, meaning string", [('"a\\tb"', "a\tb"), ("`a\\tb`", "a\\tb"), ('"\\u00e9"', "é"), ('"plain"', "plain")])
def go_string_literals(e, root):
    return [(x, unquoted(x)) for x in ('"a\\tb"', "`a\\tb`", '"\\u00e9"', '"plain"')]


@states("tool string, is_error boolean, says string", [("detect_import_cycles", False, "1"), ("find_callers", True, "function not found: Nowhere"), ("nothing", True, "unknown tool nothing"), ("list_entrypoints", True, "no Go packages match ./none/...")])
def go_results_as_json(e, root):
    cycles = json.loads(e.run("detect_import_cycles", root=root))
    callers, unknown = json.loads(e.run("find_callers", root=root, function="Nowhere")), json.loads(e.run("nothing", root=root))
    none = json.loads(e.run("list_entrypoints", root=root, patterns=["./none/..."]))
    return [("detect_import_cycles", cycles["is_error"], str(cycles["result"]["total"])), ("find_callers", callers["is_error"], callers["error"]), ("nothing", unknown["is_error"], unknown["error"].split(";")[0]), ("list_entrypoints", none["is_error"], none["error"].split(" in ")[0])]


# cache and configuration

@states("step string, entries long, cleared long", [("loaded", 1, 0), ("again", 1, 0), ("cleared", 0, 1), ("reloaded", 1, 0)])
def go_cache(e, root):
    from ferngraph.engine import Engine

    own, out = Engine(e.spark), []
    for step, cleared in (("loaded", 0), ("again", 0), ("cleared", 1), ("reloaded", 0)):
        n = own.clear_cache(root)["cleared"] if cleared else own.reload_workspace(root, ["./ring/..."])["packages"] * 0 if step == "reloaded" else own._facts(root, ["./ring/..."]) and 0
        out.append((step, own.cache_status()["entries"], n))
    own.clear_cache()
    return out


@states("reloaded boolean, packages long", [(True, 2)])
def go_reload(e, root):
    found = e.reload_workspace(root, ["./ring/..."])
    e.clear_cache(root, ["./ring/..."])
    return [(found["reloaded"], found["packages"])]


@states("asked string, hits long, misses long", [("a", 0, 1), ("b", 0, 2), ("a", 1, 2), ("c", 1, 3), ("b", 1, 4), ("c", 2, 4)])
def go_cache_order(e, root):
    kept, out = catalog.FactCatalog(lambda r, k: object(), 2), []
    for x in "abacbc":
        kept.get("/r", [x])
        out.append((x, kept.hits, kept.misses))
    return out


@states("key string, value string", [("mode", "module"), ("module", SHOP), ("patterns", "./..."), ("sources", "suggested"), ("yaml", "version: 1")])
def go_configuration(e, root):
    made, seen = e.suggest_workspace_config(root), e.inspect_workspace_config(root)
    return [("mode", made["config"]["workspace"]["mode"]), ("module", made["config"]["modules"][0]["path"]), ("patterns", ",".join(seen["effective"]["package_patterns"])), ("sources", ",".join(x for x in seen["sources"] if x != "user")), ("yaml", made["yaml"].splitlines()[0])]


@states("step string, outcome string", [("written", "True False"), ("again", "ConfigError"), ("replaced", "False True"), ("limit", "3"), ("patterns", "./..."), ("switch", "True")])
def go_configuration_file(e, root):
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as top:  # on the driver, where configuration is read
        (Path(top) / "go.mod").write_text("module ex.com/one\n")
        flags = lambda x: f"{x['created']} {x['overwritten']}"
        out = [("written", flags(e.init_workspace_config(top)))]
        try:
            e.init_workspace_config(top)
        except config.ConfigError as x:
            out.append(("again", type(x).__name__))
        out.append(("replaced", flags(e.init_workspace_config(top, overwrite=True))))
        (Path(top) / config.REPO_FILE).write_text("output: {limit: 3, max_items: -1, summary: true}\npackage_patterns: []\n")
        made = config.merge(config.suggest(top), config.load(Path(top) / config.REPO_FILE))
        return [*out, ("limit", str(made["output"]["limit"])), ("patterns", ",".join(made["package_patterns"])), ("switch", str(made["output"]["summary"]))]


@states("given string, patterns string", [("", "./..."), (" ./a , ./b\n./a ", "./a|./b"), ("./core/...", "./core/..."), ("core", "./core"), ("/abs/core", "./core"), (".", "."), ("./...", "./..."), ("./missing/...", "./missing/...")])
def go_patterns(e, root):
    given = ("", " ./a , ./b\n./a ", "./core/...", "core", "/abs/core", ".", "./...", "./missing/...")
    return [(x, "|".join(normal_patterns(root, [y.replace("/abs", root) for y in config.split_patterns(x)]))) for x in given]


@states("folder string, pattern string, matched boolean", [("a/b", "./...", True), ("a/b", "./a/...", True), ("a", "./a", True), ("ab", "./a/...", False), ("a/b", "./a", False), ("", ".", True), ("a", ".", False)])
def go_pattern_matches(e, root):
    return [(a, b, matches(a, [b])) for a, b in (("a/b", "./..."), ("a/b", "./a/..."), ("a", "./a"), ("ab", "./a/..."), ("a/b", "./a"), ("", "."), ("a", "."))]


# diagrams


def _graph(form: str):
    return lambda e, root: [(k, x) for k, x in enumerate(e.find_reverse_dependencies(root, f"{SHOP}/core", export=form)["graph"].splitlines())]


_LABELS = (f"{SHOP}/core", SHOP, f"{SHOP}/cmd/serve", f"{SHOP}/store")
_STYLES = ["  classDef violation fill:#fdd,stroke:#c00,color:#900", "  classDef root fill:#dfd,stroke:#080", "  classDef target fill:#ddf,stroke:#008", "  class n0 target"]
_MERMAID = [f"%% dependents of {SHOP}/core", "graph LR", *(f'  n{k}["{x}"]' for k, x in enumerate(_LABELS)), *(f"  n{k} --> n0" for k in (1, 2, 3)), *_STYLES]
_DOT = ["digraph dependentsofexcomshopcore {", "  rankdir=LR;", f'  n0 [label="{_LABELS[0]}", group="target"];', *(f'  n{k} [label="{x}"];' for k, x in enumerate(_LABELS) if k), *(f"  n{k} -> n0;" for k in (1, 2, 3)), "}"]
for _form, _lines in (("mermaid", _MERMAID), ("dot", _DOT)):
    states("n long, line string", list(enumerate(_lines)), f"go_diagram_{_form}")(_graph(_form))


@states("id string, label string, kind string", [(f"n{k}", x, "target" if not k else "") for k, x in enumerate(_LABELS)])
def go_diagram_json(e, root):
    g = json.loads(e.find_reverse_dependencies(root, f"{SHOP}/core", export="json-graph")["graph"])
    return [(n["id"], n["label"], n.get("class", "")) for n in g["nodes"]]


@states("asked string, format string", [("MMD", "mermaid"), (" graphviz ", "dot"), ("json_graph", "json-graph"), ("", ""), ("png", "ValueError")])
def go_diagram_formats(e, root):
    out = []
    for x in ("MMD", " graphviz ", "json_graph", "", "png"):
        try:
            out.append((x, delivery.parse_format(x)))
        except ValueError as error:
            out.append((x, type(error).__name__))
    return out


@states("cursor string, outcome string", [("good", "3 7 ab"), ("not base64", "invalid cursor encoding"), ("not json", "invalid cursor payload"), ("old", "unsupported cursor version 2")])
def go_cursors(e, root):
    import base64

    raw = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    out = []
    for name, cursor in (("good", delivery.encode_cursor(3, 7, "ab")), ("not base64", "***"), ("not json", raw("[")), ("old", raw('{"v":2,"o":1,"t":1,"f":""}'))):
        try:
            c = delivery.decode_cursor(cursor)
            out.append((name, f"{c['o']} {c['t']} {c['f']}"))
        except delivery.CursorError as x:
            out.append((name, str(x)))
    return out



@pytest.mark.parametrize("name", CASES)
def test_tools_over_the_code_base(spark, name):
    f, rows = CASES[name]
    assert sorted(repr(tuple(r)) for r in f(*tree(spark))) == sorted(map(repr, rows))


def made(spark, **files):
    rows = [(f"/x/{k.replace('__', '/')}.go", bytearray(v.encode())) for k, v in files.items()]
    return go_facts(spark, "/x", None, [("", "ex.com/x")], spark.createDataFrame(rows, "path string, content binary"))


def test_values_of_functions_and_fields(spark):
    facts = made(
        spark,
        a="package x\ntype T struct{ f func(int) bool; in *U }\ntype U struct{}\nfunc (u *U) Go() *T { return nil }\nfunc even(int) bool { return true }\nfunc odd(n int) bool { return false }\nfunc other() {}\n"
        "func Use(t T, g func(int) bool) { t.f(1); g(2); t.in.Go().in.Go(); h := even; h(3) }\n",
    )
    edges = {(r.caller.rsplit(".", 1)[-1], r.callee.rsplit(".", 1)[-1]) for r in facts.call_edges().collect()}
    assert edges == {("Use", "even"), ("Use", "odd"), ("Use", "Go")}


def test_interfaces_that_arent_known(spark):
    facts = made(spark, a="package x\nimport \"other.org/y\"\ntype I interface{ y.Z; M() }\ntype A struct{}\nfunc (A) M() {}\ntype N interface{}\n")
    assert {r.method for r in facts.needs("ex.com/x", "I").collect()} == {"M", "?other.org/y.Z"} and facts.needs("ex.com/x", "N").count() == 0


def test_packages_named_unlike_their_folders(spark):
    facts = made(spark, a='package x\nimport "ex.com/x/go-lib"\nfunc F() { lib.G() }\n', **{"go-lib__l": "package lib\nfunc G() {}\n"})
    assert [(r.caller, r.callee) for r in facts.call_edges().collect()] == [("ex.com/x.F", "ex.com/x/go-lib.G")]


def test_facts_of_many_files_come_in_slices():
    text = "package a\n\nfunc F(a int) int {\n" + "\ta = a + 1\n" * 20 + "\treturn a\n}\n"
    files = pd.DataFrame([(f"/x/f{k}.go", text.encode()) for k in range(1_000)], columns=["path", "content"])
    frames = list(_extract("/x", [("", "m")], ["./..."])(iter([files])))
    assert max(map(len, frames)) < SLICE + 1_000 < sum(map(len, frames))
    assert set().union(*(set(f["path"]) for f in frames)) == set(files["path"])


def test_sources_are_dealt_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(gofacts, "SOURCE", 1_000)
    rows = [(f"/x/p{k}/a.go", f"package p{k}\n\nfunc F() {{\n{'// a line of text' * 20}\n}}\n".encode()) for k in range(60)]
    facts = go_facts(spark, "/x", None, [("", "m")], spark.createDataFrame(rows, "path string, content binary"))
    tasks = facts.parsed.where("kind = 'files'").select(F.input_file_name().alias("f")).distinct().count()
    assert tasks > 8 and facts["functions"].count() == 60


def test_sources_are_dealt_by_their_bytes_whatever_the_joins(spark, monkeypatch):
    """Sources, and facts that are kept, also where joins shuffle: these have the
    session's number of parts, 4 here, unless both sides are dealt alike."""
    monkeypatch.setattr(gofacts, "SOURCE", 1_000)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(f"/x/p{k}/a.go", f'package p{k}\n\nimport . "x/p{k + 1}"\n\nfunc F{k}() {{\n{"// a line of text" * 20}\n}}\n'.encode()) for k in range(60)]
        files = spark.createDataFrame(rows, "path string, content binary")
        before = go_facts(spark, "/x", None, [("", "x")], files)
        after = go_facts(spark, "/x", None, [("", "x")], files.where("path <> '/x/p7/a.go'"), before)
        for facts, n in ((before, 60), (after, 59)):
            tasks = facts.parsed.where("kind = 'files'").select(F.input_file_name().alias("f")).distinct().count()
            assert tasks > 8 and facts["functions"].count() == n
        states = gofacts.changed_files(before, after).groupBy("state").count().collect()
        assert {r["state"]: r["count"] for r in states} == {"kept": 58, "dropped": 1, "parsed": 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
