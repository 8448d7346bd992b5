import pytest

from ferngraph.engine import Engine
from ferngraph.operators.resolve import NotFound
from ferngraph.sources import config
from ferngraph.sources.catalog import FactCatalog
from ferngraph.sources.gofacts import matches
from ferngraph.sources.gometrics import Complexity, halstead_tokens
from ferngraph.sources.gosyntax import GoSyntaxError, parse

FILES = {
    "go.mod": "module ex.com/shop\n\ngo 1.22\n",
    "main.go": """package main

import (
	"net/http"

	"ex.com/shop/core"
)

func init() {}

func main() {
	s := core.Store{Name: "x"}
	s.Save()
	go worker()
	go func() { helper() }()
	http.HandleFunc("/home", home)
	run(1)
}

func run(n int) int {
	if n > 3 {
		return n
	}
	return run(n + 1)
}

func worker() { c := &core.Store{}; c.Name = "w" }
func helper() {}
func home(w http.ResponseWriter, r *http.Request) {}
func deadCaller() { deadTarget() }
func deadTarget() {}
""",
    "core/core.go": """package core

import "fmt"

type Saver interface {
	Save() error
}

type Store struct {
	Name string
}

func (s *Store) Save() error {
	s.Name = "saved"
	fmt.Println(s.Name)
	return nil
}

type Wrapped struct {
	Store
}

func First(a []int) int {
	total := 0
	for _, x := range a {
		total += x
	}
	return total
}

func Second(a []int) int {
	total   := 0
	for _, x := range a {
		total += x
	}
	return   total
}
""",
    "core/core_test.go": "package core\n\nfunc broken( {\n",
    "api/api.go": """package api

import "ex.com/shop/core"

func Use(s core.Saver) error { return s.Save() }
""",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return Engine(spark), str(root)


def test_packages_and_types(shop):
    e, root = shop
    deps = e.get_package_dependencies(root, summary=True, export="mermaid")
    assert {r["package"]: r["imports"] for r in deps["items"]} == {"ex.com/shop": ["ex.com/shop/core"], "ex.com/shop/core": [], "ex.com/shop/api": ["ex.com/shop/core"]}
    assert deps["summary"]["total_imports"] == 2 and deps["graph"].startswith("%% package dependencies\ngraph LR")
    back = e.find_reverse_dependencies(root, "ex.com/shop/core", include_transitive=True)
    assert [r["package"] for r in back["items"]] == ["ex.com/shop", "ex.com/shop/api"] and back["transitive"] == []
    assert [r["struct"] for r in e.get_interface_topology(root, "Saver")["items"]] == ["Store", "Wrapped"]
    with pytest.raises(NotFound):
        e.get_interface_topology(root, "Nothing")
    broken = e.check_architecture_boundaries(root, [{"type": "forbid", "from": "ex.com/shop/api", "to": "ex.com/shop/"}])
    assert broken["violation_count"] == 1 and broken["items"][0]["line"] == 3
    assert e.check_architecture_boundaries(root)["items"] == [] and e.detect_import_cycles(root)["total"] == 0


def test_calls(shop):
    e, root = shop
    got = e.analyze_call_hierarchy(root, "main", 1, summary=True)
    assert {r["callee"] for r in got["items"]} == {"(*ex.com/shop/core.Store).Save", "ex.com/shop.worker", "ex.com/shop.run", "ex.com/shop.main$1", "net/http.HandleFunc"}
    assert got["summary"]["by_call_type"] == {"Goroutine": 2, "Static": 3}
    assert {r["caller"] for r in e.find_callers(root, "Store.Save")["items"]} == {"ex.com/shop.main", "ex.com/shop/api.Use"}
    assert e.find_call_path(root, "main", "run")["paths"] == [{"steps": ["ex.com/shop.main", "ex.com/shop.run"]}]
    assert e.find_call_path(root, "run", "main")["cutoff_reason"] == "no path found within depth limit"


def test_liveness_state_and_surfaces(shop):
    e, root = shop
    dead = {r["function"].rsplit(".", 1)[-1]: r["kind"] for r in e.find_dead_code(root)["items"]}
    assert dead["deadCaller"] == "unreferenced" and dead["deadTarget"] == "unreachable_from_entrypoint" and "worker" not in dead and "helper" not in dead
    kinds = [r["kind"] for r in e.list_entrypoints(root)["items"]]
    assert kinds == ["goroutine_start", "goroutine_start", "init", "main"]
    assert [(r["method"], r["path"], r["framework"], r["handler"]) for r in e.list_http_routes(root)["items"]] == [("ANY", "/home", "net/http", "home")]
    hops = e.trace_struct_lifecycle(root, "Store", summary=True)
    assert hops["summary"]["total_by_kind"] == {"Instantiate": 2, "FieldMutation": 3}
    assert [r["function"] for r in e.detect_concurrency_risks(root)["risks"]] == ["ex.com/shop.worker"]
    assert e.list_grpc_endpoints(root)["endpoints"] == []


def test_scores(shop):
    e, root = shop
    top = e.compute_complexity_metrics(root, include_packages=True, limit=1)
    assert top["items"][0]["function"] == "ex.com/shop.run" and top["items"][0]["cognitive"] == 2 and len(top["packages"]) == 3
    groups = e.find_duplicate_methods(root)["items"]
    assert [x["function"] for x in groups[0]["locations"]] == ["ex.com/shop/core.First", "ex.com/shop/core.Second"]
    page = e.compute_complexity_metrics(root, sort_by="name", chunk_size=4)
    rest = e.compute_complexity_metrics(root, sort_by="name", chunk_size=4, cursor=page["next_cursor"])
    assert len(page["items"]) == 4 and page["items"][-1]["function"] < rest["items"][0]["function"]


def test_cache(shop):
    e, root = shop
    assert e.cache_status()["entries"] == 1 and e.reload_workspace(root)["packages"] == 3
    assert e.clear_cache()["cleared"] == 1 and e.cache_status()["entries"] == 0
    with pytest.raises(LookupError):
        e.list_entrypoints(root, ["./nothing/..."])


def test_reload_parses_what_has_changed(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    e, root = Engine(spark), str(tmp_path)
    assert e.reload_workspace(root)["files"] == {"kept": 0, "parsed": 3, "dropped": 0}
    assert "deadCaller" in {r["function"].rsplit(".", 1)[-1] for r in e.find_dead_code(root)["items"]}
    (tmp_path / "main.go").write_text(FILES["main.go"].replace("func main() {", "func main() {\n\tdeadCaller()"))
    (tmp_path / "api/api.go").unlink()
    got = e.reload_workspace(root)
    assert got["files"] == {"kept": 1, "parsed": 1, "dropped": 1} and got["packages"] == 2
    assert "deadCaller" not in {r["function"].rsplit(".", 1)[-1] for r in e.find_dead_code(root)["items"]}
    assert {r["caller"] for r in e.find_callers(root, "Store.Save")["items"]} == {"ex.com/shop.main"}


def test_catalog_keeps_the_latest():
    made = []
    c = FactCatalog(lambda r, p: made.append((r, p)) or object(), 2)
    for p in ("a", "b", "a", "c", "a", "b"):
        c.get("/r", [p])
    assert [p for _, (p,) in made] == ["a", "b", "c", "b"] and c.status()["hits"] == 2
    c.get("/r", ["x", "y"])
    c.get("/r", ["y", "x"])
    assert len(made) == 5
    c.set_capacity(1)
    assert c.status()["entries"] == 1


def test_control_flow():
    src = """package x
func linear() { a := 1; _ = a }
func one(a bool) { if a { return } }
func boolean(a, b, c bool) { if a && b || c { return } }
func sw(n int) { switch n { case 1: return; case 2: return; default: return } }
func nested(n int) { for i := 0; i < n; i++ { if i > 2 { return } } }
func rec(n int) int { if n == 0 { return 0 }; return rec(n-1) }
func mixed(c chan int, m map[string][]T[int]) (r error) {
outer:
	for k, v := range m {
		select {
		case x, ok := <-c:
			_ = struct{ a int }{x}
			if !ok { continue outer } else if k == "" { goto done } else { v[0] = T[int]{a: 1} }
		default:
		}
	}
done:
	switch y := r.(type) { case nil: case *E: fallthrough; default: _ = y }
	return func() error { return r }()
}
"""
    got = {f.text: Complexity(f.text, f.kids[2]) for f in parse(src).kids}
    want = {"linear": (1, 0, 0), "one": (2, 1, 1), "boolean": (4, 3, 1), "sw": (3, 1, 1), "nested": (3, 3, 2), "rec": (2, 2, 1)}
    assert {k: (c.cyclomatic, c.cognitive, c.deepest) for k, c in got.items() if k in want} == want
    assert got["mixed"].cyclomatic == 7
    add = parse("package x\nfunc add(a, b int) int {\n\ttotal := a + b\n\treturn total\n}\n").kids[0]
    assert halstead_tokens(add.kids[2]) == [("operand", "a", 1), ("operand", "b", 1), ("operand", "total", 2), ("operator", "+", 1), ("operator", ":=", 1), ("operator", "return", 1)]
    with pytest.raises(GoSyntaxError):
        parse("package x\nfunc ( {\n")


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv(config.USER_ENV, str(tmp_path / "user.yml"))
    (tmp_path / "go.work").write_text("go 1.22\nuse (\n\t./a\n\t./b // two\n\t.\n)\n")
    for m in "ab":
        (tmp_path / m).mkdir()
        (tmp_path / m / "go.mod").write_text(f"module ex.com/{m}\n")
    assert config.suggest(str(tmp_path))["package_patterns"] == ["./a/...", "./b/..."]
    (tmp_path / "user.yml").write_text("output: {limit: 7, summary: true}\ncomplexity: {sort_by: name}\n")
    made = config.init(str(tmp_path))
    assert made["created"] and not made["overwritten"]
    with pytest.raises(config.ConfigError):
        config.init(str(tmp_path))
    (tmp_path / config.REPO_FILE).write_text("output: {limit: 9}\n")
    got = config.effective(str(tmp_path))
    assert got["output"]["limit"] == 9 and got["output"]["summary"] and got["complexity"]["sort_by"] == "name" and got["package_patterns"] == ["./a/...", "./b/..."]
    assert config.inspect(str(tmp_path))["sources"] == ["suggested", "user", "repo"]
    assert config.split_patterns(" ./a , ./b\n./a ") == ["./a", "./b"] and config.split_patterns("") == ["./..."]
    (tmp_path / config.REPO_FILE).write_text("a: [")
    with pytest.raises(config.ConfigError):
        config.effective(str(tmp_path))


def test_patterns():
    assert matches("a/b", ["./..."]) and matches("a/b", ["./a/..."]) and matches("a", ["./a/..."]) and matches("a", ["./a"])
    assert not matches("ab", ["./a/..."]) and not matches("a/b", ["./a"])


def test_following_a_folder(spark, tmp_path):
    from ferngraph.streaming import follow_facts

    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    for k in (1, 2):
        (src / f"f{k}.go").write_text(f"package p\nfunc F{k}() {{}}\n")
        follow_facts(spark, str(src), str(out), str(tmp_path / "c")).awaitTermination()
    assert {r.name for r in spark.read.parquet(str(out / "functions")).collect()} == {"F1", "F2"}
