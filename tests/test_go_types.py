"""What calls lead to, by types carried from expression to expression."""

import re

import pytest

from ferngraph.engine import Engine
from ferngraph.sources import goterms
from ferngraph.sources.gofacts import go_facts

A = """package a

type T struct{ next *T; kids []*T; by map[string]*T; f func(int) int }
type S struct{ T }

func (t *T) Next() *T { return t }
func (t *T) End() {}
func (t *T) Pair() (int, *T) { return 1, t }
func (t T) Value(n int) int { return n }
func (s *S) Only() {}
func New() *T { return nil }
func Dotted() {}
func Also() { hidden() }
func hidden() {}

type Kinds []*T

type Getter interface{ Get() int }
type Setter[V any] interface{ Set(v V) }

type Box[V any] struct{ v V; inner *T }

func (b *Box[V]) Get() V { return b.v }
func (b *Box[V]) Set(v V) { b.v = v; b.inner.End() }
func (b *Box[V]) Keep() *Box[V] { return b }
func Use(g Getter) int { return g.Get() }
func Put(s Setter[string]) { s.Set("x") }
func Wrap[V any](v V) *Box[V] { return &Box[V]{v: v} }
func Map[X, Y any](xs []X, f func(X) Y) []Y { var out []Y; for _, x := range xs { out = append(out, f(x)) }; return out }
func Outer[X any](xs []X, g func(X) *T) []*T { return Map(xs, g) }
"""
B = """package b

import "ex.com/g/a"
import other "ex.com/g/a"

type end interface{ End() }

func double(n int) int { return 2 * n }
func text(n int) string { return "" }
func made(n int) *a.T { return nil }
func spare(s string) string { return s }

func chain(c *a.T) { c.Next().Next().Next().Next().Next().Next().Next().Next().Next().Next().Next().Next().End() }
func ranges(m map[string]*a.T, k a.Kinds, c chan *a.T) {
	for _, v := range m { v.End() }
	for _, v := range k { v.Next() }
	for v := range c { v.Pair() }
}
func types(y any) {
	switch x := y.(type) {
	case *a.T: x.End()
	case *a.S: x.Only()
	case end: x.End()
	}
}
func values(c *a.T) { f := c.End; f() }
func several(c *a.T) { _, t := c.Pair(); t.End(); u, ok := c.Pair(); if ok != nil { ok.Next() }; _ = u }
func shadows(t *a.S) { { t := a.New(); t.End() }; t.Only(); if t := t.Next(); t != nil { t.Pair() }; a := t; a.Only(); func(t *other.T) { t.Value(1) }(nil) }
func index(k a.Kinds, m map[string][]*a.T) { k[0].End(); m["x"][1:][0].Next() }
func received(c chan *a.T) { (<-c).End() }
func expression(c *a.T) { f := (*a.T).End; f(c) }
func boxed() { b := &a.Box[int]{}; a.Use(b); a.Use(b.Keep()) }
func put() { a.Put(&a.Box[string]{}) }
func mapped(xs []int) { a.Map(xs, double); ys := a.Map(xs, made); ys[0].End() }
func wrapped(c *a.T) { a.Wrap(c).Get().End(); a.Wrap[*a.S](nil).Keep().Get().Only() }
func nested(xs []int) { for _, t := range a.Outer(xs, made) { t.Value(2) } }
func fields(t a.T) { t.next.next.kids[0].by["x"].End(); t.f(1) }
var table = map[string]*a.T{}
func global() { table["x"].Next() }
func conversion(k any) { a.Kinds(nil)[0].End(); k.(*a.T).Next() }
"""
C = """package c

import . "ex.com/g/a"
import "fmt"

func Dots(t *T) { Dotted(); Also(); t.End(); New().Next(); fmt.Println(len("x")) }
func Local() { Dotted := func(n int8) {}; Dotted(1) }
"""


def made(spark, **files):
    rows = [(f"/g/{k.replace('__', '/')}.go", bytearray(v.encode())) for k, v in files.items()]
    return go_facts(spark, "/g", None, [("", "ex.com/g")], spark.createDataFrame(rows, "path string, content binary"))


@pytest.fixture(scope="module")
def facts(spark):
    return made(spark, a__a=A, b__b=B, c__c=C)


@pytest.fixture(scope="module")
def edges(facts):
    out = {}
    for r in facts.call_edges().collect():
        out.setdefault(re.sub(r"ex\\.com/g/|ex.com/g/", "", r.caller), set()).add((re.sub(r"ex.com/g/", "", r.callee), r.call_type))
    return out


T = "(*a.T)"
STATIC = {
    "b.chain": {f"{T}.Next", f"{T}.End"},
    "b.ranges": {f"{T}.End", f"{T}.Next", f"{T}.Pair"},
    "b.several": {f"{T}.Pair", f"{T}.End", f"{T}.Next"},
    "b.index": {f"{T}.End", f"{T}.Next"},
    "b.received": {f"{T}.End"},
    "b.global": {f"{T}.Next"},
    "b.conversion": {f"{T}.End", f"{T}.Next"},
    "b.wrapped": {"a.Wrap", "(*a.Box).Get", "(*a.Box).Keep", f"{T}.End", "(*a.S).Only"},
    "b.nested": {"a.Outer", "(a.T).Value"},
    "b.mapped": {"a.Map", f"{T}.End"},
    "b.boxed": {"a.Use", "(*a.Box).Keep"},
    "c.Dots": {"a.Dotted", "a.Also", f"{T}.End", "a.New", f"{T}.Next", "fmt.Println"},
    "(*a.Box).Set": {f"{T}.End"},
    "a.Outer": {"a.Map"},
}


@pytest.mark.parametrize("caller", STATIC)
def test_static_edges(edges, caller):
    assert {f for f, kind in edges[caller] if kind == "Static"} == STATIC[caller]


def test_edges_through_interfaces_and_instances(edges):
    assert edges["a.Use"] == {("(*a.Box).Get", "Interface")}  # by Box[int], and by it alone
    assert edges["a.Put"] == {("(*a.Box).Set", "Interface")}
    assert edges["b.types"] == {(f"{T}.End", "Static"), ("(*a.S).Only", "Static"), (f"{T}.End", "Interface")}


def test_edges_of_function_values(edges):
    by_sig = {f for f, _ in edges["a.Map"]}
    assert {"b.double", "b.made"} <= by_sig and "b.spare" not in by_sig and "b.text" not in by_sig
    assert f"{T}.End" in {f for f, _ in edges["b.values"]} and f"{T}.End" in {f for f, _ in edges["b.expression"]}
    assert "b.double" in {f for f, _ in edges["b.fields"]} and f"{T}.End" in {f for f, _ in edges["b.fields"]}
    assert edges["c.Local"] == {("c.Local$1", "Static")}  # not the one that the dot import brings


def test_scopes(edges):
    assert {f for f, k in edges["b.shadows"] if k == "Static"} >= {"a.New", f"{T}.End", "(*a.S).Only", f"{T}.Next", f"{T}.Pair"}
    assert edges["b.shadows$1"] == {("(a.T).Value", "Static")}


def test_nothing_called_is_dead(spark, tmp_path):
    for name, text in (("a/a.go", A), ("b/b.go", B), ("c/c.go", C)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "go.mod").write_text("module ex.com/g\n")
    (tmp_path / "main.go").write_text('package main\n\nimport (\n\t"ex.com/g/b"\n\t"ex.com/g/c"\n)\n\nfunc main() { b.All(); c.Dots(nil); c.Local() }\n')
    calls = "; ".join(f"{n}({'nil' if a else ''})" if n != "ranges" and n != "index" else f"{n}({'nil, nil, nil' if n == 'ranges' else 'nil, nil'})" for n, a in re.findall(r"^func (\w+)\(([^)]*)\) \{$|^func (\w+)\(([^)]*)\) \{ [^r]", B, re.M) and [(m[1], m[2]) for m in re.finditer(r"^func (\w+)\(([^)]*)\)", B, re.M)] if n not in ("double", "text", "made", "spare"))
    (tmp_path / "b/all.go").write_text(f"package b\n\nfunc All() {{ {calls} }}\n")
    dead = {r["function"].replace("ex.com/g/", "") for r in Engine(spark).find_dead_code(str(tmp_path), include_exported=True)["items"]}
    assert dead == {"b.text", "b.spare"}


def test_terms():
    assert goterms.listed("a,func(b,c)(d),map[e]f[g,h]") == ["a", "func(b,c)(d)", "map[e]f[g,h]"] and goterms.listed("") == []
    assert goterms.owner("**x/y.Box[int,[]string]") == "x/y.Box" and goterms.arguments("*x/y.Box[int,[]string]") == ["int", "[]string"]
    assert goterms.owner("[]x.T") == "[]x.T" and goterms.arguments("map[string]x.T") == []
    assert goterms.bound("func([]%0,func(%0)(%1),...%2)()", 0, "[]x.T") == {"%0": "x.T"}
    assert goterms.bound("func([]%0,func(%0)(%1),...%2)()", 1, "func(int)(*x.T)") == {"%0": "int", "%1": "*x.T"}
    assert goterms.bound("func([]%0,func(%0)(%1),...%2)()", 4, "string") == {"%2": "string"}
    assert goterms.bound("func(map[%0]x.Box[%1])()", 0, "map[string]x.Box[int]") == {"%0": "string", "%1": "int"}
    assert goterms.bound("func(%0)()", 0, "") == {"%0": ""} and goterms.bound("func()()", 0, "int") == {}
    assert goterms.instances("map[string][]x/a.Box[y.Pair[int,string]]") == ["x/a.Box[y.Pair[int,string]]", "y.Pair[int,string]"]
    step = goterms.step
    assert step("ret", "func(int)(string,error)", "", 1, None, None) == "error" and step("ret", "func()()", "", 0, None, None) == ""
    assert step("mret", "x.Box[int]", "Get", 0, "func()($0,error)", None) == "int" and step("sel", "*x.Box[int]", "v", 0, "[]$0", None) == "[]int"
    assert step("value", "x.Kinds[int]", "", 0, None, "[]*$0") == "*int" and step("key", "map[string]int", "", 0, None, None) == "string"
    assert step("value", "func(func(int,string)(bool))()", "", 0, None, None) == "string" and step("elem", "string", "", 0, None, None) == "byte"
    assert step("recv", "chan *x.T", "", 0, None, None) == "*x.T" and step("star", "type:x.T", "", 0, None, None) == "type:*x.T"
    assert step("sel", "interface{End()();Next()(int)}", "Next", 0, None, None) == "func()(int)"
