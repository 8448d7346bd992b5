"""Fact tables of a Go code base, by Spark: files are read in parallel, each is
parsed on its own, and every fact table is a projection of the parsed rows.

Without a type checker, a file's facts say of each expression which other it is
made of and how, and from where to where a local name means what. Joins tell
what names mean and carry types from expression to expression
(sources/gotypes.py). What stays open, such as values from packages that aren't
read, has an empty target. Facts made elsewhere can be given instead (FactSet).
"""

from __future__ import annotations

import ast
import gc
import json
import os
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.operators.packages import all_packages
from ferngraph.plans.graphs import checkpointed, cut, written_by
from ferngraph.shipping import BATCH, give_back, ship
from ferngraph.sources.gometrics import Complexity, halstead_tokens
from ferngraph.sources.gosyntax import GoSyntaxError, Node, parse
from ferngraph.sources.goterms import owner
from ferngraph.sources.gotypes import PREDECLARED, FactSet

#: Every table but the last also has pkg_path and is_root: the package a fact is from, and whether it was asked for.
SCHEMAS = {
    "files": "pkg_name string, module_path string, file string",
    "imports": "import_path string, import_module string, file string, line int, ord int",
    "functions": "fn_id string, name string, pkg_name string, recv_type string, synthetic string, parent_fn string, origin_fn string, params array<string>, result string, sig string, file string, line int",
    "calls": "caller string, callee string, fun string, recv string, call_type string, callee_str string, method_name string, file string, line int, site_ord int",
    "go_sites": "fn_id string, target string, fun string, recv string, method_name string, target_kind string, file string, line int, ord int",
    "instrs": "fn_id string, ord int, op string, struct string, sym string, field string, iface_param boolean, file string, line int",
    "handoffs": "fn_id string, ord int, sym string, fun string, arg int, target string, file string, line int",
    "exprs": "eid string, file string, fn string, op string, base string, name string, k int, alt string, at int",
    "defs": "file string, name string, value string, at int, low int, high int",
    "names": "name string, what string, value string",
    "types": "type_name string, kind string, under string, file string, line int, ord int",
    "methods": "type_name string, recv_kind string, method string, sig string, result string, fn_id string",
    "fields": "type_name string, field string, type string",
    "embeds": "type_name string, embedded string, pointer boolean, in_interface boolean",
    "iface_methods": "iface string, method string, sig string, result string",
    "func_bodies": "function string, package string, receiver string, name string, signature string, body_text string, body_lines int, file string, line int, ord int",
    "control_flow": "function string, package string, cyclomatic long, cognitive long, max_nesting long, body_lines long, file string, line int, ord int",
    "halstead_tokens": "fn_id string, kind string, token string, cnt int",
    "route_calls": "sel_name string, recv_ident string, recv string, recv_pkg string, n_args int, arg0_is_string boolean, arg0 string, arg1_kind string, arg1_name string, file string, line int",
    "grpc_services": "desc_name string, service string, handler_type string, proto_file string, file string, line int",
    "grpc_methods": "desc_name string, method string, handler string, is_stream boolean, server_streams boolean, client_streams boolean",
    "grpc_register_funcs": "func_name string, desc_name string",
    "grpc_register_calls": "callee_pkg string, callee_name string, callee_expr string, registrar string, implementation string, file string, line int, ord int",
    "errors": "file string, message string",
}
for _name in SCHEMAS:
    if _name != "errors":
        SCHEMAS[_name] = "pkg_path string, is_root boolean, " + SCHEMAS[_name]

#: Facts of packages; with those of declarations; with all but texts and metrics of bodies.
PACKAGES = frozenset(("files", "imports"))
DECLARED = PACKAGES | frozenset(("functions", "types", "methods", "fields", "embeds", "iface_methods", "grpc_services", "grpc_methods", "grpc_register_funcs", "grpc_register_calls"))
CODE = frozenset(SCHEMAS) - {"func_bodies", "control_flow", "halstead_tokens"}
#: Facts that name expressions.
_FLOW = CODE - DECLARED - {"errors"}

# Functions of the language, operators that give a bool.
_BUILTIN = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())
_LOGIC = frozenset(("==", "!=", "<", "<=", ">", ">=", "&&", "||"))
#: Nodes whose names end with them.
_SCOPES = frozenset("block if for range switch typeswitch case comm".split())
_VERSION = re.compile(r"v[0-9]+")


def import_name(path: str) -> str:
    """The name an import has by its path: the last segment that is no major
    version, without the version of a gopkg.in path."""
    parts = path.split("/")
    last = parts[-2] if len(parts) > 1 and _VERSION.fullmatch(parts[-1]) else parts[-1]
    return re.sub(r"\.v[0-9]+$", "", last)


def unquoted(literal: str) -> str:
    """What a string literal means."""
    if literal[:1] == "`":
        return literal[1:-1].replace("\r", "")
    try:
        return ast.literal_eval(literal)
    except (SyntaxError, ValueError):
        return literal.strip('"')


class _File:
    """Facts of one parsed file. Expressions get ids, and say of which other
    expression they are made; what names mean and of what type expressions are,
    joins tell (sources/gotypes.py)."""

    def __init__(self, src: str, path: str, pkg_path: str, module: str, is_root: bool, named: dict[str, str], dots: dict[str, str], kinds: frozenset[str] = frozenset(SCHEMAS)):
        self.kinds, self.flow = kinds, not kinds.isdisjoint(_FLOW)  # facts that are asked for
        self.src, self.path, self.pkg, self.module, self.root, self.named, self.dots = src, path, pkg_path, module, is_root, named, dots
        self.out: list[tuple[str, dict]] = []
        self.ord = self.n = 0
        self.closures: dict[str, int] = {}
        self.sites: dict[str, int] = {}
        self.ids: dict[tuple[int, int], str] = {}
        self.params: dict[str, str] = {}  # type parameters in scope
        self.fn = ""

    def add(self, table: str, /, **row) -> None:
        if table in self.kinds:
            self.out.append((table, {"pkg_path": self.pkg, "is_root": self.root} | row))

    def text(self, n: Node | None) -> str:
        return self.src[n.at : n.stop] if n is not None else ""

    def run(self) -> list[tuple[str, dict]]:
        tree = parse(self.src)
        self.name = tree.text
        self.add("files", pkg_name=self.name, module_path=self.module, file=self.path)
        self.aliases: dict[str, str] = {}
        for d in tree.kids:
            if d.kind == "decl" and d.text == "import":
                for k, s in enumerate(d.kids):
                    if s.names[0] not in (".", "_"):
                        self.aliases[s.names[0] or self.named.get(s.text) or import_name(s.text)] = s.text
                    own = self.module if self.module and (s.text == self.module or s.text.startswith(self.module + "/")) else ""
                    self.add("imports", import_path=s.text, import_module=own, file=self.path, line=s.line, ord=k)
        if self.kinds <= PACKAGES | {"errors"}:
            return self.out
        for d in tree.kids:
            if d.kind == "func":
                self.function(d)
            elif d.kind == "decl" and d.text == "type":
                for s in d.kids:
                    self.type(s)
            elif d.kind == "decl" and d.text in ("var", "const"):
                for s in d.kids:
                    if d.text == "var":
                        self.descriptor(s)
                    self.variable(s)
        return self.out

    # types

    def spelled(self, n: Node | None) -> str:
        """A type expression as a term."""
        if n is None:
            return ""
        kids = n.kids
        match n.kind:
            case "ident":
                if n.text in self.params:
                    return self.params[n.text]
                return n.text if n.text in PREDECLARED else "interface{}" if n.text == "any" else f"{self.dots.get(n.text, self.pkg)}.{n.text}"
            case "sel" if kids[0].kind == "ident":
                return f"{self.aliases.get(kids[0].text, kids[0].text)}.{n.text}"
            case "star":
                return "*" + self.spelled(kids[0])
            case "paren":
                return self.spelled(kids[0])
            case "index":
                return f"{self.spelled(kids[0])}[{','.join(map(self.spelled, kids[1:]))}]"
            case "array":
                return f"[{self.text(kids[0])}]{self.spelled(kids[1])}"
            case "ellipsis":
                return "..." + self.spelled(kids[0])
            case "map":
                return f"map[{self.spelled(kids[0])}]{self.spelled(kids[1])}"
            case "chan":
                return f"chan {self.spelled(kids[0])}"
            case "functype":
                return "func" + self.signature(n, self.spelled)
            case "interface":
                return "interface{" + ";".join(sorted(f.names[0] + self.signature(f.kids[0], self.spelled) if f.names else self.spelled(f.kids[0]) for f in kids[0].kids)) + "}"
        return "".join(self.text(n).split())

    def signature(self, sig: Node, one=None) -> str:
        """Parameter and result types, each by `one`; as written, if it isn't given."""
        one = one or (lambda n: "".join(self.text(n).split()))
        return "".join(f"({','.join(one(k) for k in self.listed(side))})" for side in sig.kids)

    @staticmethod
    def listed(fields: Node | None) -> list[Node]:
        """A type expression for each parameter or result."""
        return [f.kids[0] for f in (fields.kids if fields else []) for _ in range(max(1, len(f.names)))]

    def result(self, sig: Node) -> str:
        first = self.listed(sig.kids[1])[:1]
        return self.spelled(first[0]) if first else ""

    def type(self, s: Node) -> None:
        kind = s.kids[0]
        what = {"struct": "struct", "interface": "interface"}.get(kind.kind, "other")
        self.params = {x: f"${k}" for k, x in enumerate(s.names)}
        self.ord += 1
        under = self.spelled(kind) if what == "other" else ""
        self.add("types", type_name=s.text, kind=what, under=under, file=self.path, line=s.line, ord=self.ord)
        self.add("names", name=f"{self.pkg}.{s.text}", what="type", value=f"type:{self.pkg}.{s.text}")
        for f in kind.kids[0].kids if what != "other" else []:
            if what == "interface" and f.names:
                self.add("iface_methods", iface=s.text, method=f.names[0], sig=self.signature(f.kids[0], self.spelled), result=self.result(f.kids[0]))
            elif not f.names and f.kids[0].kind != "union":
                name = self.spelled(f.kids[0])
                self.add("embeds", type_name=s.text, embedded=name.lstrip("*"), pointer=name.startswith("*"), in_interface=what == "interface")
                if what == "struct":
                    self.add("fields", type_name=s.text, field=owner(name).rpartition(".")[2], type=name)
            else:
                for x in f.names:
                    self.add("fields", type_name=s.text, field=x, type=self.spelled(f.kids[0]))
        self.params = {}

    # expressions

    def made(self, op: str, base: str = "", name: str = "", k: int = 0, alt: str = "", at: int = 0) -> str:
        """A new expression, made by op from the one with the id base."""
        self.n += 1
        eid = f"{self.path}#{self.n}"
        if self.flow:
            self.add("exprs", eid=eid, file=self.path, fn=self.fn, op=op, base=base, name=name, k=k, alt=alt, at=at)
        return eid

    def kind(self, term: str) -> str:
        """An expression of a type that is stated."""
        return self.made("type", name=term) if term else ""

    def _inner(self, n: Node) -> Node | None:
        """The expression that another is made of, if it is made of one."""
        match n.kind:
            case "paren" | "star" | "slice" | "index":
                return n.kids[0]
            case "unary":
                return n.kids[0] if n.text != "!" else None
            case "binary":
                return None if n.text in _LOGIC else n.kids[1] if n.kids[0].kind == "lit" else n.kids[0]
            case "sel":
                return None if self.imported(n) else n.kids[0]
            case "call":
                fun = n.kids[0]
                if fun.kind == "ident" and fun.text in _BUILTIN:
                    return n.kids[1] if fun.text == "append" and len(n.kids) > 1 else None
                return fun.kids[0] if fun.kind == "sel" and not self.imported(fun) else fun
        return None

    def imported(self, n: Node) -> bool:
        """Whether a selector may take from an imported package."""
        return n.kids[0].kind == "ident" and n.kids[0].text in self.aliases

    def expr(self, n: Node | None, k: int = 0) -> str:
        """The id of an expression, or of its k-th result; empty if nothing is
        known of it. Long chains are followed without recursion."""
        if not self.flow:
            return ""
        chain: list[Node] = []
        while n is not None and (id(n), k if not chain else 0) not in self.ids:
            chain.append(n)
            n = self._inner(n)
        eid = self.ids[(id(n), 0 if chain else k)] if n is not None else ""
        for i, n in enumerate(reversed(chain)):
            of = k if i == len(chain) - 1 else 0
            eid = self.ids[(id(n), of)] = self._one(n, eid, of)
        return eid

    def _one(self, n: Node, base: str, k: int) -> str:
        """The id of an expression of which the inner one is known."""
        kids = n.kids
        if k and n.kind in ("index", "assert") or k and n.kind == "unary":
            return self.kind("bool")
        match n.kind:
            case "ident":
                return "" if n.text in ("_", "nil") else self.made("name", name=n.text, alt=f"{self.dots.get(n.text, self.pkg)}.{n.text}" if n.text not in self.params else f"={self.params[n.text]}", at=n.at)
            case "lit":
                return self.kind({'"': "string", "`": "string", "'": "rune"}.get(n.text[:1], "int" if n.text.isdigit() or n.text[:2].lower() in ("0x", "0b", "0o") else "float64"))
            case "funclit":
                return self.kind("func" + self.signature(kids[0], self.spelled))
            case "composite":
                return self.kind(self.spelled(kids[0]))
            case "assert":
                return self.kind(self.spelled(kids[1]))
            case "array" | "map" | "chan" | "functype" | "interface" | "struct":
                return self.kind("type:" + self.spelled(n))
            case "paren":
                return base
            case "sel" if self.imported(n):
                return self.made("sel", self.expr(kids[0]), n.text, alt=f"{self.aliases[kids[0].text]}.{n.text}")
            case "call" if kids[0].kind == "ident" and kids[0].text in _BUILTIN:
                kind = kids[0].text
                if kind in ("new", "make"):
                    return self.kind("*" * (kind == "new") + self.spelled(kids[1])) if len(kids) > 1 else ""
                return self.made("same", base) if kind == "append" and base else self.kind("int" if kind in ("len", "cap", "copy") else "")
            case "call":
                fun = kids[0]
                if fun.kind == "sel" and not self.imported(fun):
                    return self.made("mret", base, fun.text, k) if base else ""
                return self.made("ret", base, "", k) if base else ""
        op = {"star": "star", "slice": "same", "index": "elem", "sel": "sel", "binary": "same"}.get(n.kind) or {"&": "addr", "<-": "recv"}.get(n.text, "same")
        if n.kind == "binary" and n.text in _LOGIC or n.kind == "unary" and n.text == "!":
            return self.kind("bool")
        return self.made(op, base, n.text if n.kind == "sel" else ",".join(map(self.spelled, kids[1:])) if n.kind == "index" else "") if base else ""

    # functions

    def function(self, d: Node) -> None:
        recv, sig, body = d.kids
        held = recv.kids[0].kids[0] if recv and recv.kids else None
        inner = held.kids[0] if held is not None and held.kind in ("star", "paren") else held
        self.params = {x.text: f"${k}" for k, x in enumerate(inner.kids[1:])} if inner is not None and inner.kind == "index" else {x: f"%{k}" for k, x in enumerate(d.names)}
        kind = self.spelled(held) if held is not None else ""
        plain = "*" * kind.startswith("*") + owner(kind)
        short = owner(kind).rsplit(".", 1)[-1]
        fn = f"({plain}).{d.text}" if kind else f"{self.pkg}.{d.text}"
        whole = self.spelled(sig)
        self.ord += 1
        self.add("functions", fn_id=fn, name=d.text, pkg_name=self.name, recv_type=plain, synthetic="", parent_fn="", origin_fn="", params=[self.spelled(k) for k in self.listed(sig.kids[0])], result=self.result(sig), sig="" if kind or d.names else whole, file=self.path, line=d.line)
        if kind:
            self.add("methods", type_name=short, recv_kind="ptr" if kind.startswith("*") else "value", method=d.text, sig=self.signature(sig, self.spelled), result=self.result(sig), fn_id=fn)
        elif d.text not in ("init", "_"):
            self.add("names", name=fn, what="func", value=f"{'generic:' if d.names else ''}{whole}")
        if body is not None:
            lines = body.end - body.line + 1
            where = {"package": self.pkg, "file": self.path, "line": d.line, "ord": self.ord}
            self.add("func_bodies", function=fn, receiver=short, name=d.text, signature=self.signature(sig), body_text=self.text(body), body_lines=lines, **where)
            if "control_flow" in self.kinds:
                c = Complexity(d.text, body)
                self.add("control_flow", function=fn, cyclomatic=c.cyclomatic, cognitive=c.cognitive, max_nesting=c.deepest, body_lines=lines, **where)
            for k, token, n in halstead_tokens(body) if "halstead_tokens" in self.kinds else []:
                self.add("halstead_tokens", fn_id=fn, kind=k, token=token, cnt=n)
            if d.text.startswith("Register") and d.text.endswith("Server") and len(d.text) > 14 and not kind:
                self.register_function(d.text, body)
            self.fn = fn
            self.parameters(recv, body)
            self.body(body, fn, sig)
        self.params = {}

    def define(self, name: str, value: str, at: int, scope: Node) -> None:
        """A local name that means a value from a place to the end of its scope."""
        if name != "_":
            self.add("defs", file=self.path, name=name, value=value, at=at, low=scope.at, high=scope.stop)

    def parameters(self, fields: Node | None, body: Node) -> None:
        for f in fields.kids if fields else []:
            for name in f.names:
                self.define(name, self.kind(self.spelled(f.kids[0])), body.at, body)

    def variable(self, s: Node) -> None:
        """A package's variables and constants; what values call runs in its init."""
        self.fn = f"{self.pkg}.init"
        known = self.kind(self.spelled(s.kids[0])) if s.kids[0] is not None else ""
        for name, value in zip(s.names, self.values(s.names, s.kids[1:]), strict=False):
            self.add("names", name=f"{self.pkg}.{name}", what="var", value=known or value)
        for value in s.kids[1:]:
            self.body(value, self.fn, None)

    def values(self, names: list, values: list[Node]) -> list[str]:
        """An expression for each of the names that values are given to."""
        if len(values) == 1 and len(names) > 1:
            only = values[0].kids[0] if values[0].kind == "paren" else values[0]
            return [self.expr(only, k) for k in range(len(names))]
        return [self.expr(v) for v in values] + [""] * (len(names) - len(values))

    def local(self, n: Node, scope: Node) -> None:
        """Names that a declaration or an assignment defines."""
        if n.kind == "valuespec" and n.kids[0] is not None:
            kind = self.spelled(n.kids[0])
            known = self.kind(kind)
            for name in n.names:
                self.define(name, known, n.stop, scope)
            if len(n.kids) == 1:
                self.instruction("Alloc", kind, "", n)
            for value in n.kids[1:]:
                self.handoff(value, n, target=kind)
        elif n.kind == "valuespec":
            for name, value in zip(n.names, self.values(n.names, n.kids[1:]), strict=False):
                self.define(name, value, n.stop, scope)
        elif n.text == ":=":
            left, right = n.kids[0].kids, n.kids[1].kids
            for a, value in zip(left, self.values(left, right), strict=False):
                if a.kind == "ident":
                    self.define(a.text, value, n.stop, scope)

    def ranged(self, n: Node) -> None:
        """Names of a range, from its body on."""
        for place, op in ((0, "key"), (1, "value")):
            name = n.kids[place]
            if n.text == ":=" and name is not None and name.kind == "ident":
                x = self.expr(n.kids[2])
                self.define(name.text, self.made(op, x) if x else "", n.kids[3].at, n)

    def switched(self, n: Node) -> None:
        """The name of a type switch: of the clause's type, if it lists one."""
        if n.kids[1] is None or n.kids[1].kind != "assign":
            return
        name, x = n.kids[1].kids[0].kids[0].text, self.expr(n.kids[1].kids[1].kids[0].kids[0])
        for clause in n.kids[2:]:
            kinds = clause.kids[0].kids
            one = len(kinds) == 1 and not (kinds[0].kind == "ident" and kinds[0].text == "nil")
            self.define(name, self.kind(self.spelled(kinds[0])) if one else x, clause.at, clause)

    def body(self, body: Node, fn: str, sig: Node | None) -> None:
        """Facts of statements in the order of the source."""
        self.fn = fn
        if sig is not None:
            self.parameters(sig.kids[0], body)
            self.parameters(sig.kids[1], body)
        todo: list[tuple[Node | None, str, Node]] = [(body, "", body)]
        while todo:
            n, role, scope = todo.pop()
            if n is None:
                continue
            if n.kind in _SCOPES:
                scope = n
            if n.kind in ("valuespec", "assign"):
                self.local(n, scope)
            elif n.kind == "range":
                self.ranged(n)
            elif n.kind == "typeswitch":
                self.switched(n)
            if n.kind == "composite" and n.kids[0] is not None and n.kids[0].kind in ("ident", "sel", "index"):
                kind = self.spelled(n.kids[0])
                self.instruction("Alloc", kind, "", n)
                for e in n.kids[1:]:
                    if e.kind == "kv" and e.kids[0].kind == "ident":  # a field of a literal is stored like any other
                        self.instruction("Store", kind, e.kids[0].text, e)
            for target in n.kids[0].kids if n.kind == "assign" and n.text != ":=" else n.kids if n.kind == "incdec" else []:
                if target.kind == "sel":
                    self.instruction("Store", "", target.text, target, self.expr(target.kids[0]))
            if n.kind == "return" and sig is not None:
                for value, kind in zip(n.kids, self.listed(sig.kids[1]), strict=False):
                    self.handoff(value, n, target=self.spelled(kind))
            if n.kind == "funclit":
                self.closures[fn] = self.closures.get(fn, 0) + 1
                inner = f"{fn}${self.closures[fn]}"
                self.add("functions", fn_id=inner, name=inner.rsplit(".", 1)[-1], pkg_name=self.name, recv_type="", synthetic="", parent_fn=fn, origin_fn="", params=[], result="", sig=self.spelled(n.kids[0]), file=self.path, line=n.line)
                self.body(n.kids[1], inner, n.kids[0])
                self.fn = fn
                continue
            if n.kind == "call":
                self.call(n, role)
            elif n.kind == "sel":
                self.expr(n)  # a method may be taken as a value here
            for kid in reversed(n.kids):
                todo.append((kid, "go" if n.kind == "go" else "", scope))

    def instruction(self, op: str, struct: str, name: str, n: Node, sym: str = "") -> None:
        if struct or sym:
            self.ord += 1
            self.add("instrs", fn_id=self.fn, ord=self.ord, op=op, struct=owner(struct), sym=sym, field=name, iface_param=False, file=self.path, line=n.line)

    def handoff(self, value: Node, n: Node, target: str = "", fun: str = "", arg: int = 0) -> None:
        """A value that goes where an interface may be."""
        sym = self.expr(value)
        if sym:
            self.ord += 1
            self.add("handoffs", fn_id=self.fn, ord=self.ord, sym=sym, target=target, fun=fun, arg=arg, file=self.path, line=n.line)

    def call(self, n: Node, role: str) -> None:
        fun, args, fn = n.kids[0], n.kids[1:], self.fn
        while fun.kind == "paren":
            fun = fun.kids[0]
        whole = fun  # with type arguments
        while fun.kind in ("index", "paren"):
            fun = fun.kids[0]
        site = self.sites[fn] = self.sites.get(fn, 0) + 1
        method = recv = ""
        closure, builtin = fun.kind == "funclit", fun.kind == "ident" and fun.text in _BUILTIN
        sym = "" if closure or builtin else self.expr(whole)
        if fun.kind == "sel":
            method = fun.text
            recv = self.expr(fun.kids[0])
        if builtin and fun.text == "new" and args:
            self.instruction("Alloc", self.spelled(args[0]), "", n)
        written = f"{self.aliases[fun.kids[0].text]}.{fun.text}" if fun.kind == "sel" and self.imported(fun) else self.text(fun)
        goal = f"{fn}${self.closures.get(fn, 0) + 1}" if closure else ""
        where = {"file": self.path, "line": n.line}
        if role == "go":
            self.add("go_sites", fn_id=fn, target=goal, fun=sym, recv=recv, method_name=method, target_kind="closure" if closure else "dynamic", ord=site, **where)
        self.add("calls", caller=fn, callee=goal, fun=sym, recv=recv, call_type="Goroutine" if role == "go" else "Static", callee_str=written, method_name=method, site_ord=site, **where)
        for k, a in enumerate(args):
            self.handoff(a, n, fun=sym, arg=k)
        if fun.kind == "sel":
            ident = fun.kids[0].text if fun.kids[0].kind == "ident" else ""
            a1 = args[1] if len(args) > 1 else None
            kind = {"ident": "ident", "sel": "selector", "funclit": "func_lit"}.get(a1.kind, "other") if a1 is not None else ""
            literal = bool(args) and args[0].kind == "lit" and args[0].text[:1] in "\"`"
            name = (self.text(a1) if kind == "ident" or a1.kids[0].kind == "ident" else a1.text) if kind in ("ident", "selector") else ""
            self.add("route_calls", sel_name=fun.text, recv_ident=ident, recv=recv, recv_pkg="", n_args=len(args), arg0_is_string=literal, arg0=args[0].text if literal else "", arg1_kind=kind, arg1_name=name, **where)
        name = written.rsplit(".", 1)[-1]
        if name.startswith("Register") and name.endswith("Server") and len(name) > 14 and len(args) >= 2:
            pkg = written.rpartition(".")[0] if fun.kind == "sel" and self.imported(fun) else self.dots.get(name, self.pkg)
            self.add("grpc_register_calls", callee_pkg=pkg, callee_name=name, callee_expr=self.text(fun), registrar=self.text(args[0]), implementation=self.text(args[1]), ord=n.at, **where)

    # gRPC descriptors

    def descriptor(self, s: Node) -> None:
        for name, value in zip(s.names, s.kids[1:], strict=False):
            if value.kind == "unary" and value.text == "&":
                value = value.kids[0]
            kind = value.kids[0] if value.kind == "composite" else None
            while kind is not None and kind.kind in ("array", "star"):
                kind = kind.kids[-1]
            if kind is None or kind.text != "ServiceDesc":
                continue
            fields = {e.kids[0].text: e.kids[1] for e in value.kids[1:] if e.kind == "kv"}
            string = lambda n: unquoted(n.text) if n is not None and n.kind == "lit" else ""
            self.add("grpc_services", desc_name=name, service=string(fields.get("ServiceName")), handler_type=self.text(fields.get("HandlerType")), proto_file=string(fields.get("Metadata")), file=self.path, line=s.line)
            for key, label in (("Methods", "MethodName"), ("Streams", "StreamName")):
                for e in fields[key].kids[1:] if key in fields else []:
                    own = {x.kids[0].text: x.kids[1] for x in e.kids[1:] if x.kind == "kv"}
                    flag = lambda k, own=own: k in own and own[k].text == "true"
                    self.add("grpc_methods", desc_name=name, method=string(own.get(label)), handler=self.text(own.get("Handler")), is_stream=key == "Streams", server_streams=flag("ServerStreams"), client_streams=flag("ClientStreams"))

    def register_function(self, name: str, body: Node) -> None:
        todo: list[Node | None] = [body]
        while todo:
            n = todo.pop(0)
            if n is not None:
                if n.kind == "call" and n.kids[0].kind == "sel" and n.kids[0].text == "RegisterService" and len(n.kids) > 1:
                    desc = n.kids[1].kids[0] if n.kids[1].kind == "unary" else n.kids[1]
                    self.add("grpc_register_funcs", func_name=name, desc_name=desc.text)
                    return
                todo += n.kids


def place_of(path: str, root: str, modules: list[tuple[str, str]]) -> tuple[str, str, str, str]:
    """(file below root, its folder, module path, package path)."""
    local = posixpath.relpath(path.removeprefix("file:").replace("//", "/"), root)
    folder = posixpath.dirname(local)
    at, module = max(((d, m) for d, m in modules if not d or folder == d or folder.startswith(d + "/")), key=lambda x: len(x[0]), default=("", ""))
    inner = folder[len(at) :].strip("/")
    return local, folder, module, "/".join(x for x in (module, inner) if x) or "main"


PARSED = "path string, sha string, kind string, row string"
#: Facts that a task holds before it hands them on; a file's facts have some forty times its bytes.
SLICE = 10_000
#: Bytes of sources that a task parses and sorts by table: a task's memory is the same at every size.
SOURCE = 4_000_000


def facts_in(parsed: DataFrame, kind: str) -> DataFrame:
    """A fact table out of parsed rows."""
    return parsed.where(F.col("kind") == kind).select(F.from_json("row", SCHEMAS[kind]).alias("r")).select("r.*")


def _extract(root: str, modules: list[tuple[str, str]], patterns: list[str], kinds: frozenset[str] = frozenset(SCHEMAS)):
    """Facts of files (path, content), with `env`, if there, a list of
    (dot, name, package): names of packages unlike their folders' by import
    path, and what dot imports bring in; and `sha`, which stays with the facts.
    They come in slices, not as many as a batch of files has."""
    table = lambda rows: pd.DataFrame(rows, columns=["path", "sha", "kind", "row"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # trees have no cycles: looking for some again and again takes a third of the time
        gc.disable()
        for frame in frames:
            rows = []
            env, sha = (frame[c] if c in frame else [None] * len(frame) for c in ("env", "sha"))
            for path, content, known, mark in zip(frame["path"], frame["content"], env, sha, strict=True):
                local, folder, module, pkg = place_of(path, root, modules)
                known = [] if known is None else list(known)
                named, dots = {x["package"]: x["name"] for x in known if not x["dot"]}, {x["name"]: x["package"] for x in known if x["dot"]}
                try:
                    facts = _File(content.decode("utf-8", "replace"), local, pkg, module, matches(folder, patterns), named, dots, kinds).run()
                except (GoSyntaxError, RecursionError, IndexError) as e:
                    facts = [("errors", {"file": local, "message": str(e)})]
                rows += [(path, mark or "", k, json.dumps(r)) for k, r in facts]
                del facts
                if len(rows) >= SLICE:
                    yield table(rows)
                    rows = []
            yield table(rows)
            del rows, frame
            gc.collect()
            give_back()
        gc.enable()

    return run


_COMMENT = re.compile(rb"//[^\n]*|/\*.*?\*/", re.S)
_PACKAGE = re.compile(rb"^[ \t]*package[ \t]+(\w+)", re.M)
_IMPORT = re.compile(rb"""^[ \t]*import[ \t]*(?:\(([^)]*)\)|((?:[\w.]+[ \t]+)?["`][^"`\n]+["`]))""", re.M)
_SPEC = re.compile(rb"""([\w.]*)[ \t]*["`]([^"`\n]+)["`]""")


def _heads(root: str, modules: list[tuple[str, str]]):
    """(path, pkg, name, imports, size) by the first lines of files; imports
    (dot, package); size in bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                m = _PACKAGE.search(content)
                specs = [x for i in _IMPORT.finditer(content) for x in _SPEC.findall(_COMMENT.sub(b"", i[1] if i[1] is not None else i[2]))]
                rows.append((path, place_of(path, root, modules)[3], m[1].decode() if m else "", [{"dot": a == b".", "package": p.decode("utf-8", "replace")} for a, p in specs], len(content)))
            yield pd.DataFrame(rows, columns=["path", "pkg", "name", "imports", "size"])

    return run


def _exports(root: str, modules: list[tuple[str, str]]):
    """(package, name): exported names that files declare."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    tree = parse(content.decode("utf-8", "replace"))
                except (GoSyntaxError, RecursionError, IndexError):
                    continue
                names = [d.text for d in tree.kids if d.kind == "func" and d.kids[0] is None]
                for d in tree.kids:
                    if d.kind == "decl" and d.text != "import":
                        names += [x for s in d.kids for x in ([s.text] if d.text == "type" else s.names)]
                rows += [(place_of(path, root, modules)[3], x) for x in names if x[:1].isupper()]
            yield pd.DataFrame(rows, columns=["package", "name"])

    return run


def with_env(files: DataFrame, root: str, modules: list[tuple[str, str]]) -> tuple[DataFrame, int]:
    """files with env: of each, what its own imports bring in. A join, so no
    task needs the names of other files' packages. And how many parts of SOURCE
    bytes they have, at least one a core; they are dealt into these by path."""
    heads, (_, size) = cut(files.mapInPandas(_heads(root, modules), "path string, pkg string, name string, imports array<struct<dot: boolean, package: string>>, size long"), size=F.col("size"))
    usual = F.regexp_replace(F.when(F.regexp_like("pkg", F.lit(r"(^|/)v[0-9]+$")) & F.col("pkg").contains("/"), F.element_at(F.split("pkg", "/"), -2)).otherwise(F.element_at(F.split("pkg", "/"), -1)), r"\.v[0-9]+$", "")
    odd = heads.where((F.col("name") != "main") & (F.col("name") != "") & (F.col("name") != usual)).select(F.col("pkg").alias("package"), "name").groupBy("package").agg(F.min("name").alias("name"))
    each = heads.select("path", F.explode("imports").alias("i")).select("path", "i.dot", "i.package").distinct()
    dotted = each.where("dot").select("package").distinct()
    shown = files.join(heads.select("path", F.col("pkg").alias("package")).join(dotted, "package", "left_semi").select("path"), "path", "left_semi").select("path", "content")
    shown = shown.mapInPandas(_exports(root, modules), "package string, name string").distinct()
    brought = each.where("not dot").join(odd, "package").unionByName(each.where("dot").join(shown, "package"))
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // SOURCE))
    # both sides of the join are dealt alike: else it deals them anew, into the session's number of parts
    env = brought.repartition(parts, "path").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("dot", "name", "package"))).alias("env"))  # of one file's imports
    return files.repartition(parts, "path").join(env, "path", "left"), parts


def matches(folder: str, patterns: list[str]) -> bool:
    """Whether a package folder is one of ./..., ./a/..., ./a or . (the root alone)."""
    for p in patterns:
        if p in (".", "./"):
            if not folder:
                return True
            continue
        p = p.removeprefix("./").strip("/")
        if p in ("...", "") or folder == p or (p.endswith("/...") and (folder == p[:-4] or folder.startswith(p[:-3]))):
            return True
    return False


def normal_patterns(root: str, patterns: list[str]) -> list[str]:
    """Patterns of folders that exist, absolute or not, as paths below root;
    others stay as they are; each once; all packages if there are none."""
    out = []
    for p in (x.strip().replace("\\", "/") for x in patterns):
        deep = p.endswith("/...")
        base = os.path.join(root, p.removesuffix("/...") if deep else p)
        if p and os.path.exists(base):
            rel = os.path.relpath(base, root).replace(os.sep, "/")
            p = ("./..." if deep else ".") if rel == "." else f"./{rel}" + "/..." * deep
        if p:
            out.append(p)
    return list(dict.fromkeys(out)) or ["./..."]


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the Go files below a folder, tests left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.go").option("recursiveFileLookup", "true").load(os.path.abspath(root))
    return files.where(~F.col("path").endswith("_test.go")).select("path", "content")


def _marks(parsed: DataFrame) -> DataFrame:
    """(path, sha) of parsed files: each has one row of files, or of errors."""
    return parsed.where(F.col("kind").isin("files", "errors")).select("path", "sha")


def changed_files(before: FactSet, after: FactSet) -> DataFrame:
    """(path, state): files whose facts were kept, parsed or dropped between two
    loads."""
    old, new = (_marks(x.parsed).withColumnRenamed("sha", c) for x, c in ((before, "old"), (after, "new")))
    state = F.when(F.col("new").isNull(), "dropped").when(F.col("old") == F.col("new"), "kept").otherwise("parsed")
    return old.join(new, "path", "full").select("path", state.alias("state"))


def go_facts(spark: SparkSession, root: str, patterns: list[str] | None = None, modules: list[tuple[str, str]] | None = None, files: DataFrame | None = None, previous: FactSet | None = None, kinds: frozenset[str] = frozenset(SCHEMAS)) -> FactSet:
    """Parse the Go files below root, or the given ones (path, content), whose
    paths start with root. modules: (folder, module path) pairs. Packages that
    match the patterns are roots; facts of others are kept as far as roots
    import them. Raises LookupError if nothing matches. kinds: the tables that
    are asked for, besides files, imports and errors, which are always there:
    what others need isn't made, but every file is read to its end.

    Given the previous facts of the same folder, patterns and modules, only files
    are parsed whose content, or what their imports bring in, has another hash;
    facts of the others are kept, and those of files that are gone go."""
    ship(spark)
    spark.conf.set(*BATCH)
    root = os.path.abspath(root)
    patterns, modules = normal_patterns(root, patterns or []), modules or [("", "")]
    files = source_files(spark, root) if files is None else files.select("path", "content")
    files, parts = with_env(files, root, modules)
    files = files.withColumn("sha", F.sha2(F.concat("content", F.coalesce(F.to_json("env"), F.lit("")).cast("binary")), 256))
    of, kinds = (root, tuple(patterns), tuple(modules)), kinds | PACKAGES | {"errors"}
    held = None
    if previous is not None and previous.of == of and kinds <= set(previous.tables):
        now = checkpointed(files.select("path", "sha"))
        both = (x.repartition(parts, "path", "sha") for x in (previous.parsed.where(F.col("kind").isin(*kinds)), now.hint("shuffle_hash")))  # alike as well; facts aren't sorted for it
        held = DataFrame.join(*both, ["path", "sha"], "left_semi")
        files = files.join(_marks(previous.parsed), ["path", "sha"], "left_anti").repartition(parts, "path")
    parsed = files.coalesce(parts).mapInPandas(_extract(root, modules, patterns, kinds), PARSED)
    if held is not None:
        parsed = parsed.unionByName(held.select("path", "sha", "kind", "row"))
    parsed = written_by(parsed, "kind")
    tables = {k: facts_in(parsed, k) for k in SCHEMAS if k in kinds}
    if tables["files"].where("is_root").isEmpty():
        raise LookupError(f"no Go packages match {', '.join(patterns)} in {root}")
    facts = FactSet(tables, patterns)
    facts.parsed, facts.of = parsed, of
    if not tables["files"].where("not is_root").isEmpty():
        loaded = checkpointed(all_packages(facts.packages(), tables["imports"]))
        facts.tables = {k: t if k == "errors" else t.join(loaded, "pkg_path", "left_semi") for k, t in tables.items()}
    return facts
