"""A Go reader: tokens, then a tree of generic nodes.

A node has a kind, a text (operator, name or literal), child nodes and a line.
Layout of children by kind:

if: init cond body else; for: init cond post body; range: key value x body;
switch: init tag clauses; typeswitch: init assign clauses; select: clauses;
case and comm: list (empty for default), then statements; block: statements;
assign: left list, right list; decl: specs; valuespec: names, type, values;
typespec: type, with its type parameters as names, like func; label: statement; send: channel, value; incdec, return, go,
defer: expressions; call: fun, args; index: x, indices; slice: x low high max;
assert: x type; composite: type, elements; kv: key, value; funclit: type, body;
array: len, elt; map: key, value; chan: elt; struct and interface: fields;
functype: params, results (each a list of fields); field: names, type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset(") ] } ++ --".split()) | {"break", "continue", "fallthrough", "return"}
_NUMBER = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?i?|[0-9][0-9_]*\.?(?:[eE][+-]?[0-9_]+)?i?"
#: A token behind blanks: a name, a line's end, a literal, a comment, an operator.
_TOKEN = re.compile(
    rf"""[ \t\r]*(?:([^\W\d]\w*)|(\n)
    |(`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.[^']*|[^'\\\n])'|{_NUMBER})|(//[^\n]*|/\*.*?\*/)
    |(<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{{}},;.:~]))""",
    re.X | re.S,
)
_NAME, _LINE, _LITERAL, _COMMENT = 1, 2, 3, 4


class GoSyntaxError(ValueError):
    """The source isn't Go that this reader knows."""


@dataclass(slots=True)
class Token:
    kind: str  # name, keyword, op, literal, end
    text: str
    line: int
    at: int


@dataclass(slots=True)
class Node:
    kind: str
    text: str = ""
    kids: list = field(default_factory=list)
    line: int = 0
    end: int = 0
    at: int = 0
    stop: int = 0
    names: list = field(default_factory=list)


def tokens(src: str) -> list[Token]:
    """Tokens with semicolons put in where lines end a statement."""
    out: list[Token] = []
    add, line, at, ends = out.append, 1, 0, False
    for m in iter(_TOKEN.scanner(src).match, None):
        what = m.lastindex
        text, at = m[what], m.end()
        if what == _LINE:
            if ends:
                add(Token("op", ";", line, at - 1))
                ends = False
            line += 1
        elif what == _NAME:
            if text in KEYWORDS:
                add(Token("keyword", text, line, at - len(text)))
                ends = text in _ENDS
            else:
                add(Token("name", text, line, at - len(text)))
                ends = True
        elif what == _LITERAL:
            add(Token("literal", text, line, at - len(text)))
            ends = True
            line += text.count("\n")
        elif what == _COMMENT:
            if "\n" in text:
                if ends:
                    add(Token("op", ";", line, at - len(text)))
                    ends = False
                line += text.count("\n")
        else:
            add(Token("op", text, line, at - len(text)))
            ends = text in _ENDS
    rest = src[at:].lstrip(" \t\r")
    if rest:
        raise GoSyntaxError(f"line {line}: unexpected {rest[0]!r}")
    if ends:
        add(Token("op", ";", line, len(src)))
    add(Token("end", "", line, len(src)))
    return out


_LEVEL = {"||": 1, "&&": 2, **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), 3), **dict.fromkeys(("+", "-", "|", "^"), 4), **dict.fromkeys(("*", "/", "%", "<<", ">>", "&", "&^"), 5)}
_UNARY = frozenset("+ - ! ^ * & <- ~".split())
_ASSIGN = frozenset(":= = += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class Parser:
    def __init__(self, src: str):
        self.src, self.toks, self.k = src, tokens(src), 0
        self.level = 0  # below 0 a brace opens a block, not a composite literal

    # token helpers

    @property
    def t(self) -> Token:
        return self.toks[self.k]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.k + n, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.toks[self.k]
        return t.text in texts and t.kind in ("op", "keyword")

    def take(self, text: str = "", kind: str = "") -> Token:
        t = self.toks[self.k]
        if (text and (t.text != text or t.kind not in ("op", "keyword"))) or (kind and t.kind != kind):
            raise GoSyntaxError(f"line {t.line}: expected {text or kind}, found {t.text!r}")
        self.k += 1
        return t

    def skip(self, text: str) -> bool:
        t = self.toks[self.k]
        if t.text == text and t.kind in ("op", "keyword"):
            self.k += 1
            return True
        return False

    def node(self, kind: str, text: str = "", kids: list | None = None, start: Token | None = None) -> Node:
        s, e = start or self.toks[self.k], self.toks[max(self.k - 1, 0)]
        return Node(kind, text, kids or [], s.line, e.line, s.at, e.at + len(e.text))

    def semicolon(self) -> None:
        if not self.at(")", "}"):
            if self.t.kind != "end":
                self.take(";")

    # files

    def file(self) -> Node:
        self.take("package")
        name = self.take(kind="name").text
        self.semicolon()
        decls = []
        while self.t.kind != "end":
            decls.append(self.declaration())
            self.semicolon()
        return Node("file", name, decls, 1)

    def declaration(self) -> Node:
        if self.at("func"):
            return self.function()
        start = self.t
        word = self.take(kind="keyword").text
        if word not in ("import", "var", "const", "type"):
            raise GoSyntaxError(f"line {start.line}: unexpected {word}")
        spec, specs = getattr(self, f"_{word}_spec"), []
        if self.skip("("):
            while not self.at(")"):
                specs.append(spec())
                self.semicolon()
            self.take(")")
        else:
            specs.append(spec())
        return self.node("decl", word, specs, start)

    def _import_spec(self) -> Node:
        start = self.t
        alias = self.take().text if self.t.kind == "name" or self.at(".") else ""
        path = self.take(kind="literal").text
        n = self.node("importspec", path.strip('"`'), [], start)
        n.names = [alias]
        return n

    def _names(self) -> list[Token]:
        out = [self.take(kind="name")]
        while self.skip(","):
            out.append(self.take(kind="name"))
        return out

    def _var_spec(self) -> Node:
        start, names = self.t, self._names()
        kind = None if self.at("=", ";", ")") else self.type()
        values = self.expressions() if self.skip("=") else []
        n = self.node("valuespec", "", [kind, *values], start)
        n.names = [x.text for x in names]
        return n

    _const_spec = _var_spec

    def _type_spec(self) -> Node:
        start = self.t
        name, params = self.take(kind="name").text, []
        if self.at("[") and self.peek().kind == "name" and self.peek(2).text not in ("]",):
            params = self._type_params()
        self.skip("=")
        n = self.node("typespec", name, [self.type()], start)
        n.names = params
        n.end = self.toks[self.k - 1].line
        return n

    def _type_params(self) -> list[str]:
        """Names of the type parameters; their constraints are passed over."""
        last, depth, names = self.take("[").text, 1, []
        while depth:
            t = self.take()
            if depth == 1 and t.kind == "name" and last in ("[", ","):
                names.append(t.text)
            depth += (t.text in ("[", "(", "{")) - (t.text in ("]", ")", "}"))
            last = t.text
            if t.kind == "end":
                raise GoSyntaxError("type parameters don't end")
        return names

    def function(self) -> Node:
        start = self.take("func")
        recv = self.params() if self.at("(") else None
        name = self.take(kind="name").text
        params = self._type_params() if self.at("[") else []
        sig = self.signature()
        body = self.block() if self.at("{") else None
        n = self.node("func", name, [recv, sig, body], start)
        n.names = params
        return n

    # types

    def signature(self) -> Node:
        start = self.t
        params = self.params()
        results = None
        if self.at("("):
            results = self.params()
        elif self._starts_type():
            kind = self.type()
            results = Node("fields", "", [Node("field", "", [kind], kind.line)], kind.line)
        return self.node("functype", "", [params, results], start)

    def _starts_type(self) -> bool:
        return self.t.kind == "name" or self.at("*", "[", "map", "chan", "func", "struct", "interface", "<-", "(")

    def params(self) -> Node:
        start = self.take("(")
        items: list[tuple] = []
        while not self.at(")"):
            first = self._param_type()
            second = None
            if not self.at(",", ")"):
                second = self._param_type()
            items.append((first, second))
            if not self.skip(","):
                break
        self.take(")")
        fields, names = [], []
        if any(s is not None for _, s in items):
            for first, second in items:
                names.append(first.text)
                if second is not None:
                    fields.append(Node("field", "", [second], first.line, names=names))
                    names = []
        else:
            fields = [Node("field", "", [f], f.line) for f, _ in items]
        return self.node("fields", "", fields, start)

    def _param_type(self) -> Node:
        if self.at("..."):
            start = self.take()
            return self.node("ellipsis", "", [self.type()], start)
        return self.type()

    def type(self) -> Node:
        start = self.t
        if self.t.kind == "name":
            n = self._name()
            if self.at("."):
                self.take()
                n = self.node("sel", self.take(kind="name").text, [n], start)
            if self.at("[") and self.peek().text != "]" and not (self.peek().kind == "literal"):
                self.take("[")
                kinds = [self.type()]
                while self.skip(","):
                    kinds.append(self.type())
                self.take("]")
                n = self.node("index", "", [n, *kinds], start)
            return n
        if self.skip("*"):
            return self.node("star", "", [self.type()], start)
        if self.skip("("):
            inner = self.type()
            self.take(")")
            return self.node("paren", "", [inner], start)
        if self.skip("["):
            length = None
            if self.at("..."):
                self.take()
                length = Node("ellipsis", "", [None], start.line)
            elif not self.at("]"):
                length = self.nested(self.expression)
            self.take("]")
            return self.node("array", "", [length, self.type()], start)
        if self.skip("map"):
            self.take("[")
            key = self.type()
            self.take("]")
            return self.node("map", "", [key, self.type()], start)
        if self.at("<-") or self.at("chan"):
            self.skip("<-")
            self.take("chan")
            self.skip("<-")
            return self.node("chan", "", [self.type()], start)
        if self.skip("func"):
            return self.signature()
        if self.skip("struct"):
            return self.node("struct", "", [self._members(self._struct_field)], start)
        if self.skip("interface"):
            return self.node("interface", "", [self._members(self._interface_member)], start)
        raise GoSyntaxError(f"line {start.line}: expected a type, found {start.text!r}")

    def _members(self, one) -> Node:
        start = self.take("{")
        out = []
        while not self.at("}"):
            out.append(one())
            self.semicolon()
        self.take("}")
        return self.node("fields", "", out, start)

    def _struct_field(self) -> Node:
        start, names = self.t, []
        if self.t.kind == "name" and (self.peek().kind == "name" or self.peek().text in (",", "*", "[", "map", "chan", "func", "struct", "interface", "<-", "(")):
            if not (self.peek().text == "[" and self._generic_embed()):
                names = [t.text for t in self._names()]
        kind = self.type()
        if self.t.kind == "literal":
            self.take()
        n = self.node("field", "", [kind], start)
        n.names = names
        return n

    def _generic_embed(self) -> bool:
        k, depth = self.k + 1, 0
        while self.toks[k].kind != "end":
            depth += (self.toks[k].text == "[") - (self.toks[k].text == "]")
            k += 1
            if not depth:
                return self.toks[k].text in (";", "}")
        return False

    def _interface_member(self) -> Node:
        start = self.t
        if self.t.kind == "name" and self.peek().text == "(":
            name = self.take().text
            n = self.node("field", "", [self.signature()], start)
            n.names = [name]
            return n
        kinds = []
        while True:
            self.skip("~")
            kinds.append(self.type())
            if not self.skip("|"):
                break
        return self.node("field", "", [kinds[0]], start) if len(kinds) == 1 else self.node("field", "", [Node("union", "", kinds, start.line)], start)

    # expressions

    def nested(self, f):
        held, self.level = self.level, max(self.level, 0) + 1
        try:
            return f()
        finally:
            self.level = held

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.skip(","):
            out.append(self.expression())
        return out

    def expression(self, least: int = 1) -> Node:
        start = self.t
        left = self.unary()
        while (level := _LEVEL.get(self.t.text, 0) if self.t.kind == "op" else 0) >= least:
            op = self.take().text
            left = self.node("binary", op, [left, self.expression(level + 1)], start)
        return left

    def unary(self) -> Node:
        start = self.t
        if start.kind == "op" and start.text in _UNARY:
            if start.text == "<-" and self.peek().text == "chan":
                return self.primary(self.type())
            op = self.take().text
            return self.node("star" if op == "*" else "unary", op, [self.unary()], start)
        return self.primary()

    def _name(self) -> Node:
        t = self.take(kind="name")
        return Node("ident", t.text, [], t.line, t.line, t.at, t.at + len(t.text))

    def operand(self) -> Node:
        start = self.t
        if start.kind == "literal":
            self.take()
            return self.node("lit", start.text, [], start)
        if start.kind == "name":
            return self._name()
        if self.skip("("):
            inner = self.nested(lambda: self.type() if self.at("chan", "map", "struct", "interface") else self.expression())
            self.take(")")
            return self.node("paren", "", [inner], start)
        if self.at("func"):
            self.take()
            sig = self.signature()
            if self.at("{"):
                return self.node("funclit", "", [sig, self.nested(self.block)], start)
            return sig
        return self.type()

    def primary(self, n: Node | None = None) -> Node:
        start = self.t
        n = n or self.operand()
        while True:
            if self.at("."):
                self.take()
                if self.skip("("):
                    kind = None if self.at("type") else self.type()
                    if kind is None:
                        self.take("type")
                    self.take(")")
                    n = self.node("assert", "", [n, kind], start)
                else:
                    n = self.node("sel", self.take(kind="name").text, [n], start)
            elif self.at("["):
                n = self._index(n, start)
            elif self.at("("):
                self.take()
                args = self.nested(self._args)
                self.take(")")
                n = self.node("call", "", [n, *args], start)
            elif self.at("{") and self._opens_literal(n):
                n = self.node("composite", "", [n, *self._elements()], start)
            else:
                return n

    def _opens_literal(self, n: Node) -> bool:
        if n.kind in ("array", "map", "struct"):
            return True
        base = n.kids[0] if n.kind == "index" else n
        named = base.kind == "ident" or (base.kind == "sel" and base.kids[0].kind == "ident")
        return named and self.level >= 0

    def _index(self, n: Node, start: Token) -> Node:
        self.take("[")
        parts: list[Node | None] = [None]
        colons = 0

        def inside() -> None:
            nonlocal colons
            while not self.at("]"):
                if self.skip(":"):
                    colons += 1
                    parts.append(None)
                elif self.skip(","):
                    parts.append(None)
                else:
                    parts[-1] = self.type() if self.at("map", "chan", "struct", "interface", "func", "[") else self.expression()

        self.nested(inside)
        self.take("]")
        if colons:
            return self.node("slice", "", [n, *parts, *[None] * (3 - len(parts))], start)
        return self.node("index", "", [n, *[p for p in parts if p is not None]], start)

    def _args(self) -> list[Node]:
        out = []
        while not self.at(")"):
            out.append(self.type() if self.at("chan", "map", "struct", "interface") and not self._literal_ahead() else self.expression())
            self.skip("...")
            if not self.skip(","):
                break
        return out

    def _literal_ahead(self) -> bool:
        """Whether the type that starts here is the type of a literal or conversion."""
        k = self.k
        try:
            self.type()
            return self.at("{", "(")
        finally:
            self.k = k

    def _elements(self) -> list[Node]:
        self.take("{")

        def inside() -> list[Node]:
            out = []
            while not self.at("}"):
                start, first = self.t, self._element()
                if self.skip(":"):
                    first = self.node("kv", "", [first, self._element()], start)
                out.append(first)
                if not self.skip(","):
                    break
            return out

        out = self.nested(inside)
        self.take("}")
        return out

    def _element(self) -> Node:
        if self.at("{"):
            start = self.t
            return self.node("composite", "", [None, *self._elements()], start)
        return self.expression()

    # statements

    def block(self) -> Node:
        start = self.take("{")
        held, self.level = self.level, 0
        out = self._statements()
        self.level = held
        self.take("}")
        return self.node("block", "", out, start)

    def _statements(self) -> list[Node]:
        out = []
        while not self.at("}", "case", "default"):
            n = self.statement()
            if n is not None:
                out.append(n)
            self.semicolon()
        return out

    def statement(self) -> Node | None:
        t = self.t
        if t.kind == "keyword":
            if t.text in ("var", "const", "type"):
                return self.declaration()
            make = getattr(self, f"_{t.text}", None)
            if make:
                return make()
            if t.text in ("break", "continue", "goto", "fallthrough"):
                self.take()
                n = self.node("branch", t.text, [], t)
                n.names = [self.take().text] if self.t.kind == "name" else []
                return n
        if self.at(";", "}"):
            return None
        if self.at("{"):
            return self.block()
        if t.kind == "name" and self.peek().text == ":" and self.peek().kind == "op":
            self.take()
            self.take(":")
            return self.node("label", t.text, [None if self.at("}") else self.statement()], t)
        return self.simple()

    def simple(self, with_range: bool = False) -> Node:
        start = self.t
        if with_range and self.at("range"):
            self.take()
            return self.node("range", "", [None, None, self.expression()], start)
        left = self.expressions()
        if self.t.kind == "op" and self.t.text in _ASSIGN:
            op = self.take().text
            if with_range and self.at("range"):
                self.take()
                return self.node("range", op, [left[0], left[1] if len(left) > 1 else None, self.expression()], start)
            right = self.expressions()
            return self.node("assign", op, [Node("list", "", left), Node("list", "", right)], start)
        if self.at("++", "--"):
            return self.node("incdec", self.take().text, left, start)
        if self.at("<-"):
            self.take()
            return self.node("send", "", [left[0], self.expression()], start)
        return left[0]

    def _header(self, f):
        held, self.level = self.level, -1
        try:
            return f()
        finally:
            self.level = held

    def _if(self) -> Node:
        start = self.take("if")

        def head():
            init = None if self.at(";") else self.simple()
            return (init, self.simple()) if self.skip(";") else (None, init)

        init, cond = self._header(head)
        body, other = self.block(), None
        if self.skip("else"):
            other = self._if() if self.at("if") else self.block()
        return self.node("if", "", [init, cond, body, other], start)

    def _for(self) -> Node:
        start = self.take("for")

        def head():
            if self.at("{"):
                return [None, None, None]
            first = None if self.at(";") else self.simple(with_range=True)
            if first is not None and first.kind == "range":
                return first
            if not self.skip(";"):
                return [None, first, None]
            cond = None if self.at(";") else self.simple()
            self.skip(";")
            return [first, cond, None if self.at("{") else self.simple()]

        got = self._header(head)
        body = self.block()
        if isinstance(got, Node):
            return self.node("range", got.text, [*got.kids, body], start)
        return self.node("for", "", [*got, body], start)

    def _switch(self) -> Node:
        start = self.take("switch")

        def head():
            if self.at("{"):
                return None, None
            init = None if self.at(";") else self.simple()
            if self.skip(";"):
                return init, None if self.at("{") else self.simple()
            return None, init

        init, tag = self._header(head)
        right = tag.kids[1].kids[-1] if tag is not None and tag.kind == "assign" else tag
        kind = "typeswitch" if right is not None and right.kind == "assert" and right.kids[1] is None else "switch"
        return self.node(kind, "", [init, tag, *self._clauses("case", self._case_list)], start)

    def _select(self) -> Node:
        start = self.take("select")
        return self.node("select", "", self._clauses("comm", lambda: [self.simple()]), start)

    def _case_list(self) -> list[Node]:
        out = []
        while True:
            out.append(self.type() if self.at("chan", "map", "struct", "interface", "func", "[") and not self._literal_ahead() else self.expression())
            if not self.skip(","):
                return out

    def _clauses(self, kind: str, head) -> list[Node]:
        self.take("{")
        held, self.level = self.level, 0
        out = []
        while not self.at("}"):
            start = self.t
            listed = [] if self.skip("default") else (self.take("case"), head())[1]
            self.take(":")
            out.append(self.node(kind, "", [Node("list", "", listed), *self._statements()], start))
        self.level = held
        self.take("}")
        return out

    def _return(self) -> Node:
        start = self.take("return")
        return self.node("return", "", [] if self.at(";", "}") else self.expressions(), start)

    def _go(self) -> Node:
        start = self.take("go")
        return self.node("go", "", [self.expression()], start)

    def _defer(self) -> Node:
        start = self.take("defer")
        return self.node("defer", "", [self.expression()], start)


def parse(src: str) -> Node:
    return Parser(src).file()
