"""Complexity and Halstead counts as folds over syntax trees: tables say what
each kind of node adds, one walk applies them."""

from __future__ import annotations

from collections import Counter

from ferngraph.sources.gosyntax import Node

# what a node adds besides its children

#: Kinds that decide: both measures grow, the second by the nesting as well.
_DECIDES = frozenset(("if", "for", "range"))
#: Kinds that choose between clauses: only the second measure grows.
_CHOOSES = frozenset(("switch", "typeswitch", "select"))
#: Types aren't looked into, nor the sides that a loop assigns.
_OPAQUE = frozenset(("array", "map", "chan", "struct", "interface", "functype", "typespec", "fields", "ellipsis"))


class Complexity:
    """cyclomatic, cognitive and deepest nesting of a function body."""

    def __init__(self, name: str, body: Node):
        self.name, self.cyclomatic, self.cognitive, self.deepest, self.recursive = name, 1, 0, 0, False
        self._walk(body, 0)

    def _all(self, nodes: list, depth: int) -> None:
        for n in nodes:
            self._walk(n, depth)

    def _walk(self, n: Node | None, depth: int) -> None:
        if n is None or n.kind in _OPAQUE:
            return
        kind, kids = n.kind, n.kids
        if kind in _STATEMENTS:
            self.deepest = max(self.deepest, depth)
        if kind in _DECIDES:
            self.cyclomatic += 1
            self.cognitive += 1 + depth
        elif kind in _CHOOSES:
            self.cognitive += 1 + depth
        elif kind == "branch":
            self.cognitive += n.text in ("goto", "fallthrough") or bool(n.names)
        elif kind == "binary" and n.text in ("&&", "||"):
            self.cyclomatic += 1
            self.cognitive += 1
        elif kind == "call" and not self.recursive and kids[0].kind in ("ident", "sel") and kids[0].text == self.name:
            self.cognitive += 1
            self.recursive = True
        elif kind in ("case", "comm"):
            self.cyclomatic += bool(kids[0].kids)
        if kind == "if":
            self._all(kids[:2], depth)
            self._walk(kids[2], depth + 1)
            self._walk(kids[3], depth + (kids[3] is not None and kids[3].kind != "if"))
        elif kind == "for":
            self._all(kids[:3], depth)
            self._walk(kids[3], depth + 1)
        elif kind == "range":
            self._walk(kids[2], depth)
            self._walk(kids[3], depth + 1)
        elif kind in _CHOOSES:
            head = 0 if kind == "select" else 2
            self._all(kids[:head], depth)
            self.deepest = max(self.deepest, depth + 1)
            self._all(kids[head:], depth + 1)
        elif kind == "funclit":
            self._walk(kids[1], depth + 1)
        elif kind == "composite":
            self._all(kids[1:], depth)
        elif kind == "assert":
            self._walk(kids[0], depth)
        elif kind == "valuespec":
            self._all(kids[1:], depth)
        else:
            self._all(kids, depth)


_STATEMENTS = frozenset("if for range switch typeswitch select branch block assign return decl go defer incdec label send call".split())

#: Operator that a node counts as; None: its text; absent: none.
_OPERATOR = {
    "if": "if", "for": "for", "range": "range", "switch": "switch", "typeswitch": "type_switch", "select": "select", "return": "return", "go": "go", "defer": "defer", "label": "label", "send": "<-",
    "call": "call", "sel": ".", "index": "index", "slice": "slice", "star": "*", "assert": "type_assert", "composite": "composite_lit", "kv": ":", "funclit": "func_lit",
    "array": "array_type", "map": "map_type", "chan": "chan_type", "struct": "struct_type", "interface": "interface_type", "functype": "func_type", "ellipsis": "ellipsis",
    "assign": None, "incdec": None, "branch": None, "decl": None, "binary": None, "unary": None,
}
_TEXT_IS_OPERAND = frozenset(("ident", "lit", "label", "sel", "typespec"))


def halstead_tokens(body: Node) -> list[tuple[str, str, int]]:
    """(kind, token, count) of a function body."""
    seen: Counter = Counter()

    def operand(text: str) -> None:
        if text and text != "_":
            seen["operand", text] += 1

    todo: list[Node | None] = [body]
    while todo:
        n = todo.pop()
        if n is None:
            continue
        if n.kind in _OPERATOR:
            seen["operator", _OPERATOR[n.kind] or n.text] += 1
        if n.kind == "range" and n.text:
            seen["operator", n.text] += 1
        elif n.kind == "if" and n.kids[3] is not None:
            seen["operator", "else"] += 1
        elif n.kind in ("case", "comm"):
            seen["operator", "case" if n.kids[0].kids else "default"] += 1
        if n.kind in _TEXT_IS_OPERAND:
            operand(n.text)
        if n.kind in ("branch", "valuespec", "field"):
            for name in n.names:
                operand(name)
        todo += n.kids
    return [(k, t, c) for (k, t), c in sorted(seen.items())]
