"""Delivering results: windows, resumable cursors, diagrams.

A cursor is an opaque token over a sorted, finite result. It holds the offset,
the total and a fingerprint of total, first and last key. Where pages follow one
another, the order is written once and a page reads the part that holds it;
else one aggregate job checks the cursor, and a page is a sort with offset and limit.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import os
from collections import OrderedDict
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ferngraph.plans.graphs import written_by

CHUNK, CHUNK_ENV = 50, "FERNGRAPH_MAX_CHUNK"


class CursorError(ValueError):
    """A cursor that can't be read, or whose result has changed."""


@dataclass(frozen=True)
class Options:
    """offset, limit and max_items window a result; chunk_size and cursor page
    through it. Zero means unset, negatives count as zero."""

    offset: int = 0
    limit: int = 0
    max_items: int = 0
    chunk_size: int = 0
    cursor: str = ""


@dataclass
class Page:
    rows: list[Row]
    total: int
    truncated: bool
    has_more: bool = False
    next_cursor: str = ""
    extra: dict = field(default_factory=dict)


def clamp_chunk(size: int) -> int:
    if size <= 0:
        return size
    raw = os.environ.get(CHUNK_ENV, "")
    cap = int(raw) if raw.isdigit() and int(raw) > 0 else CHUNK
    return min(size, cap)


def bounds(total: int, o: Options) -> tuple[int, int]:
    """First and last-but-one row of the window."""
    start = min(max(0, o.offset), total)
    end = total
    for n in (o.max_items, o.limit):
        if n > 0:
            end = min(end, start + n)
    return start, end


def encode_cursor(offset: int, total: int, fingerprint: str) -> str:
    raw = json.dumps({"v": 1, "o": offset, "t": total, "f": fingerprint}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        raw = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError) as e:
        raise CursorError("invalid cursor encoding") from e
    try:
        c = json.loads(raw)
        ok = isinstance(c, dict) and isinstance(c.get("o"), int) and isinstance(c.get("t"), int) and isinstance(c.get("f"), str)
    except ValueError as e:
        raise CursorError("invalid cursor payload") from e
    if not ok:
        raise CursorError("invalid cursor payload")
    if c.get("v") != 1:
        raise CursorError(f"unsupported cursor version {c.get('v')}")
    return c


def fingerprint(identifier: str, total: int, first: str, last: str) -> str:
    return hashlib.sha256(f"{identifier}|{total}|{first}|{last}".encode()).digest()[:8].hex()


def window(df: DataFrame, order: list[Column], o: Options) -> DataFrame:
    """The window of a result as a DataFrame: no count is needed for it."""
    df = df.orderBy(*order).offset(max(0, o.offset))
    most = min((n for n in (o.max_items, o.limit) if n > 0), default=0)
    return df.limit(most) if most else df


def _direction(name: str, down: bool, df: DataFrame) -> Column:
    """A column that ascends as the rows are ordered; descending ones are numbers."""
    if not down:
        return F.col(name)
    kind = df.schema[name].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        raise TypeError(f"{name} can't be ordered downwards: it is {kind}")
    return (-F.col(name)).alias(name)


class Order:
    """A result written in its order: dealt out by range of the order's columns,
    sorted within each part, every row with its place in the part. The parts'
    sizes, summed up, say which part holds the n-th row, so that a page reads one
    part or two and nothing is sorted or counted again."""

    def __init__(self, df: DataFrame, order: list[str], key: Column, descending: tuple[str, ...] = (), parts: int = 0):
        spark = df.sparkSession
        by = [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.withColumn("_key", key).repartitionByRange(parts, *by).sortWithinPartitions(*by)
        place = F.monotonically_increasing_id()  # of a partition in its upper bits, of a row in its lower 33
        rows = rows.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})
        self.columns, self.table = df.columns, written_by(rows, "_part")
        ends = self.table.groupBy("_part").agg(F.count("*").alias("n"), F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last")).orderBy("_part").collect()  # a row for each part
        self.parts, sizes = [r["_part"] for r in ends], [r["n"] for r in ends]
        self.starts = [0, *accumulate(sizes)]
        self.total = self.starts[-1]
        self.first, self.last = (ends[0]["first"], ends[-1]["last"]) if ends else ("", "")

    def rows(self, start: int, end: int) -> DataFrame:
        """Rows start to end - 1."""
        held = [(p, a) for p, a, b in zip(self.parts, self.starts, self.starts[1:], strict=False) if a < end and b > start]
        if not held:
            return self.table.where("false").select(*self.columns)
        place = F.col("_at") + F.element_at(F.create_map(*[F.lit(x) for p, a in held for x in (p, a)]), F.col("_part"))
        rows = self.table.where(F.col("_part").isin([p for p, _ in held])).where((place >= start) & (place < end))
        return rows.orderBy("_part", "_at").select(*self.columns)


def in_order(order: Order, identifier: str, o: Options) -> Page:
    """A chunk of a written order; max_items caps the whole result."""
    chunk, total = clamp_chunk(o.chunk_size), min(order.total, o.max_items) if o.max_items > 0 else order.total
    last = order.last if total == order.total else f"{order.last}|{total}"
    mark = fingerprint(identifier, total, order.first or "", last or "")
    offset = _offset(o.cursor, mark, total)
    end = min(total, offset + chunk)
    more = end < total
    return Page(order.rows(offset, end).collect() if end > offset else [], total, more or bool(o.cursor), more, encode_cursor(end, total, mark) if more else "")


def _offset(cursor: str, mark: str, total: int) -> int:
    if not cursor:
        return 0
    c = decode_cursor(cursor)
    if c["f"] != mark or c["t"] != total:
        raise CursorError("stream cursor invalidated: the result has changed")
    return min(max(0, c["o"]), total)


class Orders:
    """Written orders by what they are of, the latest few."""

    def __init__(self, most: int = 8):
        self.most, self.held = most, OrderedDict()

    def get(self, df: DataFrame, order: list[str], identifier: str, key: Column, descending: tuple[str, ...]) -> Order:
        of = (identifier, df.semanticHash(), tuple(order), descending)
        if of not in self.held:
            self.held[of] = Order(df, order, key, descending)
        self.held.move_to_end(of)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return self.held[of]


def deliver(df: DataFrame, order: list[str], identifier: str, key: Column, o: Options, descending: tuple[str, ...] = (), orders: Orders | None = None) -> Page:
    """Chunk or window of a result. In chunks, max_items caps the whole result;
    given written orders, a chunk is read from one of them, which is written for
    the first chunk only."""
    by = [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]
    chunk = clamp_chunk(o.chunk_size)
    if chunk > 0 and orders is not None:
        return in_order(orders.get(df, order, identifier, key, descending), identifier, o)
    if chunk <= 0:
        total = df.count()
        start, end = bounds(total, o)
        rows = df.orderBy(*by).offset(start).limit(end - start).collect() if end > start else []
        return Page(rows, total, start > 0 or end < total)
    if o.max_items > 0:
        df = df.orderBy(*by).limit(o.max_items)
    # the count, and the keys of the first and the last row, by one aggregate
    at = F.struct(*[_direction(c, c in descending, df) for c in order])
    ends = df.select(key.alias("_key"), at.alias("_at")).agg(F.count("*").alias("n"), F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last")).first()
    total = ends["n"]
    mark = fingerprint(identifier, total, ends["first"] or "", ends["last"] or "")
    offset = _offset(o.cursor, mark, total)
    end = min(total, offset + chunk)
    rows = df.orderBy(*by).offset(offset).limit(end - offset).collect() if end > offset else []
    more = end < total
    return Page(rows, total, more or bool(o.cursor), more, encode_cursor(end, total, mark) if more else "")


# diagrams

#: Accepted names of the three formats.
FORMATS = {"mermaid": "mermaid", "mmd": "mermaid", "dot": "dot", "graphviz": "dot", "json-graph": "json-graph", "jsongraph": "json-graph", "json_graph": "json-graph", "graph": "json-graph"}


def parse_format(name: str) -> str:
    """The format a name means; empty means none; ValueError if unknown."""
    low = name.strip().lower()
    if not low:
        return ""
    if low not in FORMATS:
        raise ValueError(f"unsupported export format {name!r}")
    return FORMATS[low]


@dataclass
class Diagram:
    """Nodes are numbered as first seen and kept once per label; the last class
    given to a node that isn't empty holds; edges are kept all."""

    title: str = ""
    direction: str = "LR"
    nodes: dict[str, dict] = field(default_factory=dict)
    edges: list[dict] = field(default_factory=list)

    def node(self, label: str, kind: str = "") -> str:
        n = self.nodes.setdefault(label, {"id": f"n{len(self.nodes)}", "label": label, "class": ""})
        n["class"] = kind or n["class"]
        return n["id"]

    def edge(self, a: str, b: str, label: str = "", style: str = "") -> None:
        self.edges.append({"from": self.node(a), "to": self.node(b), "label": label, "style": style})

    def sorted_edges(self) -> list[dict]:
        return sorted(self.edges, key=lambda e: (e["from"], e["to"], e["label"]))

    def render(self, form: str) -> str:
        return {"mermaid": self._mermaid, "dot": self._dot, "json-graph": self._json}[form]() if form else ""

    def _mermaid(self) -> str:
        out = [f"%% {self.title}"] * bool(self.title) + [f"graph {self.direction or 'LR'}"]
        out += [f"  {n['id']}[{json.dumps(n['label'], ensure_ascii=False)}]" for n in self.nodes.values()]
        swap = str.maketrans('|"\n', "/' ")
        for e in self.sorted_edges():
            arrow = "-.->" if e["style"] == "dashed" else "-->"
            label = f"|{e['label'].translate(swap)}| " if e["label"] else ""
            out.append(f"  {e['from']} {arrow}{label or ' '}{e['to']}")
        classes: dict[str, list[str]] = {}
        for n in self.nodes.values():
            if n["class"]:
                classes.setdefault(n["class"], []).append(n["id"])
        if classes:  # fixed values: the styles of the three classes
            out += ["  classDef violation fill:#fdd,stroke:#c00,color:#900", "  classDef root fill:#dfd,stroke:#080", "  classDef target fill:#ddf,stroke:#008"]
            out += [f"  class {','.join(sorted(ids))} {c}" for c, ids in sorted(classes.items())]
        return "\n".join(out) + "\n"

    def _dot(self) -> str:
        name = "".join(c for c in ("_" * self.title[:1].isdigit() + self.title) if c.isascii() and (c.isalnum() or c == "_"))
        q = lambda s: json.dumps(s, ensure_ascii=False)
        out = [f"digraph {name or 'graph_export'} {{", "  rankdir=LR;"]
        for n in self.nodes.values():
            style = ", color=red, fontcolor=red" if n["class"] == "violation" else f", group={q(n['class'])}" if n["class"] else ""
            out.append(f"  {n['id']} [label={q(n['label'])}{style}];")
        for e in self.sorted_edges():
            has = [f"label={q(e['label'])}"] * bool(e["label"]) + ["style=dashed", "color=red"] * (e["style"] == "dashed")
            out.append(f"  {e['from']} -> {e['to']}{' [' + ', '.join(has) + ']' if has else ''};")
        return "\n".join([*out, "}"]) + "\n"

    def _json(self) -> str:
        drop = lambda d: {k: v for k, v in d.items() if v or k in ("id", "label", "from", "to")}
        edges = [{k: v for k, v in e.items() if v} for e in self.sorted_edges()]
        return json.dumps({"title": self.title, "direction": self.direction, "nodes": [drop(n) for n in self.nodes.values()], "edges": edges}, separators=(",", ":"), ensure_ascii=False)


def graph_nodes(edges: DataFrame, order: list[str]) -> DataFrame:
    """(label, id): node numbers of an edge window (from, to) in first-seen
    order, as a table; the window is a page, so one partition holds it."""
    from pyspark.sql import Window

    numbered = edges.withColumn("_e", F.row_number().over(Window.orderBy(*order)))
    seen = numbered.select("_e", F.posexplode(F.array("from", "to")).alias("_p", "label"))
    first = seen.groupBy("label").agg(F.min(F.struct("_e", "_p")).alias("_f"))
    return first.select("label", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy("_f")) - 1).cast("string")).alias("id"))
