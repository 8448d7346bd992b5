"""What the expressions of Go facts mean: joins with the tables of definitions,
results, fields, methods and embedded types stand in for a type checker."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferngraph.operators import calls as call_graph
from ferngraph.plans.graphs import checkpointed, cut
from ferngraph.sources import goterms

#: Embedded types are followed so deep.
DEPTH = 32
#: Instances of generic types nested deeper than this are not made of others.
NESTED = 8
#: Rows of a table that is sent to every task of a round.
FEW = 200_000

# Method sets of the standard library's usual interfaces.
STANDARD = {
    "error": (("Error", "()(string)", "string"),),
    "fmt.Stringer": (("String", "()(string)", "string"),),
    "io.Reader": (("Read", "([]byte)(int,error)", "int"),),
    "io.Writer": (("Write", "([]byte)(int,error)", "int"),),
    "io.Closer": (("Close", "()(error)", "error"),),
    "io.ReadWriter": (("Read", "([]byte)(int,error)", "int"), ("Write", "([]byte)(int,error)", "int")),
    "io.ReadCloser": (("Read", "([]byte)(int,error)", "int"), ("Close", "()(error)", "error")),
    "io.WriteCloser": (("Write", "([]byte)(int,error)", "int"), ("Close", "()(error)", "error")),
    "io.ReadWriteCloser": (("Read", "([]byte)(int,error)", "int"), ("Write", "([]byte)(int,error)", "int"), ("Close", "()(error)", "error")),
    "sort.Interface": (("Len", "()(int)", "int"), ("Less", "(int,int)(bool)", "bool"), ("Swap", "(int,int)()", "")),
    "sync.Locker": (("Lock", "()()", ""), ("Unlock", "()()", "")),
    "net/http.Handler": (("ServeHTTP", "(net/http.ResponseWriter,*net/http.Request)()", ""),),
}
# Packages whose functions take values of any kind; names that mean a value anywhere.
PRINTING = ("fmt.", "log.")
CONSTANTS = {"true": "bool", "false": "bool", "iota": "int"}
# The predeclared types of the language.
PREDECLARED = frozenset("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr comparable".split())

_TEXT = T.StringType()


def _entries(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in names]))


_step = F.udf(goterms.step, _TEXT, useArrow=True)
_of_type = F.udf(lambda term, instance: goterms.of_type(term, instance), _TEXT, useArrow=True)
_substituted = F.udf(lambda term, values: goterms.substituted(term, dict(values or {})), _TEXT, useArrow=True)
_bound = F.udf(lambda sig, place, term: list(goterms.bound(sig, place, term).items()), _entries("k", "v"))
_needed = F.udf(lambda sig: len(goterms.needed(sig)), T.IntegerType(), useArrow=True)
_instances = F.udf(lambda term: goterms.instances(term), T.ArrayType(_TEXT))
_arguments = F.udf(lambda term: [(f"${k}", a) for k, a in enumerate(goterms.arguments(term))], _entries("k", "v"))
_given = F.udf(lambda names: [(f"%{k}", a) for k, a in enumerate(goterms.listed(names))], _entries("k", "v"))


@F.udf(_TEXT, useArrow=True)
def _environment(kind: str, term: str, values: dict) -> str:
    """An environment as JSON, or a type, with what its parameters stand for."""
    values = dict(values or {})
    if kind == "type":
        return goterms.substituted(term, values)
    return json.dumps({k: goterms.substituted(v, values) for k, v in json.loads(term).items()}, separators=(",", ":"))


_anonymous = F.udf(lambda term: list(goterms.anonymous(term).items()), _entries("method", "sig"))


def named(pkg: str = "pkg_path", name: str = "type_name") -> Column:
    return F.concat_ws(".", pkg, name)


def owner_of(term: Column | str) -> Column:
    """The named type of a term, without pointer marks and arguments."""
    plain = F.regexp_replace(term, r"^(type:)?\**", "")
    return F.when(plain.rlike(r"^(\[|map\[|chan |func\(|interface\{|struct\{|\.\.\.)"), plain).otherwise(F.substring_index(plain, "[", 1))


def instance_of(term: Column | str) -> Column:
    """The same, with arguments."""
    return F.regexp_replace(term, r"^(type:)?\**", "")


def package_of(name: Column | str) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^./]*$", 1)


def is_open(term: str) -> Column:
    """Whether a term depends on type parameters."""
    return F.col(term).contains("%") | F.col(term).contains("$")


def few(df: DataFrame) -> DataFrame:
    """df to be broadcast, if its counted rows are few; else as it is."""
    return F.broadcast(df) if df.count() <= FEW else df


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class FactSet:
    """Fact tables by name, as read or as given."""

    tables: dict[str, DataFrame]
    patterns: list[str] = field(default_factory=list)
    #: The parsed rows (path, sha, kind, row), and of which folder, patterns and modules.
    parsed: DataFrame | None = None
    of: tuple = ()

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def roots(self, name: str) -> DataFrame:
        """The facts of packages that were asked for."""
        return self[name].where("is_root")

    def packages(self) -> DataFrame:
        f = self["files"]
        return f.groupBy("pkg_path").agg(F.max("module_path").alias("module_path"), F.max("is_root").alias("is_root"), F.min("file").alias("first_file"))

    # embedding

    def _paths(self, in_interface: bool) -> DataFrame:
        """(owner, at, term, depth, pointer, ways): the types that each type is
        or embeds, directly or not, at their least depth; term is `at` with the
        arguments it has there; pointer if one on the way is embedded by pointer;
        ways to get there."""
        edges = self["embeds"].where(F.col("in_interface") == in_interface).select(named().alias("at"), F.col("embedded").alias("next"), F.col("pointer").alias("p"))
        start = self["types"].where(F.col("kind") == "interface" if in_interface else F.col("kind") != "interface").select(named().alias("owner")).distinct()
        level = checkpointed(start.select("owner", F.col("owner").alias("at"), F.col("owner").alias("term"), F.lit(0).alias("depth"), F.lit(False).alias("pointer"), F.lit(1).cast("long").alias("ways")))
        seen = level
        for k in range(1, DEPTH):
            step = level.join(edges, "at").withColumn("term", F.when(F.col("depth") == 0, F.col("next")).otherwise(_of_type("next", "term")))
            step = step.groupBy("owner", owner_of("next").alias("at")).agg(F.min("term").alias("term"), F.max(F.col("pointer") | F.col("p")).alias("pointer"), F.sum("ways").alias("ways"))
            level = checkpointed(step.join(seen, ["owner", "at"], "left_anti").select("owner", "at", "term", F.lit(k).alias("depth"), "pointer", "ways"))
            if level.isEmpty():
                break
            seen = checkpointed(seen.unionByName(level))
        return seen

    @cached_property
    def interfaces(self) -> DataFrame:
        """(iface, method, sig, result): whole method sets of interfaces. An
        interface that embeds one that isn't known needs a method that nothing has."""
        spark = self["types"].sparkSession
        standard = spark.createDataFrame([(i, *m) for i, ms in STANDARD.items() for m in ms], "at string, method string, sig string, result string")
        own = self["iface_methods"].select(named("pkg_path", "iface").alias("at"), "method", "sig", "result").unionByName(standard)
        paths = self._paths(True).select("owner", "at", "term", "depth")
        known = self["types"].where("kind = 'interface'").select(named().alias("at")).unionByName(standard.select("at")).distinct()
        unknown = paths.join(known, "at", "left_anti").select(F.col("owner").alias("iface"), F.concat(F.lit("?"), "at").alias("method"), F.lit("").alias("sig"), F.lit("").alias("result"))
        inner = lambda c: F.when(F.col("depth") == 0, F.col(c)).otherwise(_of_type(c, "term")).alias(c)
        rows = paths.join(own, "at").select(F.col("owner").alias("iface"), "method", inner("sig"), inner("result")).unionByName(unknown)
        rows = rows.unionByName(standard.withColumnRenamed("at", "iface"))
        return checkpointed(rows.distinct())

    @cached_property
    def members(self) -> DataFrame:
        """(owner, name, method, recv_kind, sig, type, fn_id): fields and methods
        of types that are no interfaces, promoted ones included: the shallowest
        of a name, unless several are equally deep; type is a field's, or that of
        the method as a function."""
        paths = self._paths(False)
        function = F.concat(F.lit("func"), "sig").alias("type")
        methods = self["methods"].select(named().alias("at"), F.col("method").alias("name"), F.lit(True).alias("method"), "recv_kind", "sig", function, "fn_id")
        fields = self["fields"].select(named().alias("at"), F.col("field").alias("name"), F.lit(False).alias("method"), F.lit("value").alias("recv_kind"), F.lit("").alias("sig"), "type", F.lit("").alias("fn_id"))
        held = self.interfaces.select(F.col("iface").alias("at"), F.col("method").alias("name"), F.lit(True).alias("method"), F.lit("value").alias("recv_kind"), "sig", function, F.lit("").alias("fn_id"))
        rows = paths.join(methods.unionByName(fields).unionByName(held), "at").withColumn("recv_kind", F.when(F.col("pointer"), "value").otherwise(F.col("recv_kind")))
        inner = {c: F.when(F.col("depth") == 0, F.col(c)).otherwise(_of_type(c, "term")) for c in ("sig", "type")}
        rows = rows.withColumns(inner)
        least = rows.groupBy("owner", "name").agg(F.min("depth").alias("depth"))
        best = rows.join(least, ["owner", "name", "depth"]).groupBy("owner", "name").agg(F.sum("ways").alias("ways"), F.min(F.struct("method", "recv_kind", "sig", "type", "fn_id")).alias("m"))
        return checkpointed(best.where("ways = 1").select("owner", "name", "m.*"))

    def method_sets(self) -> DataFrame:
        """(pkg_path, type_name, recv_kind, method, sig); a pointer's set holds the value's."""
        own = self.members.where("method").select(F.col("owner"), "recv_kind", F.col("name").alias("method"), "sig")
        every = own.unionByName(own.where("recv_kind = 'value'").withColumn("recv_kind", F.lit("ptr")))
        keys = self["types"].select(named().alias("owner"), "pkg_path", "type_name").distinct()
        return every.join(keys, "owner").select("pkg_path", "type_name", "recv_kind", "method", "sig").distinct()

    def needs(self, pkg_path: str, iface: str) -> DataFrame:
        """(method, sig) of an interface, with those that it embeds."""
        return self.interfaces.where(F.col("iface") == f"{pkg_path}.{iface}").select("method", "sig")

    # names

    @cached_property
    def local_names(self) -> DataFrame:
        """(eid, value): uses of names that a function defines. A use is joined
        with the definitions of its name whose scope holds its place: the
        innermost wins, and of one scope the first, as later ones assign to it."""
        uses = self["exprs"].where("op = 'name'").select("eid", "file", "name", F.col("at").alias("place"))
        held = uses.join(self["defs"].select("file", "name", "value", "at", "low", "high"), ["file", "name"]).where("at <= place and place < high")
        best = held.groupBy("eid").agg(F.max(F.struct("low", -F.col("at"), "value")).alias("m"))
        return checkpointed(best.select("eid", "m.value"))

    @cached_property
    def global_names(self) -> DataFrame:
        """(eid, what, q, value): uses of names of packages: of the own one, of
        one that a dot import brings in, or behind an import's name."""
        local = self.local_names.select(F.col("eid").alias("of"))
        exprs = self["exprs"].where("alt <> ''").select("eid", F.when(F.col("op") == "sel", F.col("base")).otherwise(F.col("eid")).alias("of"), "alt", "op")
        free = exprs.join(local, "of", "left_anti")
        known = self["names"].groupBy(F.col("name").alias("q")).agg(F.min(F.struct("what", "value")).alias("m")).select("q", "m.*")
        rows = free.join(known, free["alt"] == known["q"], "left")
        read = self["files"].select(F.col("pkg_path").alias("pkg")).distinct().withColumn("read", F.lit(True))
        rows = rows.withColumn("pkg", package_of("alt")).join(read, "pkg", "left")
        outside = (F.col("op") == "sel") & F.col("read").isNull()
        what = F.coalesce("what", F.when(outside, "out"))
        return checkpointed(rows.select("eid", what.alias("what"), F.col("alt").alias("q"), F.coalesce("value", F.when(outside, F.concat(F.lit("out:"), "alt"))).alias("value")))

    # types of expressions

    @cached_property
    def _flow(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Types carried to a fixpoint: what is stated starts, and every round
        joins what the last one told with the expressions made of it. An
        expression is made of one other, so each is told once, and chains of any
        length end; a round writes those that wait on apart, so the next one reads
        only these. Gives (eid, type), instances of generic functions at calls
        (fun, term, values) and those that are written out (fun, term, values)."""
        exprs, glob, local = self["exprs"], self.global_names, self.local_names
        taken = glob.where("what is not null").select("eid")
        free = exprs.where("op = 'name'").join(local.select("eid"), "eid", "left_anti").join(taken, "eid", "left_anti")
        constant = F.create_map(*[F.lit(x) for kv in CONSTANTS.items() for x in kv])
        meant = F.when(F.col("alt").startswith("="), F.concat(F.lit("type:"), F.expr("substring(alt, 2)"))).when(F.col("name").isin(*PREDECLARED), F.concat(F.lit("type:"), "name")).when(F.col("name") == "any", "type:interface{}").otherwise(constant[F.col("name")])
        start = [exprs.where("op = 'type'").select("eid", F.col("name").alias("type")), glob.where("what in ('func', 'type', 'out')").select("eid", F.col("value").alias("type")), free.select("eid", meant.alias("type")).where("type is not null")]
        delta, (n,) = cut(union(start))

        alias = local.where("value <> ''").select("eid", "value").unionByName(glob.where("what = 'var' and value <> ''").select("eid", "value"))
        todo = exprs.where("base <> '' and op not in ('name', 'type')").join(taken, "eid", "left_anti").select("eid", "op", "base", "name", "k")
        todo = todo.unionByName(alias.select("eid", F.lit("same").alias("op"), F.col("value").alias("base"), F.lit("").alias("name"), F.lit(0).alias("k")))
        jump = alias.select(F.col("eid").alias("base"), "value")
        for _ in range(2):  # a name stands for what it is given, so a round less for each
            todo = todo.join(jump, "base", "left").withColumn("base", F.coalesce("value", "base")).drop("value")
        todo = checkpointed(todo.repartition("base"))

        function = F.concat(F.lit("func"), "sig")
        members = self.members.select("owner", "name", F.col("type").alias("member")).unionByName(self.interfaces.select(F.col("iface").alias("owner"), F.col("method").alias("name"), function.alias("member")))
        members = few(checkpointed(members.groupBy("owner", "name").agg(F.min("member").alias("member"))))
        under = few(checkpointed(self["types"].where("under <> ''").groupBy(named().alias("owner")).agg(F.min("under").alias("under"))))

        generic = checkpointed(delta.where(F.col("type").startswith("generic:")).select(F.col("eid").alias("fun"), F.expr("substring(type, 9)").alias("sig")))
        any_generic = not generic.isEmpty()
        args = checkpointed(self["handoffs"].join(generic, "fun").select("fun", "sig", "arg", "sym")) if any_generic else None
        results = checkpointed(todo.where("op = 'ret'").join(generic.select(F.col("fun").alias("base")), "base")) if any_generic else None
        bound = done = None
        known, left = [delta], todo
        while n:
            told = delta.select(F.col("eid").alias("base"), F.col("type").alias("of"))
            rows, (_, n) = cut(left.join(told, "base", "left"), told=F.col("of").isNotNull().cast("long"))
            left, rows = rows.where("of is null").drop("of"), rows.where("of is not null").withColumn("owner", owner_of("of"))
            if n:
                rows = rows.join(members, ["owner", "name"], "left").join(under, "owner", "left")
                new, (n,) = cut(rows.select("eid", _step("op", "of", "name", "k", "member", "under").alias("type")).where("type <> ''"))
            else:
                new = delta.limit(0)
            if any_generic:
                says, (heard,) = cut(args.join(delta, args["sym"] == delta["eid"]).select("fun", "sig", F.explode(_bound("sig", "arg", "type")).alias("b")).select("fun", "sig", "b.*"))
                if heard:
                    bound = says if bound is None else checkpointed(bound.unionByName(says))
                    each = bound.groupBy("fun", "sig", "k").agg(F.min("v").alias("v")).groupBy("fun", "sig").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))  # one entry a parameter
                    whole = each.where(F.size("values") == _needed("sig"))
                    whole = whole if done is None else whole.join(done.select("fun"), "fun", "left_anti")
                    whole = checkpointed(whole.select("fun", _substituted("sig", "values").alias("term"), "values"))
                    done = whole if done is None else checkpointed(done.unionByName(whole))
                    made = results.join(whole.select(F.col("fun").alias("base"), "term"), "base").select("eid", _step(F.lit("ret"), "term", F.lit(""), "k", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("type")).where("type <> ''")
                    new, (n,) = cut(new.unionByName(made))
            delta = new
            known.append(delta)
            if len(known) > 16:
                known = [checkpointed(union(known))]
        typed = checkpointed(union(known))
        spark = typed.sparkSession
        none = spark.createDataFrame([], "fun string, term string, values map<string, string>")
        if not any_generic:
            return typed, none, none
        written = todo.where("op = 'elem'").join(generic.select(F.col("fun").alias("base"), "sig"), "base").withColumn("values", F.map_from_entries(_given("name")))
        return typed, none if done is None else done, checkpointed(written.select(F.col("base").alias("fun"), _substituted("sig", "values").alias("term"), "values"))

    @property
    def typed(self) -> DataFrame:
        """(eid, type) of the expressions of which the type can be told."""
        return self._flow[0]

    @cached_property
    def environments(self) -> DataFrame:
        """(fn_id, values): what type parameters stand for in a function: those
        of calls of generic functions and of instances of their receivers' types,
        those that follow from other environments included."""
        exprs = self["exprs"].select("eid", "fn")
        glob = self.global_names.where("what = 'func'").select(F.col("eid").alias("fun"), F.col("q").alias("fn_id"))
        calls = self._flow[1].unionByName(self._flow[2]).join(glob, "fun").join(exprs.withColumnRenamed("eid", "fun"), "fun")
        calls = calls.select(F.regexp_replace("fn", r"\$.*$", "").alias("fn"), "fn_id", F.to_json("values").alias("v")).distinct()
        types = self.typed.where(F.col("type").rlike(r"[\w]\[")).join(exprs, "eid").select(F.regexp_replace("fn", r"\$.*$", "").alias("fn"), F.explode(_instances("type")).alias("v")).distinct()
        methods = self["methods"].select(named().alias("at"), "fn_id").distinct()
        found = checkpointed(calls.withColumn("kind", F.lit("call")).unionByName(types.select("fn", F.lit(None).cast("string").alias("fn_id"), "v", F.lit("type").alias("kind"))))

        def opened(rows: DataFrame) -> DataFrame:
            """Environments (fn_id, v as JSON) and type instances of closed rows."""
            inst = rows.where("kind = 'type'")
            held = inst.select(owner_of("v").alias("at"), F.to_json(F.map_from_entries(_arguments("v"))).alias("v")).join(methods, "at").select("fn_id", "v")
            return rows.where("kind = 'call'").select("fn_id", "v").unionByName(held).distinct()

        closed = found.where(~is_open("v") | ((F.col("kind") == "call") & ~F.regexp_replace("v", r'"[%$]\d+":', "").rlike(r"[%$]\d")))
        closed = closed.select("fn_id", "v", "kind").distinct()
        waiting = checkpointed(found.join(closed, ["v", "kind"], "left_anti"))
        every, new = None, checkpointed(closed)
        known = None
        while not new.isEmpty():
            every = new if every is None else checkpointed(every.unionByName(new))
            env = opened(new)
            env = checkpointed(env if known is None else env.join(known, ["fn_id", "v"], "left_anti"))
            known = env if known is None else checkpointed(known.unionByName(env))
            made = waiting.withColumnRenamed("v", "open").join(env.select(F.col("fn_id").alias("fn"), F.from_json("v", "map<string, string>").alias("values")), "fn")
            made = made.withColumn("v", _environment("kind", "open", "values")).where(F.size(F.split("v", r"\[")) <= NESTED).select("fn_id", "v", "kind").distinct()
            new = checkpointed(made.join(every, [made["v"] == every["v"], made["kind"] == every["kind"], made["fn_id"].eqNullSafe(every["fn_id"])], "left_anti"))
        if known is None:
            known = closed.select("fn_id", "v")
        instances = (closed if every is None else every).where("kind = 'type'").select(F.col("v").alias("instance")).distinct()
        self.type_instances = checkpointed(instances)
        return checkpointed(known.select("fn_id", F.from_json("v", "map<string, string>").alias("values")))

    def _closed(self, rows: DataFrame, fn: str, term: str) -> DataFrame:
        """rows, those whose term depends on type parameters once for each
        environment of their function; without one they stay as they are."""
        env = self.environments.withColumnRenamed("fn_id", "_fn")
        rows = rows.withColumn("_fn", F.when(is_open(term), F.regexp_replace(fn, r"\$\d+.*$", "")))
        return rows.join(env, "_fn", "left").withColumn(term, F.when(F.col("values").isNotNull(), _substituted(term, "values")).otherwise(F.col(term))).drop("_fn", "values").distinct()

    def _of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """rows with the type of the expression in a column, null if open."""
        types = self.typed.where(~F.col("type").startswith("made:")).select(F.col("eid").alias(column), F.col("type").alias(name))
        return rows.join(types, column, "left")

    def _resolved(self, rows: DataFrame, fn: str) -> DataFrame:
        """Calls or go statements with what is called: q and what (a function of
        a package), of (the type of the receiver) and value (of what is called)."""
        rows = rows.join(self.global_names.select(F.col("eid").alias("fun"), "what", "q"), "fun", "left")
        rows = self._closed(self._of(rows, "recv", "of"), fn, "of")
        return self._closed(self._of(rows, "fun", "value"), fn, "value").withColumn("owner", owner_of("of"))

    @cached_property
    def _calls(self) -> DataFrame:
        return checkpointed(self._resolved(self.roots("calls"), "caller"))

    @cached_property
    def _methods(self) -> DataFrame:
        return checkpointed(self.members.where("method and fn_id <> ''").select("owner", F.col("name").alias("method_name"), F.col("fn_id").alias("target"), "sig"))

    # calls

    def _instance_members(self) -> DataFrame:
        """(owner, method, sig, callee) of instances of generic types."""
        self.environments  # noqa: B018  makes the instances
        inst = self.type_instances.withColumn("of", owner_of("instance"))
        own = self._methods.withColumnRenamed("owner", "of").join(inst, "of")
        return own.select(F.col("instance").alias("owner"), F.col("method_name").alias("method"), _of_type("sig", "instance").alias("sig"), F.col("target").alias("callee"))

    def _implementors(self, needs: DataFrame, asked: DataFrame) -> DataFrame:
        """(iface, method, callee): the methods by which types that have all
        methods of an interface implement it, by value or by pointer; of those
        asked for (iface, method). Interfaces by which nothing is called never
        meet the types: many of one method would meet each type that has it."""
        needs = needs.join(asked.select("iface").distinct(), "iface", "left_semi")
        methods = self._methods.select("owner", F.col("method_name").alias("method"), "sig", F.col("target").alias("callee"))
        held = self.members.where("method and fn_id = ''").select("owner", F.col("name").alias("method"), "sig", F.lit("").alias("callee"))
        methods = methods.unionByName(held).unionByName(self._instance_members()).distinct()
        total = needs.groupBy("iface").agg(F.count("*").alias("need"))
        has = needs.select("iface", "method", "sig").join(methods, ["method", "sig"])
        whole = has.groupBy("iface", "owner").agg(F.count("*").alias("has")).join(total, "iface").where("has = need").select("iface", "owner")
        rows = has.join(whole, ["iface", "owner"]).join(asked, ["iface", "method"], "left_semi")
        return rows.where("callee <> ''").select("iface", "method", "callee").distinct()

    def _method_values(self) -> DataFrame:
        """(sig, target): methods that are taken as values, so that a call of a
        value may be theirs."""
        sels = self["exprs"].where("op = 'sel' and base <> ''").select("eid", "fn", "base", F.col("name").alias("method_name"))
        called = self["calls"].select(F.col("fun").alias("eid")).distinct()
        taken = self._closed(self._of(sels.join(called, "eid", "left_anti"), "base", "of").where("of is not null"), "fn", "of")
        rows = taken.withColumn("owner", owner_of("of")).join(self._methods, ["owner", "method_name"])
        first = F.when(F.col("of").startswith("type:"), F.concat(F.expr("substring(of, 6)"), F.when(F.col("sig").startswith("()"), "").otherwise(",")))
        sig = _of_type("sig", "of")
        sig = F.when(first.isNotNull(), F.concat(F.lit("func("), first, F.expr("substring(sig, 2)"))).otherwise(F.concat(F.lit("func"), sig))
        return rows.select(sig.alias("sig"), "target").distinct()

    def call_edges(self) -> DataFrame:
        """(caller, callee, call_type, file, line, site_ord); see _edges."""
        return self._edges

    @cached_property
    def _edges(self) -> DataFrame:
        """(caller, callee, call_type, file, line, site_ord): calls of known
        functions and of methods of known types; a call of an interface's method
        leads to that method of every type that has its whole method set, a call
        of a function value to every function, closure and method taken as a value
        of its signature. In generic functions and methods of generic types, each
        instance has its own types; its edges are those of the function.
        Functions of packages that aren't read are known by their import alone,
        so a conversion to one of their types counts as a call of it."""
        columns = ["caller", "callee", "call_type", "file", "line", "site_ord"]
        functions = self["functions"].select(F.col("fn_id").alias("callee")).distinct()
        calls = self._calls
        direct = calls.where("callee <> ''").unionByName(calls.where("what = 'func'").withColumn("callee", F.col("q"))).select(columns).join(functions, "callee", "left_semi").select(columns)
        outside = calls.where("what = 'out'").withColumn("callee", F.col("q")).select(columns)
        typed = calls.join(self._methods, ["owner", "method_name"]).withColumn("callee", F.col("target")).select(columns)
        needs = union([self.interfaces.select("iface", "method", "sig"), self._anonymous(calls), self._instance_needs()]).distinct()
        asked = calls.where("method_name <> '' and of is not null").withColumn("iface", F.when(F.col("owner").startswith("interface{"), F.col("owner")).otherwise(instance_of("of")))
        through = asked.withColumnRenamed("method_name", "method").drop("callee").join(needs.select("iface").distinct(), "iface", "left_semi")
        by_sig = self.roots("functions").where("sig <> ''").select("sig", F.col("fn_id").alias("target")).unionByName(self._method_values()).distinct()
        fields = self.members.where("not method").select("owner", F.col("name").alias("method_name"))
        values = calls.where("callee = '' and value like 'func(%' and (what is null or what = 'var')").withColumn("sig", F.col("value"))
        values = values.where("method_name = '' or what = 'var'").unionByName(values.where("what is null").join(fields, ["owner", "method_name"], "left_semi"))
        valued = values.join(by_sig, "sig").withColumn("callee", F.col("target")).select(columns)
        static = direct.unionByName(typed).unionByName(valued)
        by_name = checkpointed(through.select("iface", "method").distinct())
        inside = call_graph.class_hierarchy_edges(static, through, self._implementors(needs, by_name)).join(functions, "callee", "left_semi").select(columns)
        return checkpointed(inside.unionByName(outside).distinct())

    @staticmethod
    def _anonymous(calls: DataFrame) -> DataFrame:
        """Method sets of interfaces without a name, from their spelling."""
        kinds = calls.where(F.col("owner").startswith("interface{")).select(F.col("owner").alias("iface")).distinct()
        return kinds.select("iface", F.explode(_anonymous("iface")).alias("m")).select("iface", "m.method", "m.sig")

    def _instance_needs(self) -> DataFrame:
        """Method sets of instances of generic interfaces."""
        self.environments  # noqa: B018  makes the instances
        inst = self.type_instances.withColumn("of", owner_of("instance"))
        return self.interfaces.withColumnRenamed("iface", "of").join(inst, "of").select(F.col("instance").alias("iface"), "method", _of_type("sig", "instance").alias("sig"))

    def open_methods(self) -> DataFrame:
        """(fn_id): methods with the name of one that is called on something of
        which the type isn't known, or depends on a type parameter that nothing
        stands for; they may be called."""
        names = self._calls.where("method_name <> '' and what is null and callee = ''").where(F.col("of").isNull() | is_open("of")).select(F.col("method_name").alias("name")).distinct()
        return self.roots("functions").where("recv_type <> ''").join(names, "name", "left_semi").select("fn_id")

    def go_sites(self) -> DataFrame:
        """go statements, with the function or method that one starts."""
        methods = self._methods.select("owner", "method_name", F.col("target").alias("found"))
        rows = self._resolved(self.roots("go_sites"), "fn_id").join(methods, ["owner", "method_name"], "left")
        found = F.coalesce("found", F.when(F.col("what").isin("func", "out"), F.col("q")))
        rows = rows.withColumns({"target_kind": F.when(found.isNotNull(), "static").otherwise(F.col("target_kind")), "target": F.coalesce(found, "target")})
        return rows.select("fn_id", "pkg_path", "is_root", "target", "target_kind", "file", "line", "ord").distinct()

    # state

    def instrs(self) -> DataFrame:
        """Allocations and stores of structs that are known, and pointers to
        them that become interfaces."""
        structs = self["types"].where("kind = 'struct'").select(named().alias("struct")).distinct()
        columns = ["fn_id", "ord", "op", "struct", "field", "iface_param", "file", "line"]
        own = self._of(self.roots("instrs"), "sym", "kind").withColumn("struct", F.when(F.col("struct") != "", F.col("struct")).otherwise(owner_of("kind")))
        own = own.join(structs, "struct", "left_semi").select(columns)
        rows = self._of(self.roots("handoffs"), "sym", "kind").where(F.col("kind").startswith("*"))
        rows = rows.withColumn("struct", owner_of("kind")).drop("kind").join(structs, "struct", "left_semi")
        methods = self._methods.select("owner", "method_name", F.col("target").alias("found"))
        called = self._calls.where("fun <> ''").join(methods, ["owner", "method_name"], "left")
        called = called.select("fun", F.coalesce(F.when(F.col("what").isin("func", "out"), F.col("q")), "found").alias("callee")).where("callee is not null").groupBy("fun").agg(F.min("callee").alias("callee"))
        rows = rows.join(called, "fun", "left")
        params = self["functions"].select(F.col("fn_id").alias("callee"), "params").dropDuplicates(["callee"])
        last = F.element_at("params", -1)
        at = F.when(F.size("params") == 0, None).when(last.startswith("...") & (F.col("arg") >= F.size("params") - 1), F.expr("substring(element_at(params, -1), 4)")).otherwise(F.get("params", F.col("arg")))
        rows = rows.join(params, "callee", "left").withColumn("to", F.when(F.col("target") != "", F.col("target")).otherwise(at))
        known = self.interfaces.select(F.col("iface").alias("to")).unionByName(self["types"].where("kind = 'interface'").select(named().alias("to"))).distinct().withColumn("is_iface", F.lit(True))
        rows = rows.withColumn("to", owner_of("to")).join(known, "to", "left")
        printed = F.col("to").isNull() & (F.col("callee").startswith(PRINTING[0]) | F.col("callee").startswith(PRINTING[1]))
        rows = rows.where(F.coalesce("is_iface", F.lit(False)) | F.coalesce(F.col("to").startswith("interface{"), F.lit(False)) | F.coalesce(printed, F.lit(False)))
        return own.unionByName(rows.select("fn_id", "ord", F.lit("MakeInterface").alias("op"), "struct", F.lit("").alias("field"), F.lit(False).alias("iface_param"), "file", "line"))

    # routes

    def route_calls(self) -> DataFrame:
        """Calls that may register routes, with the package of the receiver's
        type; of a receiver made by a package that isn't read, that package."""
        rows = self.roots("route_calls").where("n_args >= 2 and arg0_is_string").join(self.typed.select(F.col("eid").alias("recv"), F.col("type").alias("of")), "recv", "left")
        made = F.when(F.col("of").startswith("made:"), F.expr("substring(of, 6)")).otherwise(package_of(owner_of("of")))
        return rows.withColumn("recv_pkg", F.coalesce(made, F.lit(""))).drop("of")
