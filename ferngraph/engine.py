"""The query surface: 22 tools over the fact sets of Go code bases.

Every tool takes the folder and patterns of a code base, returns a plain dict
and raises on errors; run() gives either as JSON. Paged tools take the options
of delivery.Options by name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ferngraph.functions import anchor, is_stdlib, short_function_name
from ferngraph.operators import calls, delivery, liveness, metrics, packages, resolve, state, surfaces, types
from ferngraph.operators.delivery import Diagram, Options
from ferngraph.sources import config
from ferngraph.sources.catalog import FactCatalog, key_of
from ferngraph.sources.gofacts import changed_files, go_facts
from ferngraph.sources.gotypes import FactSet


def _plain(v):
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items() if x is not None}
    return [_plain(x) for x in v] if isinstance(v, list) else v


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.orders = delivery.Orders()
        self.catalog = FactCatalog(lambda root, patterns: go_facts(spark, root, patterns, config.module_pairs(config.suggest(root)), previous=self._previous.pop(key_of(root, patterns), None)))
        self._previous: dict[str, FactSet] = {}

    def run(self, tool: str, **arguments) -> str:
        """A tool's result as JSON: {"is_error": false, "result": ...}, or
        {"is_error": true, "error": ...} for what it refuses."""
        known = [k for k in dir(self) if not k.startswith("_") and k not in ("run", "spark", "catalog", "orders")]
        try:
            if tool not in known:
                raise LookupError(f"unknown tool {tool}; there are {', '.join(known)}")
            return json.dumps({"is_error": False, "result": getattr(self, tool)(**arguments)}, ensure_ascii=False, default=str)
        except (LookupError, ValueError, TypeError, OSError) as e:
            return json.dumps({"is_error": True, "error": str(e)}, ensure_ascii=False)

    # shared steps

    def _facts(self, root: str, patterns: list[str] | None, pattern: str = "") -> FactSet:
        settings = config.effective(root)
        if settings["cache"]["capacity"]:
            self.catalog.set_capacity(settings["cache"]["capacity"])
        return self.catalog.get(root, self._asked(root, patterns, pattern))

    @staticmethod
    def _asked(root: str, patterns: list[str] | None, pattern: str = "") -> list[str]:
        return config.merge_patterns(patterns or [], pattern, config.effective(root))

    def _options(self, root: str, given: dict) -> Options:
        out = config.effective(root)["output"]
        return Options(**{k: given.get(k) or out.get(k) or ("" if k == "cursor" else 0) for k in ("offset", "limit", "max_items", "chunk_size", "cursor")})

    def _page(self, name: str, df: DataFrame, order: list[str], key: list[str], root: str, given: dict, descending: tuple[str, ...] = ()) -> dict:
        columns = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
        page = delivery.deliver(df, order, f"{name}:{root}", columns, self._options(root, given), descending, self.orders)
        out = {"total": page.total, "total_before_truncate": page.total, "truncated": page.truncated, "items": _plain(page.rows)}
        return out | ({"has_more": page.has_more, "next_cursor": page.next_cursor} if given.get("chunk_size") else {})

    def _function(self, facts: FactSet, name: str) -> DataFrame:
        return self.spark.createDataFrame([(resolve.resolve(facts["functions"], name),)], "id string")

    # Types and packages

    def get_interface_topology(self, root: str, interface: str, patterns: list[str] | None = None, include_stdlib: bool = True, summary: bool = False, **o) -> dict:
        facts = self._facts(root, patterns)
        known = facts["types"].where("kind = 'interface'").select("pkg_path", F.col("type_name").alias("iface"), "is_root", "ord")
        found = types.pick_interface(known, interface).collect()
        if not found:
            raise resolve.NotFound(f"interface not found: {interface}")
        rows = types.implementors(facts["types"], facts.method_sets(), facts.needs(found[0].pkg_path, found[0].iface)).join(facts["types"], ["pkg_path", "type_name"])
        if not include_stdlib:
            rows = rows.join(facts["files"].select("pkg_path", "module_path").distinct(), "pkg_path").where(F.col("is_root") | (F.col("module_path") != "") | ~is_stdlib("pkg_path"))
        rows = rows.select(F.col("type_name").alias("struct"), F.col("pkg_path").alias("package"), "file", "line", anchor("file", "line", "type_name").alias("anchor"))
        out = self._page("topology", rows, ["package", "struct", "file", "line"], ["package", "struct"], root, o)
        return out | ({"summary": {"total_implementors": out["total"]}} if summary else {})

    def get_package_dependencies(self, root: str, patterns: list[str] | None = None, include_stdlib: bool = False, summary: bool = False, export: str = "", **o) -> dict:
        form, facts = delivery.parse_format(export), self._facts(root, patterns)
        rows = packages.dependencies(facts.packages(), facts["imports"], include_stdlib)
        out = self._page("dependencies", rows, ["package"], ["package"], root, o)
        if summary:
            counts = {r.package: r.n for r in rows.select("package", F.size("imports").alias("n")).collect()}
            out["summary"] = {"imports_by_package": counts, "total_packages": len(counts), "total_imports": sum(counts.values())}
        if form:
            d = Diagram("package dependencies", "LR")
            for r in out["items"]:
                d.node(r["package"])
                for i in r["imports"]:
                    d.edge(r["package"], i)
            out["graph"] = d.render(form)
        return out

    def find_reverse_dependencies(self, root: str, package: str, patterns: list[str] | None = None, include_transitive: bool = False, export: str = "", **o) -> dict:
        form, facts = delivery.parse_format(export), self._facts(root, patterns)
        out = self._page("reverse", packages.direct_dependents(facts["imports"], package), ["package"], ["package"], root, o)
        out["direct_count"] = out["total"]
        if include_transitive:
            rows = packages.transitive_dependents(facts["imports"], package)
            opts = self._options(root, o)
            most = min((n for n in (opts.limit, opts.max_items) if n > 0), default=0)
            out["transitive_count"] = rows.count()
            ordered = rows.orderBy("package")
            out["transitive"] = [r.package for r in (ordered.limit(most) if most else ordered).collect()]
        if form:
            d = Diagram(f"dependents of {package}", "LR")
            d.node(package, "target")
            for r in out["items"]:
                d.edge(r["package"], package)
            for p in out.get("transitive", []):
                d.edge(p, package, "", "dashed")
            out["graph"] = d.render(form)
        return out

    def check_architecture_boundaries(self, root: str, rules: list[dict] | None = None, patterns: list[str] | None = None, export: str = "", **o) -> dict:
        form, rules = delivery.parse_format(export), rules or config.effective(root)["boundaries"]
        if not rules:
            return {"total": 0, "violation_count": 0, "checked_packages": 0, "truncated": False, "items": []}
        facts = self._facts(root, patterns)
        table = self.spark.createDataFrame([(r["type"], r["from"], r["to"]) for r in rules], "type string, `from` string, `to` string")
        found = packages.violations(facts["imports"], facts.packages(), table)
        out = self._page("boundaries", found, ["from", "import", "rule", "to"], ["from", "import", "rule"], root, o)
        out |= {"violation_count": out["total"], "checked_packages": facts.packages().where("is_root").count()}
        if form:
            d = Diagram("boundary violations", "LR")
            for r in out["items"]:
                d.node(r["from"], "violation")
                d.edge(r["from"], r["import"], r["rule"], "dashed")
            out["graph"] = d.render(form)
        return out

    # graphs

    def _hierarchy(self, root, rows, name, o, summary, form, start) -> dict:
        rows = calls.with_anchor(rows)
        out = self._page(name, rows, list(calls.EDGE_ORDER), ["caller", "callee", "depth"], root, o)
        if summary:
            out["summary"] = {f"by_{k}": {r.key: r.n for r in calls.summary(rows, k).collect()} for k in ("call_type", "caller", "callee")} | {"total_edges": out["total"]}
        if form:
            d = Diagram("call hierarchy", "TD")
            d.node(start, "root")
            for r in out["items"]:
                d.edge(r["caller"], r["callee"], r["call_type"])
            out["graph"] = d.render(form)
        return out

    def analyze_call_hierarchy(self, root: str, function: str, max_depth: int = 0, patterns: list[str] | None = None, summary: bool = False, export: str = "", **o) -> dict:
        form, facts = delivery.parse_format(export), self._facts(root, patterns)
        start = self._function(facts, function)
        return self._hierarchy(root, calls.hierarchy(facts.call_edges(), start, max_depth), "hierarchy", o, summary, form, start.first().id)

    def find_callers(self, root: str, function: str, max_depth: int = 0, patterns: list[str] | None = None, **o) -> dict:
        facts = self._facts(root, patterns)
        return self._hierarchy(root, calls.callers(facts.call_edges(), self._function(facts, function), max_depth), "callers", o, False, "", "")

    def find_call_path(self, root: str, source: str, target: str, max_depth: int = 0, max_paths: int = 0, patterns: list[str] | None = None) -> dict:
        facts = self._facts(root, patterns)
        depth, most = calls.path_limits(max_depth, max_paths)
        rows = calls.paths(facts.call_edges(), self._function(facts, source), self._function(facts, target), depth, most).collect()
        return {"reachable": bool(rows), "paths": [{"steps": list(r.path)} for r in rows], "cutoff_reason": calls.cutoff_reason(len(rows), most)}

    def detect_import_cycles(self, root: str, patterns: list[str] | None = None) -> dict:
        facts = self._facts(root, patterns)
        edges = facts["imports"].select(F.col("pkg_path").alias("src"), F.col("import_path").alias("dst")).distinct()
        rows = packages.import_cycles(edges, facts.packages().select(F.col("pkg_path").alias("id"))).orderBy("size", F.col("members")[0]).collect()
        return {"cycles": [{"members": list(r.members)} for r in rows], "total": len(rows)}

    # state

    def trace_struct_lifecycle(self, root: str, struct: str, patterns: list[str] | None = None, dedupe_mode: str = "", max_hops: int = 0, summary: bool = False, **o) -> dict:
        settings, facts = config.effective(root)["lifecycle"], self._facts(root, patterns)
        rows = state.dedupe(state.hops(facts.instrs(), struct), dedupe_mode or settings["dedupe_mode"])
        order, most = ["file", "line", "function", "kind", "field"], state.max_hops(max_hops or settings["max_hops"])
        capped = rows.orderBy(*order).limit(most).withColumn("anchor", anchor("file", "line", short_function_name("function")))
        out = self._page("lifecycle", capped, order, order, root, o)
        total = rows.count()
        out |= {"total": total, "total_before_truncate": total, "truncated": out["truncated"] or total > most}
        if summary:
            out["summary"] = {}
            for r in state.hop_summary(rows).collect():
                out["summary"].setdefault(f"total_by_{r.what}", {})[r.key] = r.n
        return out

    def detect_concurrency_risks(self, root: str, patterns: list[str] | None = None) -> dict:
        facts = self._facts(root, patterns)
        stores = facts.instrs().where("op = 'Store' and field <> ''")
        rows = state.risks(facts.go_sites().where("target <> ''"), stores, state.protected(state.classify_calls(facts.roots("calls").select(F.col("caller").alias("fn_id"), "callee_str", "method_name"))))
        rows = rows.withColumn("reasoning", F.lit("field is written in a goroutine without a visible lock or atomic operation")).withColumn("anchor", anchor("file", "line", short_function_name("function")))
        return {"risks": _plain(rows.orderBy("file", "line", "struct", "field").collect())}

    # Surfaces and scores

    def list_entrypoints(self, root: str, patterns: list[str] | None = None, **o) -> dict:
        facts = self._facts(root, patterns)
        rows = liveness.entrypoints(facts.roots("functions"), facts.go_sites())
        return self._page("entrypoints", rows, ["kind", "package", "function"], ["kind", "package", "function"], root, o)

    def list_http_routes(self, root: str, patterns: list[str] | None = None, **o) -> dict:
        rows = surfaces.routes(self._facts(root, patterns).route_calls())
        return self._page("routes", rows, ["path", "method", "file", "line"], ["method", "path", "file", "line"], root, o)

    def list_grpc_endpoints(self, root: str, patterns: list[str] | None = None, **o) -> dict:
        facts = self._facts(root, patterns)
        regs = surfaces.registrations(facts.roots("grpc_register_calls"), facts.roots("grpc_register_funcs"), facts.roots("grpc_services"))
        services = facts.roots("grpc_services").select("pkg_path", "desc_name", "service", "file", "line")
        ends = surfaces.endpoints(services, facts.roots("grpc_methods").drop("is_root"), surfaces.implementations(regs)).withColumn("entry", F.lit("endpoint"))
        regs = regs.where("service is not null").select("service", F.col("callee_name").alias("method"), "implementation", "file", "line", F.lit("registration").alias("entry"))
        every = ends.unionByName(regs, allowMissingColumns=True)
        key = ["entry", "service", "method", "rpc_type", "file", "line"]
        every = every.withColumns({c: F.coalesce(F.col(c), F.lit("" if c != "line" else 0)) for c in ("rpc_type", "file", "line")})
        out = self._page("grpc", every, key, key, root, o)
        out |= {"endpoints": [r for r in out["items"] if r["entry"] == "endpoint"], "registrations": [r for r in out.pop("items") if r["entry"] == "registration"]}
        return out

    def find_dead_code(self, root: str, patterns: list[str] | None = None, include_exported: bool = False, **o) -> dict:
        facts = self._facts(root, patterns)
        rows = liveness.dead_of(facts, include_exported)
        rows = rows.select("kind", F.col("id").alias("function"), F.col("pkg_path").alias("package"), "exported", "file", "line", anchor("file", "line", "name").alias("anchor"))
        return self._page("dead", rows, ["kind", "package", "function"], ["kind", "function"], root, o)

    def find_duplicate_methods(self, root: str, patterns: list[str] | None = None, min_lines: int = 0, **o) -> dict:
        prints = metrics.fingerprints(self._facts(root, patterns).roots("func_bodies"))
        groups = metrics.duplicate_groups(prints, min_lines)
        return self._page("duplicates", groups, ["count", "body_lines", "body_hash", "signature"], ["signature", "body_hash"], root, o, ("count", "body_lines"))

    def compute_complexity_metrics(self, root: str, patterns: list[str] | None = None, sort_by: str = "", include_packages: bool = False, min_cyclomatic: int = 0, min_cognitive: int = 0, min_volume: float = 0, max_maintainability: float = 0, **o) -> dict:
        settings, facts = config.effective(root)["complexity"], self._facts(root, patterns)
        scores = metrics.halstead(metrics.halstead_counts(facts.roots("halstead_tokens"))).withColumnRenamed("fn_id", "function")
        rows = facts.roots("control_flow").join(scores, "function", "left").fillna(0, ["volume", "difficulty", "effort"])
        rows = rows.withColumn("maintainability", metrics.maintainability(F.col("volume"), F.col("cyclomatic"), F.col("body_lines"))).withColumn("anchor", anchor("file", "line", short_function_name("function")))
        kept = metrics.complexity_filter(rows, min_cyclomatic or settings["min_cyclomatic"], min_cognitive or settings["min_cognitive"], min_volume, max_maintainability)
        mode = sort_by or settings["sort_by"]
        name, up = metrics.SORTS.get(mode, metrics.SORTS["cognitive"])
        order = [name] if mode == "name" else list(dict.fromkeys([name, "cognitive", "cyclomatic", "body_lines", "function"]))
        down = tuple(c for c in order if c in ("cognitive", "cyclomatic", "body_lines") or (c == name and not up))
        out = self._page(f"complexity:{mode}", kept, order, ["function", "file", "line"], root, o, down)
        if include_packages or settings["include_packages"]:
            ranked = metrics.rollup(rows).orderBy(F.desc("total_cognitive"), F.desc("max_cognitive"), "package")
            out["packages"] = _plain(ranked.collect())
        return out

    # Cache and configuration

    def reload_workspace(self, root: str, patterns: list[str] | None = None) -> dict:
        """Read the folder again; files that haven't changed aren't parsed."""
        asked = self._asked(root, patterns)
        before = self.catalog.held(root, asked)
        self.catalog.clear(root)
        if before is not None:
            self._previous[key_of(root, asked)] = before
        facts = self._facts(root, patterns)
        files = {r.state: r["count"] for r in (changed_files(before, facts) if before is not None else changed_files(facts, facts).withColumn("state", F.lit("parsed"))).groupBy("state").count().collect()}
        return {"reloaded": True, "packages": facts.packages().where("is_root").count(), "files": {k: files.get(k, 0) for k in ("kept", "parsed", "dropped")}}

    def cache_status(self) -> dict:
        return self.catalog.status()

    def clear_cache(self, root: str | None = None, patterns: list[str] | None = None) -> dict:
        return {"cleared": self.catalog.clear(root, patterns)} | self.catalog.status()

    def inspect_workspace_config(self, root: str) -> dict:
        return config.inspect(root)

    def suggest_workspace_config(self, root: str) -> dict:
        made = config.suggest(root)
        return {"config": made, "yaml": config.marshal(made)}

    def init_workspace_config(self, root: str, overwrite: bool = False) -> dict:
        return config.init(root, overwrite)
