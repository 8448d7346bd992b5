"""HTTP routes and gRPC endpoints."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import anchor

# Router method names and the HTTP methods they register.
ROUTER_METHODS = {
    "HandleFunc": "ANY", "Handle": "ANY",
    "GET": "GET", "POST": "POST", "PUT": "PUT", "PATCH": "PATCH", "DELETE": "DELETE", "HEAD": "HEAD", "OPTIONS": "OPTIONS", "CONNECT": "CONNECT", "TRACE": "TRACE",
    "Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE", "Head": "HEAD", "Options": "OPTIONS", "Connect": "CONNECT",
    "ANY": "ANY", "Any": "ANY", "All": "ANY",
}

# Package path prefixes of router types and their frameworks.
ROUTER_PACKAGES = {
    "net/http/": "net/http",
    "github.com/labstack/echo": "echo",
    "github.com/gofiber/fiber": "fiber",
    "github.com/valyala/fasthttp": "fasthttp",
    "github.com/fasthttp/router": "fasthttp",
    "github.com/go-chi/chi": "chi",
    "github.com/gin-gonic/gin": "gin",
    "github.com/gorilla/mux": "gorilla/mux",
}

# What a method's spelling suggests where the type isn't known.
ROUTER_SPELLINGS = {
    "fiber": ("All",),
    "fasthttp": ("ANY",),
    "echo": ("Any", "Connect", "Trace"),
    "gin": ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "CONNECT", "TRACE"),
    "chi": ("Get", "Post", "Put", "Patch", "Delete", "Head", "Options"),
}


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))[key]


def handler_name(kind: Column, name: Column) -> Column:
    return F.when(kind.isin("ident", "selector"), name).when(kind == "func_lit", "<inline>").otherwise("<unknown>")


def framework_by_type(recv_pkg: Column) -> Column:
    """Null where the receiver's package isn't known or is no framework's."""
    path = F.concat(recv_pkg, F.when(recv_pkg == "net/http", "/").otherwise(""))
    return F.coalesce(*[F.when(path.startswith(prefix), name) for prefix, name in ROUTER_PACKAGES.items()])


def framework_by_spelling(sel: Column, recv: Column) -> Column:
    low = F.lower(recv)
    plain = F.when((low != "http") & (low.contains("mux") | low.contains("router")), "gorilla/mux").otherwise("net/http")
    out = F.when(sel.isin("HandleFunc", "Handle"), plain)
    for name, spellings in ROUTER_SPELLINGS.items():
        out = out.when(sel.isin(*spellings), name)
    return out.otherwise("unknown")


def routes(calls: DataFrame) -> DataFrame:
    """(method, path, handler, framework, file, line, anchor) of route_calls:
    calls of a router method with two or more arguments, the first a string
    literal. Only double quotes are trimmed from the path."""
    method = lookup(ROUTER_METHODS, F.col("sel_name"))
    rows = calls.where(method.isNotNull() & (F.col("n_args") >= 2) & F.col("arg0_is_string"))
    path = F.regexp_replace("arg0", '^"+|"+$', "")
    framework = F.coalesce(framework_by_type(F.col("recv_pkg")), framework_by_spelling(F.col("sel_name"), F.coalesce("recv_ident", F.lit(""))))
    out = rows.select(method.alias("method"), path.alias("path"), handler_name(F.col("arg1_kind"), F.col("arg1_name")).alias("handler"), framework.alias("framework"), "file", "line")
    return out.withColumn("anchor", anchor("file", "line", "handler"))


def rpc_type(server_streams: Column, client_streams: Column) -> Column:
    return F.when(server_streams & client_streams, "bidi_stream").when(server_streams, "server_stream").when(client_streams, "client_stream").otherwise("unary")


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def registrations(register_calls: DataFrame, register_funcs: DataFrame, services: DataFrame) -> DataFrame:
    """register_calls with the service each registers: by the register
    function's descriptor in its package, else by a function name that only one
    package declares. Columns service and desc_name are null if neither knows."""
    own = register_funcs.select(F.col("pkg_path").alias("callee_pkg"), F.col("func_name").alias("callee_name"), F.col("desc_name").alias("d1"))
    unique = register_funcs.groupBy(F.col("func_name").alias("callee_name")).agg(F.count("*").alias("n"), F.max("desc_name").alias("d2"), F.max("pkg_path").alias("p2")).where("n = 1").drop("n")
    rows = register_calls.join(own, ["callee_pkg", "callee_name"], "left").join(unique, "callee_name", "left")
    rows = rows.withColumn("desc_name", F.coalesce("d1", "d2")).withColumn("desc_pkg", F.when(F.col("d1").isNotNull(), F.col("callee_pkg")).otherwise(F.col("p2")))
    known = services.select(F.col("pkg_path").alias("desc_pkg"), "desc_name", "service").distinct()
    return rows.join(known, ["desc_pkg", "desc_name"], "left").drop("d1", "d2", "p2")


def implementations(regs: DataFrame) -> DataFrame:
    """(service, implementations): distinct ones in the order of their calls."""
    first = regs.where("service is not null").groupBy("service", "implementation").agg(F.min("ord").alias("ord"))
    listed = first.groupBy("service").agg(F.sort_array(F.collect_list(F.struct("ord", "implementation"))).alias("x"))
    return listed.select("service", F.transform("x", lambda r: r["implementation"]).alias("implementations"))


def endpoints(services: DataFrame, methods: DataFrame, impl: DataFrame) -> DataFrame:
    """(service, method, rpc_type, full_method, registered, implementations, and
    file and line of services that have them):
    implementations by the service's full name, else by a short name that only
    one service has."""
    short = impl.withColumn("short", last_segment(F.col("service"))).groupBy("short").agg(F.count("*").alias("n"), F.max("implementations").alias("i2")).where("n = 1").drop("n")
    names = services.select("service").distinct().groupBy(last_segment(F.col("service")).alias("short")).agg(F.count("*").alias("m")).where("m = 1").select("short")
    rows = services.join(methods, ["pkg_path", "desc_name"]).withColumn("short", last_segment(F.col("service")))
    rows = rows.join(impl.withColumnRenamed("implementations", "i1"), "service", "left").join(short.join(names, "short", "left_semi"), "short", "left")
    found = F.coalesce("i1", "i2", F.array().cast("array<string>"))
    place = [c for c in ("file", "line") if c in services.columns]
    return rows.select("service", "method", *place, rpc_type(F.col("server_streams"), F.col("client_streams")).alias("rpc_type"), F.concat(F.lit("/"), "service", F.lit("/"), "method").alias("full_method"), (F.size(found) > 0).alias("registered"), found.alias("implementations"))
