"""Struct lifecycles and unguarded writes of goroutines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HOPS = (500, 20_000)


def hops(instrs: DataFrame, struct: str) -> DataFrame:
    """(kind, struct, field, function, file, line) of instructions (fn_id, op,
    struct, field, iface_param, file, line): Alloc instantiates, Store to a field
    mutates it, MakeInterface and calls that pass the struct as an interface
    hand it over. Structs are compared by short name."""
    kind = F.when(F.col("op") == "Alloc", "Instantiate").when((F.col("op") == "Store") & (F.coalesce("field", F.lit("")) != ""), "FieldMutation").when((F.col("op") == "MakeInterface") | ((F.col("op") == "Call") & F.col("iface_param")), "InterfaceHandoff")
    rows = instrs.where(F.substring_index("struct", ".", -1) == struct).withColumn("kind", kind).where("kind is not null")
    return rows.select("kind", "struct", F.coalesce("field", F.lit("")).alias("field"), F.col("fn_id").alias("function"), "file", "line")


#: What makes two hops the same, by mode; no mode means none, any other the last.
DEDUPE = {"": None, "none": None, "function_field": ("function", "field"), "function_kind_field": ("function", "kind", "field")}


def dedupe(rows: DataFrame, mode: str, order: tuple[str, ...] = ("file", "line", "function", "kind")) -> DataFrame:
    """The first hop, in this order, of each that the mode holds to be one."""
    keys = DEDUPE.get(mode.strip(), DEDUPE["function_kind_field"])
    if keys is None:
        return rows
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def max_hops(n: int) -> int:
    return MAX_HOPS[0] if n <= 0 else min(n, MAX_HOPS[1])


def hop_summary(rows: DataFrame) -> DataFrame:
    """(what, key, n): counts by kind, function and field that isn't empty."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("key")) for c in ("kind", "function", "field")])).alias("x")).select("x.*")
    return each.where("key <> ''").groupBy("what", "key").agg(F.count("*").alias("n"))


def protected(calls: DataFrame) -> DataFrame:
    """(fn_id): functions that call something atomic, or both lock and unlock.
    calls (fn_id, is_atomic, is_lock, is_unlock)."""
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    guard = calls.groupBy("fn_id").agg(any_of("is_atomic").alias("a"), any_of("is_lock").alias("l"), any_of("is_unlock").alias("u"))
    return guard.where("a or (l and u)").select("fn_id")


def classify_calls(calls_by_name: DataFrame) -> DataFrame:
    """(fn_id, is_atomic, is_lock, is_unlock) of calls (fn_id, callee_str, method_name)."""
    name = F.col("callee_str")
    is_method = lambda m: name.endswith(f".{m}") | (F.col("method_name") == m)
    return calls_by_name.select("fn_id", (name.contains("sync/atomic") | name.startswith("atomic.")).alias("is_atomic"), is_method("Lock").alias("is_lock"), is_method("Unlock").alias("is_unlock"))


def risks(go_sites: DataFrame, stores: DataFrame, guarded: DataFrame) -> DataFrame:
    """(risk_level, struct, field, function, file, line): field stores of
    functions that go statements start and nothing guards; one for each site."""
    started = go_sites.select(F.col("target").alias("fn_id")).join(guarded, "fn_id", "left_anti")
    rows = started.join(stores, "fn_id")
    return rows.select(F.lit("High").alias("risk_level"), "struct", "field", F.col("fn_id").alias("function"), "file", "line")
