"""Interface topology: relational division of method sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def implementors(types: DataFrame, method_sets: DataFrame, iface_methods: DataFrame, keys: tuple[str, ...] = ("pkg_path", "type_name")) -> DataFrame:
    """Types (of kind struct) whose value or pointer method set holds every
    (method, sig) of the interface. An interface without methods is implemented
    by every struct. An interface's methods are few: the broadcast side."""
    structs = types.where("kind = 'struct'").select(*keys).distinct()
    need = iface_methods.select("method", "sig").distinct()
    total = need.agg(F.count("*").alias("need"))
    has = method_sets.join(F.broadcast(need), ["method", "sig"]).groupBy(*keys, "recv_kind").agg(F.count_distinct("method", "sig").alias("has"))
    best = has.groupBy(*keys).agg(F.max("has").alias("has"))
    rows = structs.join(best, list(keys), "left").crossJoin(F.broadcast(total))
    return rows.where(F.coalesce("has", F.lit(0)) == F.col("need")).select(*keys)


def all_implementors(types: DataFrame, method_sets: DataFrame, needs: DataFrame, keys: tuple[str, ...] = ("pkg_path", "type_name")) -> DataFrame:
    """(iface, *keys): every interface with every struct whose value or pointer
    method set holds its whole (method, sig) set, needs (iface, method, sig). A
    join by containment: an interface meets only the structs that have its rarest
    method, and of these the other methods are counted. Interfaces without
    methods are left out: all structs implement them."""
    structs = types.where("kind = 'struct'").select(*keys).distinct()
    sets = method_sets.join(structs, list(keys), "left_semi").select(*keys, "recv_kind", "method", "sig").distinct()
    need = needs.select("iface", "method", "sig").distinct()
    owners = sets.groupBy("method", "sig").agg(F.count("*").alias("owners"))
    ranked = need.join(owners, ["method", "sig"], "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    rarest = ranked.groupBy("iface").agg(F.min(F.struct("owners", "method", "sig")).alias("m"), F.count("*").alias("need")).where("m.owners > 0")
    found = rarest.select("iface", "need", "m.method", "m.sig").join(sets, ["method", "sig"]).select("iface", "need", *keys, "recv_kind", F.col("method").alias("first"), F.col("sig").alias("first_sig"))
    rest = need.withColumnsRenamed({"iface": "i2"})
    sure = found.where("need = 1")
    open_ = found.where("need > 1").join(rest, (F.col("iface") == F.col("i2")) & ~((F.col("method") == F.col("first")) & (F.col("sig") == F.col("first_sig"))))
    has = open_.join(sets, [*keys, "recv_kind", "method", "sig"], "left_semi").groupBy("iface", "need", *keys, "recv_kind").agg(F.count("*").alias("has")).where("has = need - 1")
    return sure.select("iface", *keys).unionByName(has.select("iface", *keys)).distinct()


def pick_interface(interfaces: DataFrame, name: str) -> DataFrame:
    """The one interface a name means: of that package if qualified, else of
    the first root package that has it. Columns pkg_path, iface, is_root, ord."""
    if "." in name:
        pkg, _, short = name.rpartition(".")
        return interfaces.where((F.col("iface") == short) & ((F.col("pkg_path") == pkg) | F.col("pkg_path").endswith("/" + pkg))).orderBy("ord").limit(1)
    return interfaces.where((F.col("iface") == name) & F.col("is_root")).orderBy("ord").limit(1)
