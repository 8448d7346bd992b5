"""Finding functions by the names people type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferngraph.functions import receiver_name


class NotFound(LookupError):
    """No function has the name."""


class Ambiguous(LookupError):
    """Several functions have the name, and nothing prefers one."""


def aliases(functions: DataFrame) -> DataFrame:
    """functions (fn_id, name, pkg_path, pkg_name, recv_type, ...) with the
    spellings that mean each: aliases, an array."""
    name, pkg, path, recv = F.col("name"), F.col("pkg_name"), F.col("pkg_path"), receiver_name(F.substring_index("recv_type", ".", -1))
    dot = lambda *c: F.concat_ws(".", *c)
    plain = F.array("fn_id", name, dot(pkg, name), dot(path, name))
    star = F.concat(F.lit("(*"), recv, F.lit(")"))
    own = [dot(recv, name), dot(star, name), dot(F.concat(F.lit("*"), recv), name), dot(F.concat(F.lit("("), recv, F.lit(")")), name)]
    full = [dot(pkg, recv, name), dot(path, recv, name), dot(F.concat(F.lit("(*"), pkg, F.lit("."), recv, F.lit(")")), name), dot(F.concat(F.lit("(*"), path, F.lit("."), recv, F.lit(")")), name)]
    method = F.array("fn_id", name, *own, *full)
    return functions.withColumn("aliases", F.array_distinct(F.when(F.coalesce("recv_type", F.lit("")) == "", plain).otherwise(method)))


def candidates(functions: DataFrame, query: str) -> DataFrame:
    """Functions of the best stage that has any: exact in roots, exact
    anywhere, case-folded in roots, case-folded anywhere; of these the roots'
    if any, then those not synthetic if any. One pass; columns fn_id, stage."""
    low = query.lower()
    exact = F.array_contains("aliases", query)
    method = F.coalesce("recv_type", F.lit("")) != ""
    last = low.rsplit(".", 1)[-1]
    folded = F.lower("name") == low
    folded |= F.lower("fn_id") == low
    folded |= F.exists("aliases", lambda a: F.lower(a) == low)
    if "." in low:
        folded |= method & (F.lower("name") == last)
    stage = F.when(exact & F.col("is_root"), 1).when(exact, 2).when(folded & F.col("is_root"), 3).when(folded, 4)
    rows = aliases(functions).withColumn("stage", stage).where("stage is not null")
    best = rows.agg(F.min("stage").alias("best"))
    rows = rows.join(F.broadcast(best), F.col("stage") == F.col("best")).drop("best")
    rank = F.struct(~F.col("is_root"), F.coalesce("synthetic", F.lit("")) != "")
    top = rows.agg(F.min(rank).alias("top"))
    return rows.join(F.broadcast(top), rank == F.col("top")).select("fn_id", "stage").distinct()


def resolve_all(functions: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, stage, n, fn_id, others): what every asked name (column asked)
    means, by the stages of candidates(): the best stage, how many functions it
    leaves, the first of them, and up to 20 of them where they are several. stage
    is null and n 0 if nothing has the name.

    An inverted index of spellings is joined once as written and once folded, by
    each spelling once: many names may share one, such as a method's name at their
    ends, and what it means is summed up before it goes to them. So no step has
    names times functions, however many have the same."""
    names = asked.select("asked").where("asked is not null").distinct().withColumn("low", F.lower("asked"))
    names = names.withColumn("last", F.when(F.col("low").contains("."), F.element_at(F.split("low", r"\."), -1)))
    rows = aliases(functions).withColumn("made", F.coalesce("synthetic", F.lit("")) != "")
    rows = rows.withColumn("method", F.when(F.coalesce("recv_type", F.lit("")) != "", F.lower("name")))
    index = rows.select("fn_id", "is_root", "made", "method", F.explode("aliases").alias("alias"))
    exact = names.select("asked").join(index, F.col("asked") == F.col("alias"))
    # of a name's folded matches, those that its last part means as well are counted there
    folded = names.select("low", "last").distinct().join(index.withColumn("alias", F.lower("alias")), F.col("low") == F.col("alias"))
    folded = folded.where(~F.col("last").eqNullSafe(F.col("method")) | F.col("last").isNull())
    methods = names.select("last").where("last is not null").distinct().join(rows, F.col("last") == F.col("method"))
    out = names
    for k, (found, key, stage) in enumerate(((exact, "asked", 1), (folded, "low", 3), (methods, "last", 3))):
        out = out.join(_meaning(found, key, stage, k), key, "left")
    # the least of (stage, not in roots, made) wins
    best = F.least("level0", "level1", "level2")
    won = lambda c, other: [F.when(F.col(f"level{k}") == best, F.col(f"{c}{k}")).otherwise(other) for k in range(3)]
    n = reduce(lambda x, y: x + y, won("n", F.lit(0).cast("long")))
    first = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in won("first", F.lit(None))])
    others = F.when(n > 1, F.slice(F.array_sort(first), 1, 20))
    return out.select("asked", best["stage"].cast("int").alias("stage"), n.alias("n"), F.least(*won("fn", F.lit(None))).alias("fn_id"), others.alias("others"))


def _meaning(found: DataFrame, key: str, stage: int, k: int) -> DataFrame:
    """(key, level, n, fn, first), all but the key with k behind: the best level of
    the functions found for a spelling, how many have it, the first and up to 20 of them."""
    level = F.struct(F.when(F.col("is_root"), stage).otherwise(stage + 1).alias("stage"), (~F.col("is_root")).alias("outside"), "made")
    each = found.select(key, level.alias("level"), "fn_id").distinct()
    best = each.groupBy(key, "level").agg(F.count("*").alias("n"), F.min("fn_id").alias("fn")).groupBy(key).agg(F.min(F.struct("level", "n", "fn")).alias("m")).select(key, "m.*")
    w = Window.partitionBy(key, "level").orderBy("fn_id")
    first = each.withColumn("_k", F.row_number().over(w)).where("_k <= 20").groupBy(key, "level").agg(F.sort_array(F.collect_list("fn_id")).alias("first"))
    rows = best.join(first, [key, "level"])
    return rows.select(key, *[F.col(c).alias(f"{c}{k}") for c in ("level", "n", "fn", "first")])


def resolve(functions: DataFrame, query: str) -> str:
    """The one fn_id that a name means; NotFound or Ambiguous otherwise."""
    found = [r.fn_id for r in candidates(functions, query).orderBy("fn_id").limit(21).collect()]
    if not found:
        raise NotFound(f"function not found: {query}")
    if len(found) > 1:
        raise Ambiguous(f"function name {query} is ambiguous: {', '.join(found[:20])}")
    return found[0]
