"""Complexity, Halstead and maintainability, and duplicate bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import collapse_spaces, round2


def halstead_counts(tokens: DataFrame, key: str = "fn_id") -> DataFrame:
    """(key, n1, n2, N1, N2 as n1, n2, t1, t2): distinct and total operators
    and operands of tokens (key, kind, token, cnt)."""
    each = tokens.groupBy(key, "kind", "token").agg(F.sum("cnt").alias("cnt"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0)).cast("long")
    return each.groupBy(key).agg(of("operator", F.lit(1)).alias("n1"), of("operand", F.lit(1)).alias("n2"), of("operator", F.col("cnt")).alias("t1"), of("operand", F.col("cnt")).alias("t2"))


def halstead(counts: DataFrame) -> DataFrame:
    """volume, difficulty and effort of counts, two decimals; effort is from
    unrounded values."""
    n, total = F.col("n1") + F.col("n2"), F.col("t1") + F.col("t2")
    volume = F.when((n > 0) & (total > 0), total * F.log2(n.cast("double"))).otherwise(0.0)
    difficulty = F.when(F.col("n2") > 0, (F.col("n1") / 2.0) * (F.col("t2").cast("double") / F.col("n2"))).otherwise(0.0)
    return counts.withColumn("volume", round2(volume)).withColumn("difficulty", round2(difficulty)).withColumn("effort", round2(volume * difficulty))


def maintainability(volume: Column, cyclomatic: Column, lines: Column) -> Column:
    """0 to 100; volume (as rounded) and lines count as 1 at least."""
    raw = (F.lit(171.0) - 5.2 * F.log(F.greatest(volume.cast("double"), F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(lines.cast("double"), F.lit(1.0)))) * 100.0 / 171.0
    return round2(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)))


#: Column and direction of each sort mode; any other mode means cognitive.
SORTS = {
    "cognitive": ("cognitive", False),
    "cyclomatic": ("cyclomatic", False),
    "nesting": ("max_nesting", False),
    "lines": ("body_lines", False),
    "halstead_volume": ("volume", False),
    "halstead_difficulty": ("difficulty", False),
    "halstead_effort": ("effort", False),
    "maintainability": ("maintainability", True),
    "package": ("package", True),
    "name": ("function", True),
}


def complexity_order(mode: str) -> list[Column]:
    name, up = SORTS.get(mode, SORTS["cognitive"])
    first = F.col(name).asc() if up else F.col(name).desc()
    if mode == "name":
        return [first]
    return [first, F.col("cognitive").desc(), F.col("cyclomatic").desc(), F.col("body_lines").desc(), F.col("function")]


def complexity_filter(rows: DataFrame, min_cyclomatic: int = 0, min_cognitive: int = 0, min_volume: float = 0, max_maintainability: float = 0) -> DataFrame:
    """Rows within all thresholds; one of 0 or less isn't set."""
    for name, least in (("cyclomatic", min_cyclomatic), ("cognitive", min_cognitive), ("volume", min_volume)):
        if least > 0:
            rows = rows.where(F.col(name) >= least)
    return rows.where(F.col("maintainability") <= max_maintainability) if max_maintainability > 0 else rows


def rollup(rows: DataFrame) -> DataFrame:
    """One row per package. max_function has the largest cognitive, then
    cyclomatic complexity; max_halstead_function the largest volume, empty where
    all are 0; min_maintainability_function the smallest index; the first in
    extraction order (ord) of equal ones."""
    last = -F.col("ord")
    total = lambda c: F.sum(F.col(c).cast("decimal(20,2)")).cast("double")  # noqa: E731  both have two decimals, so that no order of rows matters
    return rows.groupBy("package").agg(
        F.count("*").alias("functions"),
        F.sum("cyclomatic").alias("total_cyclomatic"),
        F.sum("cognitive").alias("total_cognitive"),
        F.max("cyclomatic").alias("max_cyclomatic"),
        F.max("cognitive").alias("max_cognitive"),
        F.avg("cyclomatic").alias("average_cyclomatic"),
        F.avg("cognitive").alias("average_cognitive"),
        F.max_by("function", F.struct("cognitive", "cyclomatic", last)).alias("max_function"),
        round2(total("volume")).alias("total_volume"),
        round2(total("volume") / F.count("volume")).alias("average_volume"),
        F.max("volume").alias("max_volume"),
        F.when(F.max("volume") > 0, F.max_by("function", F.struct("volume", last))).otherwise("").alias("max_halstead_function"),
        round2(total("maintainability") / F.count("maintainability")).alias("average_maintainability"),
        F.min("maintainability").alias("min_maintainability"),
        F.min_by("function", F.struct("maintainability", "ord")).alias("min_maintainability_function"),
    )


def body_hash(text: Column | str) -> Column:
    return F.sha2(collapse_spaces(text).cast("binary"), 256)


def fingerprints(bodies: DataFrame) -> DataFrame:
    """bodies (.., signature, body_text, ..) with body_hash in place of the text."""
    return bodies.withColumn("body_hash", F.when(F.coalesce("body_text", F.lit("")) == "", "").otherwise(body_hash("body_text"))).drop("body_text")


def duplicate_groups(prints: DataFrame, min_lines: int = 3, member: tuple[str, ...] = ("package", "function", "file", "line")) -> DataFrame:
    """(signature, body_hash, body_lines, count, locations): two or more bodies
    of equal signature and hash, of min_lines lines or more (3 if 0 or less).
    Counting comes first, so locations are gathered for repeated bodies only."""
    least = min_lines if min_lines > 0 else 3
    rows = prints.where((F.col("body_hash") != "") & (F.col("body_lines") >= least))
    keys = ["signature", "body_hash"]
    again = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.max("body_lines").alias("lines")).where("count >= 2")
    groups = rows.join(again, keys).groupBy(*keys, "count", F.col("lines").alias("body_lines_")).agg(F.sort_array(F.collect_list(F.struct(*member))).alias("locations"))
    return groups.select(*keys, F.col("body_lines_").alias("body_lines"), "count", "locations")
