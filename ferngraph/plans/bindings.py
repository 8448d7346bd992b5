"""Fact tables bound to the driver's tables, so that every operator runs on
real volume: call edges from consecutive lines of an order, packages
from brand and type of parts, bodies and tokens from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.plans.graphs import FEW, dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts on consecutive lines of one order."""
    pairs, rows = _consecutive(spark, sf_dir, "src", "dst")
    return dealt(pairs.select("src", "dst"), rows, "src", "dst").distinct()


def _consecutive(spark: SparkSession, sf_dir: str, first: str, second: str) -> tuple[DataFrame, int]:
    """(l_orderkey, n, first, second): different parts on consecutive lines of
    one order; and how many lines there are."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count()  # from the files' footers
    a = lines.select("l_orderkey", F.col("l_partkey").alias(first), (F.col("l_linenumber") + 1).alias("n"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias(second), F.col("l_linenumber").cast(a.schema["n"].dataType).alias("n"))
    a, b = (dealt(x, rows, "l_orderkey", "n") for x in (a, b))
    return a.join(b, ["l_orderkey", "n"]).where(F.col(first) != F.col(second)), rows


def first_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each part with the one that follows it first."""
    s = sites(spark, sf_dir)
    return s.groupBy(F.col("caller").alias("src")).agg(F.min(F.struct("site_ord", "callee"))["callee"].alias("dst"))


def root(edges: DataFrame) -> DataFrame:
    """(id): the source of most edges, the smallest of equal ones."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def sink(edges: DataFrame) -> DataFrame:
    return root(edges.select(F.col("dst").alias("src")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, part = graph(spark, sf_dir), table(spark, sf_dir, "part")
    size = part.select(F.col("p_partkey").alias("dst"), (F.col("p_size") % 3).alias("m"))
    if part.count() <= FEW:
        size = F.broadcast(size)
    else:
        g, size = (dealt(x, table(spark, sf_dir, "lineitem").count(), "dst") for x in (g, size))
    kind = F.when(F.col("m") == 0, "Static").when(F.col("m") == 1, "Interface").otherwise("Goroutine")
    return g.join(size, "dst").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), kind.alias("call_type"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee, site_ord): the same graph with every place of an edge."""
    return _consecutive(spark, sf_dir, "caller", "callee")[0].select("caller", "callee", (F.col("l_orderkey") * 10 + F.col("n")).alias("site_ord"))


def package(brand: str = "p_brand", kind: str = "p_type") -> Column:
    return F.concat(F.col(brand), F.lit("/"), F.col(kind))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(package().alias("pkg_path")).agg(F.min("p_name").alias("first_file"))
    return p.select("pkg_path", F.lit("").alias("module_path"), F.lit(True).alias("is_root"), "first_file")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    of = lambda end, c: part.select(F.col("p_partkey").alias(end), package().alias(c))
    g = graph(spark, sf_dir).join(of("src", "pkg_path"), "src").join(of("dst", "import_path"), "dst")
    rows = g.where("pkg_path <> import_path").select("pkg_path", "import_path").distinct()
    return rows.select("pkg_path", "import_path", F.lit("").alias("import_module"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("ord"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.size(F.split("text", "\n", -1))
    return d.select(F.col("doc_id").alias("function"), F.col("source").alias("package"), F.col("lang").alias("signature"), F.col("text").alias("body_text"), lines.alias("body_lines"), F.lit("").alias("file"), F.lit(0).alias("line"))


STOP_WORDS = ("the", "of", "and", "to", "in", "is", "der", "die", "und", "la", "le", "de", "el", "que", "les", "en")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, kind, token, cnt): words of conversations; stop words are operators."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    word = c.select(F.col("conv_id").alias("fn_id"), F.explode(F.split(F.lower("text"), " ")).alias("token")).where("token <> ''")
    kind = F.when(F.col("token").isin(*STOP_WORDS), "operator").otherwise("operand")
    return word.groupBy("fn_id", "token").agg(F.count("*").alias("cnt")).select("fn_id", kind.alias("kind"), "token", "cnt")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity rows of parts: out-degree as cyclomatic complexity, in-degree
    as cognitive, price as volume."""
    g = graph(spark, sf_dir)
    out, into = g.groupBy(F.col("src").alias("p_partkey")).agg(F.count("*").alias("o")), g.groupBy(F.col("dst").alias("p_partkey")).agg(F.count("*").alias("i"))
    p = table(spark, sf_dir, "part").join(out, "p_partkey", "left").join(into, "p_partkey", "left")
    from ferngraph.operators.metrics import maintainability

    rows = p.select(
        F.col("p_partkey").alias("function"), F.col("p_brand").alias("package"), (F.coalesce("o", F.lit(0)) + 1).cast("long").alias("cyclomatic"), F.coalesce("i", F.lit(0)).cast("long").alias("cognitive"),
        (F.col("p_size") % 7).cast("long").alias("max_nesting"), F.col("p_size").cast("long").alias("body_lines"), F.col("p_retailprice").alias("volume"), F.col("p_partkey").alias("ord"),
    )
    return rows.withColumn("maintainability", maintainability(F.col("volume"), F.col("cyclomatic"), F.col("body_lines"))).withColumn("difficulty", F.col("volume") / 10).withColumn("effort", F.col("volume") * 2)
