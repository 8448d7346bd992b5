"""Columns of names, and Go sources made from the driver's tables, as registered
queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph import functions as fn
from ferngraph.operators import metrics
from ferngraph.plans.bindings import table
from ferngraph.plans.catalogue import query
from ferngraph.sources.gofacts import go_facts


# helpers, over the driver's tables


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%.' THEN p_name ELSE split_part(p_name, '.', -1) END AS short_function, split_part(replace(replace(replace(p_name, '(', ''), ')', ''), '*', ''), '.', -1) AS short_type,
  regexp_replace(regexp_replace('*' || p_name || '[T]', '^\\*+', ''), '\\[.*$', '') AS receiver, replace(replace(replace(p_name, '|', '/'), '"', ''''), chr(10), ' ') AS label,
  '[Context Anchor] ' || p_brand || ':' || p_size || ' ' || p_name AS anchor FROM part""")
def go_helper_columns(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.short_function_name(name).alias("short_function"), fn.short_type_name(name).alias("short_type"), fn.receiver_name(F.concat(F.lit("*"), name, F.lit("[T]"))).alias("receiver"),
        fn.mermaid_label(name).alias("label"), fn.anchor("p_brand", "p_size", "p_name").alias("anchor"),
    )


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Z]') AS exported, regexp_matches(p_name, '^[A-Z]') AND regexp_matches(p_brand, '^[A-Z]') AS exported_method, regexp_replace(regexp_replace(p_type, '^([0-9])', '_\\1'), '[^A-Za-z0-9_]', '', 'g') AS identifier FROM part")
def go_exported_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.is_exported("p_name").alias("exported"), fn.is_exported("p_name", "p_brand").alias("exported_method"), fn.dot_identifier("p_type").alias("identifier"))


# sources made from tables: one file for each part, as many branches as its size says


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): part k - 1 is package pk of module m, with a function that
    has p_size % 5 nested branches and calls the function of the package before."""
    k, n = F.col("p_partkey") + 1, (F.col("p_size") % 5).cast("int")
    before = F.concat(F.lit("p"), (k - 1).cast("string"))
    head = F.concat(F.lit("package p"), k.cast("string"), F.lit('\n\nimport "m/'), before, F.lit('"\n\nfunc F(a int) int {\n'))
    branches = F.concat(F.repeat(F.lit("if a > 1 {\n"), n), F.lit("a += "), before, F.lit(".F(a)\n"), F.repeat(F.lit("}\n"), n))
    text = F.concat(head, branches, F.lit("return a\n}\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("/made/p"), k.cast("string"), F.lit("/a.go")).alias("path"), text.cast("binary").alias("content"))


def _made_facts(spark, sf_dir):
    return go_facts(spark, "/made", None, [("", "m")], _made(spark, sf_dir))


@query("""SELECT 'm/p' || (p_partkey + 1) || '.F' AS "function", CAST(p_size % 5 + 1 AS BIGINT) AS cyclomatic, CAST((p_size % 5) * (p_size % 5 + 1) / 2 + 1 AS BIGINT) AS cognitive, CAST(p_size % 5 AS BIGINT) AS max_nesting,
  CAST(2 * (p_size % 5) + 4 AS BIGINT) AS body_lines, 5 AS line FROM part""")
def go_made_complexity(spark, sf_dir):
    return _made_facts(spark, sf_dir)["control_flow"].select("function", "cyclomatic", "cognitive", "max_nesting", "body_lines", "line")


@query("SELECT 'm/p' || (p_partkey + 1) AS pkg_path, 'm/p' || p_partkey AS import_path, 'm' AS import_module, 3 AS line FROM part")
def go_made_imports(spark, sf_dir):
    return _made_facts(spark, sf_dir)["imports"].select("pkg_path", "import_path", "import_module", "line")


@query("SELECT 'm/p' || (p_partkey + 1) || '.F' AS caller, 'm/p' || p_partkey || '.F' AS callee, 'Static' AS call_type, CAST(6 + p_size % 5 AS INTEGER) AS line FROM part")
def go_made_calls(spark, sf_dir):
    return _made_facts(spark, sf_dir).call_edges().select("caller", "callee", "call_type", "line")


@query("""WITH t AS (SELECT p_partkey + 1 AS k, CASE WHEN p_size % 5 > 0 THEN 1 ELSE 0 END AS has, p_size % 5 AS n FROM part)
SELECT 'm/p' || k || '.F' AS fn_id, kind, token, CAST(cnt AS INTEGER) AS cnt FROM t, LATERAL (VALUES ('operator', 'if', n), ('operator', '>', n), ('operator', '+=', 1), ('operator', 'return', 1), ('operator', 'call', 1), ('operand', 'a', n + 3), ('operand', '1', n)) v(kind, token, cnt) WHERE cnt > 0""")
def go_made_tokens(spark, sf_dir):
    t = _made_facts(spark, sf_dir)["halstead_tokens"]
    return t.where("token not in ('.', 'F') and token not like 'p%'").select("fn_id", "kind", "token", "cnt")


@query("SELECT 'm/p' || (p_partkey + 1) || '.F' AS \"function\", sha256(regexp_replace('{ ' || repeat('if a > 1 { ', p_size % 5) || 'a += p' || p_partkey || '.F(a) ' || repeat('} ', p_size % 5) || 'return a }', ' +', ' ', 'g')) AS body_hash FROM part")
def go_made_fingerprints(spark, sf_dir):
    return metrics.fingerprints(_made_facts(spark, sf_dir)["func_bodies"]).select("function", "body_hash")
