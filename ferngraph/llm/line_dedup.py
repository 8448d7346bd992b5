"""Line deduplication by overlapping windows of three lines.

Every window of consecutive lines is hashed; of the windows that occur several
times, over all documents, the first (by doc_id, then line) stays, and each
later one covers its lines. A document's covered positions are merged, and the
runs of lines between them are what is kept. DataFrame functions only; texts
are moved once at most, and of windows only hashes and positions. Passages
within one or two lines, and texts of so few, are outside the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import discard, small, workdir, written


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _kept(lines: Column, starts: Column, window: int) -> Column:
    """The lines that no window at these sorted starts covers."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(starts)),
        lambda j: F.slice(
            lines,
            F.when(j == 0, 0).otherwise(F.get(starts, j - 1) + window) + 1,
            F.greatest(
                F.when(j == F.size(starts), F.size(lines)).otherwise(F.get(starts, j)) - F.when(j == 0, 0).otherwise(F.get(starts, j - 1) + window),
                F.lit(0),
            ),
        ),
    )
    return F.flatten(runs)


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cleaned and two more columns, n_lines and n_removed.

    Lines end at newlines; a window of white space alone is never a repeat. A
    text of fewer lines than a window stays as it is, so do null texts (0 lines)
    and rows without doc_id. Rows of equal doc_id and text count as one
    document. A run of one repeated line keeps the first line. An empty table
    gives an empty result. Other columns stay; n_lines and n_removed replace any of
    those names.
    """
    work = workdir(docs.sparkSession, "line-dedup")
    key = F.xxhash64(text_col)
    parts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("d"), key.alias("k"), _lines(F.col(text_col)).alias("lines"))
    parts = parts.where(F.size("lines") >= window)
    whole = F.transform(F.sequence(F.lit(1), F.size("lines") - (window - 1)), lambda i: F.array_join(F.slice("lines", i, window), "\n"))
    each = parts.select("d", "k", F.posexplode(whole).alias("p", "w")).where(F.regexp_like("w", F.lit(r"\S")))
    windows = written(each.select("d", "k", "p", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(window), "w").alias("h2")), f"{work}/windows")
    place = F.struct("d", "k", "p")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    covered = later.groupBy("d", "k").agg(F.sort_array(F.collect_set("p")).alias("starts"))
    covered = written(covered, f"{work}/covered")
    discard(docs.sparkSession, f"{work}/windows")
    positions = covered.agg(F.sum(F.size("starts"))).first()[0] or 0
    # by numbers, so that no column name meets another; and in steps, since a
    # lambda would take a new column of a name for the old one
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    doc, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = rows.withColumns({"d": F.col(doc), "k": F.xxhash64(text)}).join(small(covered, positions), ["d", "k"], "left").withColumn("ls", _lines(F.col(text)))
    rows = rows.withColumn("kept", F.when(F.col("starts").isNotNull(), _kept(F.col("ls"), F.col("starts"), window)))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("ls")).cast("long")
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.size("ls") - F.size("kept")).cast("long")
    others = [(k, c) for k, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    cleaned = F.coalesce(F.array_join("kept", "\n"), text)
    return rows.select(*[(cleaned if c == text_col else F.col(f"c{k}")).alias(c) for k, c in others], n_lines.alias("n_lines"), removed.alias("n_removed"))


ORACLE = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
flat AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines),
windows AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w FROM flat WHERE i + 2 <= len(ls)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM windows WHERE regexp_matches(w, '\\S')),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM ranked WHERE r > 1),
kept AS (
  SELECT f.doc_id, string_agg(f.ls[f.i], chr(10) ORDER BY f.i) AS text, count(*) AS n
  FROM flat f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = f.doc_id AND g.i = f.i) GROUP BY f.doc_id)
SELECT l.doc_id, coalesce(k.text, '') AS text, CAST(len(l.ls) AS BIGINT) AS n_lines,
  CAST(len(l.ls) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM lines l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""
