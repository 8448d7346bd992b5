"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def anchor(file: Column | str, line: Column | str, symbol: Column | str) -> Column:
    """`[Context Anchor] file:line symbol`; empty without a file or a line."""
    file, line, symbol = col(file), col(line), col(symbol)
    text = F.concat(F.lit("[Context Anchor] "), file, F.lit(":"), line.cast("string"), F.lit(" "), symbol)
    return F.when((F.coalesce(file, F.lit("")) == "") | (F.coalesce(line, F.lit(0)) <= 0), "").otherwise(text)


def short_function_name(c: Column | str) -> Column:
    """What follows the last dot; the whole name if the dot ends it."""
    c = col(c)
    return F.when(c.endswith("."), c).otherwise(F.substring_index(c, ".", -1))


def short_type_name(c: Column | str) -> Column:
    """A type's name without parentheses, pointer marks and package."""
    return F.substring_index(F.regexp_replace(col(c), r"[()*]", ""), ".", -1)


def collapse_spaces(c: Column | str) -> Column:
    """Runs of space, tab and line ends as one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), "[ \t\n\r]+", " "))


def receiver_name(c: Column | str) -> Column:
    """A receiver type without pointer mark and type parameters."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^\*+", ""), r"\[.*$", "")


def is_stdlib(path: Column | str) -> Column:
    """Whether a package path's first segment has no dot."""
    return ~F.substring_index(col(path), "/", 1).contains(".")


def is_exported(name: Column | str, receiver: Column | str | None = None) -> Column:
    """Whether a name starts with A-Z, and so does the receiver type, if there is one."""
    good = col(name).rlike("^[A-Z]")
    if receiver is None:
        return good
    own = F.substring_index(receiver_name(receiver), ".", -1)
    return good & ((F.coalesce(col(receiver), F.lit("")) == "") | own.rlike("^[A-Z]"))


def dot_identifier(c: Column | str) -> Column:
    """Letters, digits and underscores alone; an underscore before a digit that
    starts the text."""
    return F.regexp_replace(F.regexp_replace(col(c), "^([0-9])", "_$1"), "[^A-Za-z0-9_]", "")


def mermaid_label(c: Column | str) -> Column:
    return F.translate(col(c), '|"\n', "/' ")


def round2(c: Column) -> Column:
    """Two decimals, half away from zero on the hundredfold."""
    return F.round(c * 100) / 100


def path_matches(path: Column | str, rule: Column | str) -> Column:
    """A rule's package pattern: the path itself or, with a trailing slash,
    that package and all below it."""
    path, rule = col(path), col(rule)
    return (path == rule) | (rule.endswith("/") & ((F.concat(path, F.lit("/")) == rule) | path.startswith(rule)))
