"""The scalar functions that SQL users call by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import tables as T
from . import text as X


def _raw(s: str) -> str:
    """A string literal of SQL, by code points where quotes would end it."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_html_sql(column: str) -> str:
    """The SQL of text without tags and noise, named entities decoded; a composition of built-in functions."""
    for tag in ("script", "style", "svg", "noscript"):
        column = f"regexp_replace({column}, {_raw(rf'(?is)<{tag}\b[^>]*>.*?</{tag}>')}, '')"
    column = f"regexp_replace(regexp_replace({column}, {_raw('(?s)<!--.*?-->')}, ''), {_raw('<[^>]+>')}, '')"
    for name, char in T.NAMED_ENTITIES:
        column = f"replace({column}, {_raw(name)}, {_raw(char)})"
    column = f"regexp_replace(regexp_replace({column}, {_raw(r'[ \t]+\n')}, '\\n'), {_raw(r'\n{3,}')}, '\\n\\n')"
    return f"regexp_replace({column}, {_raw(r'(?U)^\s+|\s+\z')}, '')"


def register(spark: SparkSession) -> None:
    """``norm_text``, ``html_to_markdown`` and ``join_url`` as Arrow functions, ``strip_html`` as a temporary SQL function."""
    for name, f in (("norm_text", X.norm_text_arrow), ("html_to_markdown", X.html_to_markdown), ("join_url", X.join_url)):
        spark.udf.register(name, f)
    spark.sql(f"create or replace temporary function strip_html(t string) returns string return {strip_html_sql('t')}")
