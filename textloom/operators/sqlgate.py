"""Bounded read-only SQL over temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DEFAULT_ROWS, MAX_ROWS = 200, 1000
_COMMENTS = re.compile(r"/\*.*?\*/|--[^\n]*", re.DOTALL)
#: Kinds of plan nodes that change something or run a command, whatever their names.
_WRITES = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


def choose_limit(rows: int | None) -> int:
    return max(1, min(DEFAULT_ROWS if rows is None else rows, MAX_ROWS))


def prepare(sql: str) -> str:
    text = sql.strip().rstrip(";").strip()
    if not _COMMENTS.sub(" ", text).strip():
        raise ValueError("the SQL text is empty")
    return text


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """The first word is SELECT, WITH, VALUES or FROM, and no node of the parsed plan, at any depth, subqueries and WITH included, is a command or a statement."""
    text = _COMMENTS.sub(" ", prepare(sql)).strip()
    if not re.match(r"(?i)\(*\s*(select|with|values|from)\b", text):
        return False
    load = spark._jvm.java.lang.Class.forName
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kinds = [load(name, False, loader) for name in (*_WRITES, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")]
    stack = [spark._jsparkSession.sessionState().sqlParser().parsePlan(prepare(sql))]
    while stack:
        node = stack.pop()
        if kinds[0].isInstance(node) or kinds[1].isInstance(node):
            return False
        for below in (node.children(), node.innerChildren(), node.subqueries()):
            stack += [x for x in (below.apply(i) for i in range(below.size())) if kinds[2].isInstance(x)]
    return True


def run(spark: SparkSession, sql: str, rows: int | None = None) -> DataFrame:
    """The first rows of a query; anything that is no query is refused."""
    if not is_read_only(spark, sql):
        raise PermissionError("only queries are allowed")
    return spark.sql(prepare(sql)).limit(choose_limit(rows))
