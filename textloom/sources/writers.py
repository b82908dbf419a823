"""Sinks: canonical JSON, sorted JSON lines, TSV sheets, Markdown tables and plain YAML of results.

The line formats are written by Spark, distributed. Markdown and YAML are reports for people: they take a bounded number
of rows and refuse more.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a report for people may have.
MOST_REPORT_ROWS = 10_000


def _canonical(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.round(value, 6))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_canonical(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda _, x: _canonical(x, kind.valueType)))))
    return value


def canonical_json(df: DataFrame) -> Column:
    """Each row as one JSON object: keys sorted at every depth, floats of six digits, NaN and infinities null, nulls kept."""
    return F.to_json(_canonical(F.struct(*[F.col(f"`{c}`") for c in df.columns]), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """Canonical JSON lines, in key order over the files (a range shuffle, no single task)."""
    df.orderBy(*by).select(canonical_json(df).alias("value")).write.mode(mode).text(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated with a header; tabs and line ends in strings become spaces, nulls empty fields."""
    flat = [F.regexp_replace(F.col(f"`{f.name}`"), "[\\t\\r\\n]+", " ").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_REPORT_ROWS + 1).collect()
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError(f"a report has at most {MOST_REPORT_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value:.6f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame) -> str:
    """A pipe table; pipes are escaped, line ends become spaces, floats have six digits at most."""
    cell = lambda v: re.sub(r"\s*[\r\n]+\s*", " ", _text(v)).replace("|", "\\|")
    lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in _rows(df)]) + "\n"


def _yaml(value: object, indent: int) -> str:
    pad = "  " * indent
    if isinstance(value, dict) and value:
        return "".join(f"\n{pad}{json.dumps(str(k), ensure_ascii=False)}:{_yaml(v, indent + 1)}" for k, v in sorted(value.items()))
    if isinstance(value, list) and value:
        return "".join(f"\n{pad}-{_yaml(v, indent + 1)}" for v in value)
    if isinstance(value, float):
        value = None if value != value or value in (float("inf"), float("-inf")) else round(value, 6)
    return " " + json.dumps(value, ensure_ascii=False, default=str)


def yaml_document(df: DataFrame) -> str:
    """The rows as a YAML list: keys sorted, strings quoted, the same bytes for the same rows."""
    return _yaml(_rows(df), 0).lstrip() + "\n"


def query_result_json(df: DataFrame, sql: str, limit: int) -> str:
    """``{"meta": ..., "data": [...]}`` of a bounded query: columns, number of rows, whether the limit cut it."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    meta = {"columns": df.columns, "limit": limit, "row_count": min(len(rows), limit), "sql": sql, "truncated": len(rows) > limit}
    return json.dumps({"data": rows[:limit], "meta": meta}, ensure_ascii=False, sort_keys=True, default=str)
