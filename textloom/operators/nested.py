"""Deeply nested JSON records as related flat tables.

Every node of a record gets a Dewey label: the ordinals of its ancestors and its own among its siblings
(``1.3.2``), with one readable step for each level (``document``, ``blocks[2]``, ``rows[0]``). Node paths are the
joined steps; a parent is the label without its last level, so parent links are a truncation in SQL and need no
join. Nodes with the same schema path (the path without positions) form one table.

The recursion over a record of unknown depth is the one part Spark has no operator for, so it runs in
an Arrow batch function, with a stack of its own; everything around it is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a reader of files may leave around JSON text besides white space.
BYTE_ORDER_MARK = "\ufeff"

_NODES = (
    ("steps", T.ArrayType(T.StringType()), pa.list_(pa.string())),
    ("label", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    ("schema_path", T.StringType(), pa.string()),
    ("kind", T.StringType(), pa.string()),
    ("fields", T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())),
)
_ROWS_A_BATCH = 20_000

_JSON = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+))', re.DOTALL)


def parse_deep(text: str) -> object:
    """json.loads for any depth: the containers are kept on a stack. ValueError for what is no JSON."""
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]  # (container, key that waits for its value)
    at, end, expect = 0, len(text.rstrip(" \t\n\r")), "value"
    while at < end:
        m = _JSON.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, scalar = m[1], m[2]
        top, key = stack[-1]
        if scalar is not None and expect in ("key", "first key"):
            if scalar[0] != '"':
                raise ValueError(f"no key at {at}")
            stack[-1], expect = (top, json.loads(scalar)), ":"
        elif sign == ":" == expect:
            expect = "value"
        elif sign == "," == expect and top is not root:
            expect = "key" if isinstance(top, dict) else "value"
        elif sign == "}" and isinstance(top, dict) and expect in (",", "first key") or sign == "]" and isinstance(top, list) and top is not root and expect in (",", "first value"):
            stack.pop()
            expect = ","
        elif expect in ("value", "first value") and (scalar is not None or sign in ("{", "[")) and not (top is root and root):
            value = json.loads(scalar) if scalar is not None else {} if sign == "{" else []
            if isinstance(top, dict):
                top[key] = value
            else:
                top.append(value)
            expect = ","
            if sign:
                stack.append((value, None))
                expect = "first key" if sign == "{" else "first value"
        else:
            raise ValueError(f"unexpected {m[0]!r} at {at}")
    if len(stack) > 1 or not root:
        raise ValueError("JSON ends early")
    return root[0]


def decode(payload: str | None) -> dict | None:
    """The JSON object of a payload, decoded again while it is a string; None if there is none.

    A byte order mark before the JSON text is no part of it. Each decoding shortens the text, so any number of them ends.
    """
    value: object = payload
    while isinstance(value, str):
        text = value.strip(BYTE_ORDER_MARK + " \t\n\r")
        try:
            value = json.loads(text)
        except RecursionError:
            try:
                value = parse_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


def _string_list(key: str) -> bool:
    return key == "list_items" or key.endswith("_caption")


def list_text(value: list, strings: bool) -> str | None:
    """A list as JSON text with null for what is a node of its own: objects, and strings unless they are wanted. None if nothing else is in it."""
    out, holds = ["["], False
    stack = [iter(value)]
    while stack:
        for x in stack[-1]:
            if out[-1] != "[":
                out.append(", ")
            if isinstance(x, list):
                out.append("[")
                stack.append(iter(x))
                break
            if x is None or isinstance(x, dict) or isinstance(x, str) and not strings:
                out.append("null")
            else:
                out.append(json.dumps(x, ensure_ascii=False))
                holds = True
        else:
            stack.pop()
            out.append("]")
    return "".join(out) if holds else None


def _fields(value: dict) -> dict[str, str]:
    out = {}
    for k, v in value.items():
        if isinstance(v, list):
            if (text := list_text(v, not _string_list(k))) is not None:
                out[k] = text
        elif v is not None and not isinstance(v, dict):
            out[k] = v if isinstance(v, str) else json.dumps(v)
    return out


def _entry(name: str, n: object) -> dict[str, str]:
    return {"name": name, "value": list_text(n, True) or "[]" if isinstance(n, list) else json.dumps(n)}


def walk(root: dict, with_fields: bool = True, with_root: bool = False) -> Iterator[tuple[list[str], list[int], str, str, dict | None]]:
    """(steps, label, schema_path, kind, fields) of all nodes below the root, in document order.

    Nodes: every object, every entry of an ``img_breakdown`` (the map itself is none), every string in
    a ``*_caption`` or ``list_items`` (a lone string has position 0). Nulls are no nodes but count as
    positions. fields: an object's own scalars and the scalars of its lists (null for what is a node) as JSON text,
    strings as they are; a string's or entry's ``value``. with_root adds the root, which has no steps.
    """
    if with_root:
        yield [], [], "$", "object", _fields(root) if with_fields else None
    # (value, step since the enclosing node, its steps, its label, its number of children so far, schema path, name of the list it is in)
    stack: list[tuple] = [(root, "", [], [], [0], "$", "")]
    while stack:
        value, step, steps, label, children, schema, within = stack.pop()
        if isinstance(value, dict):
            if value is not root:
                children[0] += 1
                steps, label, children = [*steps, step], [*label, children[0]], [0]
                yield steps, label, schema, "object", _fields(value) if with_fields else None
            later = []
            for key, child in value.items():
                if key == "img_breakdown" and isinstance(child, dict):
                    later.append((_Entries(child), key, steps, label, children, f"{schema}.{key}", key))
                elif _string_list(key) and isinstance(child, str):
                    later.append(([child], key, steps, label, children, f"{schema}.{key}", key))
                elif isinstance(child, (dict, list)):
                    later.append((child, key, steps, label, children, f"{schema}.{key}", key))
            stack.extend(reversed(later))
        elif isinstance(value, _Entries):
            later = [(n, f"{step}.{name}", steps, label, children, f"{schema}.*", name) for name, n in value.of.items() if isinstance(n, (dict, list))]
            stack.extend(reversed(later))
            for name, n in value.of.items():
                if n is not None and not isinstance(n, dict):
                    children[0] += 1
                    yield [*steps, f"{step}.{name}"], [*label, children[0]], f"{schema}.*", "entry", _entry(name, n) if with_fields else None
        elif isinstance(value, list):
            stack.extend(
                (c, f"{step}[{i}]", steps, label, children, f"{schema}[]", within) for i, c in reversed(list(enumerate(value))) if isinstance(c, (dict, list)) or isinstance(c, str) and _string_list(within)
            )
        else:  # a string of a list
            children[0] += 1
            yield [*steps, step], [*label, children[0]], schema, "string", {"value": value} if with_fields else None


class _Entries:
    """A map whose entries are nodes."""

    def __init__(self, of: dict) -> None:
        self.of = of


def node_path(steps: Column) -> Column:
    """The path of a node, ``$`` for the root."""
    return F.when(F.size(steps) > 0, F.array_join(steps, ".")).otherwise("$")


def parent_path(steps: Column, label: Column) -> Column:
    """The path of the node whose label is this one's without the last level; null for the root."""
    return F.when(F.size(label) > 0, node_path(F.slice(steps, 1, F.size(label) - 1)))


def label_nodes(records: DataFrame, key: str = "record_id", payload: str = "payload", with_fields: bool = True, with_root: bool = False) -> DataFrame:
    """One row for each distinct (key, node) of the payloads: key, node, parent, dewey, schema_path, kind, fields.

    Null, empty, cut and non-object payloads give no row. Copies of a record count once; if a key has
    several payloads, their nodes are united (that with the least hash gives label and fields). A null key is a
    key of its own. Columns other than key and payload are ignored. A payload of any depth, encoded any
    number of times, with or without a byte order mark, is read.

    Both shuffles are on fine keys, (key, payload) and (key, node), and combine map-side: neither a record
    delivered very often nor a key with very many payloads is a hot group.
    """
    source = records.select(F.col(key).alias("_key"), F.col(payload).alias("_payload")).filter("_payload is not null").groupBy("_key", "_payload").agg(F.xxhash64("_payload").alias("_h"))
    columns = _NODES if with_fields else _NODES[:-1]
    fields = [T.StructField("_key", source.schema["_key"].dataType), T.StructField("_h", T.LongType()), *(T.StructField(n, t) for n, t, _ in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: list, hashes: list, out: list[list], key_type: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, (_, _, t) in zip(out, columns)]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(hashes, pa.int64()), *arrays], names=[f.name for f in fields])

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, hashes, out = [], [], [[] for _ in columns]
            for k, text, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (root := decode(text)) is None:
                    continue
                for row in walk(root, with_fields, with_root):
                    keys.append(k)
                    hashes.append(h)
                    for column, v in zip(out, row):
                        column.append(v)
                    if len(keys) > _ROWS_A_BATCH:
                        yield made(keys, hashes, out, key_type)
                        keys, hashes, out = [], [], [[] for _ in columns]
            yield made(keys, hashes, out, key_type)

    nodes = source.mapInArrow(run, T.StructType(fields))
    rest = [n for n, _, _ in columns if n != "steps"]
    one = nodes.groupBy("_key", "steps").agg(F.min_by(F.struct(*rest), F.struct("_h", "schema_path")).alias("w"))
    steps, label = F.col("steps"), F.col("w.label")
    return one.select(
        F.col("_key").alias(key), node_path(steps).alias("node"), parent_path(steps, label).alias("parent"), F.array_join(label.cast("array<string>"), ".").alias("dewey"),
        *[F.col(f"w.{n}").alias(n) for n in rest if n != "label"],
    )


def flat_table(nodes: DataFrame, schema_path: str, columns: dict[str, str], key: str = "record_id") -> DataFrame:
    """The table of one schema path: key, node, parent and typed columns (name: Spark type; NULL where absent or not of the type)."""
    picked = [F.col("fields").getItem(c).try_cast(t).alias(c) for c, t in columns.items()]
    return nodes.filter(F.col("schema_path") == schema_path).select(key, "node", "parent", *picked)
