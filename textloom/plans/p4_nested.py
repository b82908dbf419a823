"""Problem 4: the payload of meta_records as flat tables with parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.nested import flat_table, label_nodes
from textloom.session import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_nodes(table(spark, sf_dir, "meta_records"), with_fields=False).select("record_id", "node", "parent")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = label_nodes(table(spark, sf_dir, "meta_records"))
    return flat_table(nodes, "$.document.blocks[]", {"type": "string", "page_idx": "int", "text": "string", "text_level": "int", "img_path": "string", "sub_type": "string"})


def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = label_nodes(table(spark, sf_dir, "meta_records"))
    columns = {"engine": "string", "ok": "boolean", "elapsed_sec": "double", "md_path": "string", "img_count": "int", "error": "string", "error_type": "string"}
    return flat_table(nodes, "$.marker", columns).unionByName(flat_table(nodes, "$.mineru", columns))


def precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = label_nodes(table(spark, sf_dir, "meta_records"))
    columns = {"ok": "boolean", "status": "string", "reason": "string", "detail": "string", "page_count": "int", "pdf_hash": "string", "pdf_sha256": "string", "scan_warning": "boolean"}
    return flat_table(nodes, "$.precheck", columns)


def img_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of both engines; parent tells the engine."""
    nodes = label_nodes(table(spark, sf_dir, "meta_records"))
    columns = {"name": "string", "value": "int"}
    return flat_table(nodes, "$.marker.img_breakdown.*", columns).unionByName(flat_table(nodes, "$.mineru.img_breakdown.*", columns))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of all ``*_caption`` lists of the blocks, with the list they are in."""
    nodes = label_nodes(table(spark, sf_dir, "meta_records")).filter("kind = 'string' AND schema_path LIKE '$.document.blocks[].%_caption[]'")
    return nodes.select("record_id", "node", "parent", F.regexp_extract("schema_path", "([^.]+)\\[\\]$", 1).alias("caption_of"), F.col("fields")["value"].alias("text"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists at every depth, strings and objects alike; parent is the block or the item that holds the list."""
    nodes = label_nodes(table(spark, sf_dir, "meta_records")).filter(F.col("schema_path").startswith("$.document.blocks[]") & F.col("schema_path").endswith(".list_items[]"))
    depth = F.regexp_count("schema_path", F.lit("list_items"))
    return nodes.select("record_id", "node", "parent", depth.alias("depth"), (F.col("kind") == "object").alias("nested"), F.coalesce(F.col("fields")["value"], F.col("fields")["text"]).alias("text"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(label_nodes(table(spark, sf_dir, "meta_records")), "$.document.blocks[].rows[]", {})


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(label_nodes(table(spark, sf_dir, "meta_records")), "$.document.blocks[].rows[].cells[]", CELL_COLUMNS)


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(label_nodes(table(spark, sf_dir, "meta_records")), "$.precheck.warnings[]", WARNING_COLUMNS)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of all schema paths as one: a row for each field of each node, and of the root (``$``); field and value are null for a node without fields.

    Values are as in the payload, other than strings as JSON text. The table of a schema path is its rows.
    """
    every = label_nodes(table(spark, sf_dir, "meta_records"), with_root=True)
    return every.select("record_id", "node", "parent", "dewey", "schema_path", "kind", F.explode_outer("fields").alias("field", "value"))


def schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the records split into: rows, records and deepest nesting (levels of nodes) of each schema path."""
    nodes = label_nodes(table(spark, sf_dir, "meta_records"), with_fields=False)
    return nodes.groupBy("schema_path", "kind").agg(
        F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"), F.max(F.size(F.split("dewey", "\\."))).cast("bigint").alias("depth")
    )


CELL_COLUMNS = {"text": "string", "colspan": "int"}
WARNING_COLUMNS = {"code": "string", "pages": "string"}

#: Records decoded once or twice, with or without a byte order mark; json_tree gives every value with its full key.
_NODES_SQL = """
WITH raw AS (SELECT DISTINCT record_id, ltrim(payload, chr(65279)) AS payload FROM meta_records WHERE payload IS NOT NULL),
src AS (SELECT record_id, payload FROM raw WHERE json_valid(payload)),
dec AS (SELECT DISTINCT record_id, CASE WHEN json_type(payload) = 'VARCHAR' THEN ltrim(payload::JSON->>'$', chr(65279)) ELSE payload END AS p FROM src),
ok AS (SELECT record_id, p::JSON AS p FROM dec WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
"""
BLOCKS_SQL = (
    _NODES_SQL
    + """
b AS (SELECT record_id, (unnest(range(json_array_length(p, '$.document.blocks')::INT))) AS i, p FROM ok WHERE json_type(p, '$.document.blocks') = 'ARRAY'),
x AS (SELECT DISTINCT record_id, i, json_extract(p, '$.document.blocks[' || i || ']') AS v FROM b)
SELECT record_id, 'document.blocks[' || i || ']' AS node, 'document' AS parent, v->>'$.type' AS type, TRY_CAST(v->>'$.page_idx' AS INT) AS page_idx,
       CASE WHEN json_type(v, '$.text') = 'VARCHAR' THEN v->>'$.text' END AS text, TRY_CAST(v->>'$.text_level' AS INT) AS text_level, v->>'$.img_path' AS img_path, v->>'$.sub_type' AS sub_type
FROM x WHERE json_type(v) = 'OBJECT'
"""
)
ENGINES_SQL = (
    _NODES_SQL
    + """
x AS (SELECT DISTINCT record_id, 'marker' AS node, p->'$.marker' AS v FROM ok UNION ALL SELECT DISTINCT record_id, 'mineru', p->'$.mineru' FROM ok)
SELECT record_id, node, '$' AS parent, v->>'$.engine' AS engine, TRY_CAST(v->>'$.ok' AS BOOLEAN) AS ok, TRY_CAST(v->>'$.elapsed_sec' AS DOUBLE) AS elapsed_sec,
       v->>'$.md_path' AS md_path, TRY_CAST(v->>'$.img_count' AS INT) AS img_count, v->>'$.error' AS error, v->>'$.error_type' AS error_type
FROM x WHERE json_type(v) = 'OBJECT'
"""
)
PRECHECK_SQL = (
    _NODES_SQL
    + """
x AS (SELECT DISTINCT record_id, p->'$.precheck' AS v FROM ok)
SELECT record_id, 'precheck' AS node, '$' AS parent, TRY_CAST(v->>'$.ok' AS BOOLEAN) AS ok, v->>'$.status' AS status, v->>'$.reason' AS reason, v->>'$.detail' AS detail,
       TRY_CAST(v->>'$.page_count' AS INT) AS page_count, v->>'$.pdf_hash' AS pdf_hash, v->>'$.pdf_sha256' AS pdf_sha256, TRY_CAST(v->>'$.scan_warning' AS BOOLEAN) AS scan_warning
FROM x WHERE json_type(v) = 'OBJECT'
"""
)
IMG_BREAKDOWN_SQL = (
    _NODES_SQL
    + """
e AS (SELECT DISTINCT record_id, 'marker' AS parent, p->'$.marker.img_breakdown' AS v FROM ok UNION ALL SELECT DISTINCT record_id, 'mineru', p->'$.mineru.img_breakdown' FROM ok),
k AS (SELECT record_id, parent, v, unnest(json_keys(v)) AS name FROM e WHERE json_type(v) = 'OBJECT'),
x AS (SELECT record_id, parent, name, json_extract_string(v, '$."' || name || '"') AS value FROM k)
SELECT record_id, parent || '.img_breakdown.' || name AS node, parent, name, TRY_CAST(value AS INT) AS value FROM x WHERE value IS NOT NULL
"""
)

_TREE_SQL = (
    _NODES_SQL
    + """
t AS (SELECT record_id, j.fullkey AS fk, j.path, j.key, j.type, j.value FROM ok, json_tree(ok.p) AS j WHERE j.fullkey <> '$'),
n AS (
 SELECT record_id, substr(fk, 3) AS node, 'object' AS kind, value FROM t WHERE type = 'OBJECT' AND coalesce(key, '') <> 'img_breakdown' AND NOT ends_with(path, '.img_breakdown')
 UNION ALL SELECT record_id, substr(fk, 3), 'entry', value FROM t WHERE ends_with(path, '.img_breakdown') AND type <> 'NULL'
 UNION ALL SELECT record_id, substr(fk, 3), 'string', value FROM t WHERE type = 'VARCHAR' AND ends_with(fk, ']') AND regexp_matches(path, '(_caption|[.]list_items)$')
 UNION ALL SELECT record_id, substr(fk, 3) || '[0]', 'string', value FROM t WHERE type = 'VARCHAR' AND NOT ends_with(fk, ']') AND regexp_matches(fk, '(_caption|[.]list_items)$')),
node AS (SELECT DISTINCT record_id, node, kind, coalesce(nullif(regexp_replace(regexp_replace(node, '(^|[.])[^.]*$', ''), '(^|[.])img_breakdown$', ''), ''), '$') AS parent,
  '$.' || regexp_replace(regexp_replace(node, '\\[[0-9]+\\]', '[]', 'g'), 'img_breakdown[.].*$', 'img_breakdown.*') AS schema_path, value FROM n)
"""
)
FOUND_SQL = _TREE_SQL + "SELECT record_id, node, parent FROM node"
SCHEMA_TABLES_SQL = (
    _TREE_SQL
    + """SELECT schema_path, kind, count(*) AS n_rows, count(DISTINCT record_id) AS n_records, CAST(max(len(string_split(replace(node, '.img_breakdown', ''), '.'))) AS BIGINT) AS depth
FROM node GROUP BY schema_path, kind"""
)
CAPTIONS_SQL = (
    _TREE_SQL
    + """SELECT record_id, node, parent, regexp_extract(schema_path, '([^.]+)\\[\\]$', 1) AS caption_of, value->>'$' AS text
FROM node WHERE kind = 'string' AND regexp_matches(schema_path, '^[$].document.blocks\\[\\][.].*_caption\\[\\]$')"""
)
LIST_ITEMS_SQL = (
    _TREE_SQL
    + """SELECT record_id, node, parent, CAST(len(regexp_extract_all(schema_path, 'list_items')) AS INT) AS depth, kind = 'object' AS nested, CASE WHEN kind = 'object' THEN value->>'$.text' ELSE value->>'$' END AS text
FROM node WHERE starts_with(schema_path, '$.document.blocks[]') AND ends_with(schema_path, '.list_items[]')"""
)
ROWS_SQL = _TREE_SQL + "SELECT record_id, node, parent FROM node WHERE schema_path = '$.document.blocks[].rows[]'"
CELLS_SQL = _TREE_SQL + "SELECT record_id, node, parent, value->>'$.text' AS text, TRY_CAST(value->>'$.colspan' AS INT) AS colspan FROM node WHERE schema_path = '$.document.blocks[].rows[].cells[]'"
WARNINGS_SQL = (
    _TREE_SQL
    + """SELECT record_id, node, parent, value->>'$.code' AS code, CASE WHEN len(list_filter(CAST(value->'$.pages' AS INT[]), lambda x: x IS NOT NULL)) > 0
  THEN '[' || array_to_string(list_transform(CAST(value->'$.pages' AS INT[]), lambda x: coalesce(CAST(x AS VARCHAR), 'null')), ', ') || ']' END AS pages FROM node WHERE schema_path = '$.precheck.warnings[]'"""
)
QUERIES = {
    "p4_found": found, "p4_blocks": blocks, "p4_engines": engines, "p4_precheck": precheck, "p4_img_breakdown": img_breakdown, "p4_captions": captions, "p4_list_items": list_items,
    "p4_rows": rows, "p4_cells": cells, "p4_warnings": warnings, "p4_nodes": nodes, "p4_schema_tables": schema_tables,
}
ORACLE_SQL = {
    "p4_found": FOUND_SQL, "p4_blocks": BLOCKS_SQL, "p4_engines": ENGINES_SQL, "p4_precheck": PRECHECK_SQL, "p4_img_breakdown": IMG_BREAKDOWN_SQL, "p4_captions": CAPTIONS_SQL,
    "p4_list_items": LIST_ITEMS_SQL, "p4_rows": ROWS_SQL, "p4_cells": CELLS_SQL, "p4_warnings": WARNINGS_SQL, "p4_schema_tables": SCHEMA_TABLES_SQL,
}
