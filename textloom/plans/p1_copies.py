"""Problem 1: paper_results against result_mirror, marker_blocks against mineru_blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import nfc, strip
from textloom.operators.copies import Field, diff_copies
from textloom.session import table

#: Seconds by which two copies of a duration may differ and still be the same value.
TOLERANCE = 0.01


def _path(c: Column) -> Column:
    return F.when(c.startswith("D:\\"), F.concat(F.lit("/mnt/d/"), F.replace(F.substring(c, 4, 1 << 30), F.lit("\\"), F.lit("/")))).otherwise(c)


def _seconds_differ(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(F.abs(a - b) > TOLERANCE + 1e-9)


def _engine_fields(side: str) -> list[Field]:
    """Fields below an engine's struct are compared only if both structs are there."""

    def member(name: str, canon=lambda c: c, differs=lambda a, b: ~a.eqNullSafe(b), print_=lambda c: c) -> Field:
        # (struct is there, value): equal to anything while one struct is missing
        return Field(
            f"{side}.{name}",
            lambda df: F.struct(F.col(side).isNotNull().alias("there"), canon(F.col(f"{side}.{name}")).alias("value")),
            lambda a, b: a.getField("there") & b.getField("there") & differs(a.getField("value"), b.getField("value")),
            lambda c: F.struct(c.getField("there"), c.getField("value").isNull(), print_(c.getField("value"))),
        )

    blank = lambda c: F.coalesce(c, F.lit(""))
    entries = lambda c: F.coalesce(F.array_sort(F.map_entries(c)), F.array().cast("array<struct<key:string,value:int>>"))
    return [
        Field(side, lambda df: F.col(side).isNull()),
        member("ok"),
        member("elapsed_sec", differs=_seconds_differ, print_=lambda c: F.round(c, 2)),
        member("md_path", canon=_path),
        member("img_count"),
        member("error", canon=blank),
        member("error_type", canon=blank),
        member("img_breakdown", canon=entries),
    ]


RESULT_FIELDS = [Field("diff_line_count", lambda df: F.col("diff_line_count")), *_engine_fields("marker"), *_engine_fields("mineru")]
BLOCK_FIELDS = [Field("norm", lambda df: strip(nfc(F.col("norm"))))]


def result_differences(left: DataFrame, right: DataFrame, mean_chunk: int = 4) -> DataFrame:
    return diff_copies(left, right, ["result_id"], RESULT_FIELDS, version="loaded_at", mean_chunk=mean_chunk)


def block_differences(left: DataFrame, right: DataFrame, mean_chunk: int = 4) -> DataFrame:
    return diff_copies(left, right, ["stem", "block_no"], BLOCK_FIELDS, version="loaded_at", mean_chunk=mean_chunk)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found. mean_chunk is small because about a tenth of these rows differ."""
    results = result_differences(table(spark, sf_dir, "paper_results"), table(spark, sf_dir, "result_mirror"))
    blocks = block_differences(table(spark, sf_dir, "marker_blocks"), table(spark, sf_dir, "mineru_blocks"))
    return results.select(F.lit("results").alias("pair"), F.col("result_id").cast("string").alias("rec_key"), "finding").unionByName(
        blocks.select(F.lit("blocks").alias("pair"), F.concat("stem", F.lit("#"), F.col("block_no").cast("string")).alias("rec_key"), "finding")
    )


FOUND_SQL = """
WITH e AS (SELECT * FROM (VALUES ('results')) t(x)),
pr AS (SELECT * FROM paper_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1),
rm AS (SELECT * FROM result_mirror QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1),
j AS (SELECT coalesce(l.result_id, r.result_id) AS k, l.result_id AS lk, r.result_id AS rk, l.diff_line_count AS ld, r.diff_line_count AS rd,
      l.marker AS lm, r.marker AS rm, l.mineru AS ln, r.mineru AS rn FROM pr l FULL JOIN rm r ON l.result_id = r.result_id),
eng AS (SELECT k, 'marker' AS e, lm AS a, rm AS b FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL
        UNION ALL SELECT k, 'mineru', ln, rn FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL),
f AS (
 SELECT k, 'left_only' AS finding FROM j WHERE rk IS NULL
 UNION ALL SELECT k, 'right_only' FROM j WHERE lk IS NULL
 UNION ALL SELECT k, 'diff_line_count' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND ld IS DISTINCT FROM rd
 UNION ALL SELECT k, e FROM eng WHERE (a IS NULL) <> (b IS NULL)
 UNION ALL SELECT k, e || '.ok' FROM eng WHERE a IS NOT NULL AND b IS NOT NULL AND a.ok IS DISTINCT FROM b.ok
 UNION ALL SELECT k, e || '.elapsed_sec' FROM eng WHERE a IS NOT NULL AND b IS NOT NULL AND
   CASE WHEN a.elapsed_sec IS NULL OR b.elapsed_sec IS NULL THEN a.elapsed_sec IS DISTINCT FROM b.elapsed_sec ELSE abs(a.elapsed_sec - b.elapsed_sec) > 0.010000001 END
 UNION ALL SELECT k, e || '.md_path' FROM eng WHERE a IS NOT NULL AND b IS NOT NULL AND
   CASE WHEN a.md_path LIKE 'D:\\%' ESCAPE '!' THEN '/mnt/d/' || replace(substr(a.md_path, 4), '\\', '/') ELSE a.md_path END
   IS DISTINCT FROM CASE WHEN b.md_path LIKE 'D:\\%' ESCAPE '!' THEN '/mnt/d/' || replace(substr(b.md_path, 4), '\\', '/') ELSE b.md_path END
 UNION ALL SELECT k, e || '.img_count' FROM eng WHERE a IS NOT NULL AND b IS NOT NULL AND a.img_count IS DISTINCT FROM b.img_count
 UNION ALL SELECT k, e || '.error' FROM eng WHERE a IS NOT NULL AND b IS NOT NULL AND coalesce(a.error, '') <> coalesce(b.error, '')
 UNION ALL SELECT k, e || '.error_type' FROM eng WHERE a IS NOT NULL AND b IS NOT NULL AND coalesce(a.error_type, '') <> coalesce(b.error_type, '')
 UNION ALL SELECT k, e || '.img_breakdown' FROM eng WHERE a IS NOT NULL AND b IS NOT NULL AND
   coalesce(list_sort(map_entries(a.img_breakdown)), []) IS DISTINCT FROM coalesce(list_sort(map_entries(b.img_breakdown)), [])),
lb AS (SELECT DISTINCT stem, block_no, trim(nfc_normalize(norm), ' \t\n\r\u00a0\u3000') AS norm FROM marker_blocks),
rb AS (SELECT DISTINCT stem, block_no, trim(nfc_normalize(norm), ' \t\n\r\u00a0\u3000') AS norm FROM mineru_blocks),
b AS (SELECT coalesce(l.stem || '#' || l.block_no, r.stem || '#' || r.block_no) AS k,
      CASE WHEN r.stem IS NULL THEN 'left_only' WHEN l.stem IS NULL THEN 'right_only' WHEN l.norm IS DISTINCT FROM r.norm THEN 'norm' END AS finding
      FROM lb l FULL JOIN rb r ON l.stem = r.stem AND l.block_no = r.block_no)
SELECT 'results' AS pair, CAST(k AS VARCHAR) AS rec_key, finding FROM f
UNION ALL SELECT 'blocks', k, finding FROM b WHERE finding IS NOT NULL
"""
