"""Boxes, versions, slugs, lines and keys: scalar functions and small joins over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import blocks as B
from textloom.operators import merge as M
from textloom.plans.core import _LATEST, _latest_blocks, query
from textloom.session import round6, safe_div, table

_BOXES = f"(SELECT DISTINCT stem, page_idx, block_id, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM {_LATEST} WHERE bbox[3] > bbox[1] AND bbox[4] > bbox[2] AND stem IS NOT NULL AND page_idx IS NOT NULL)"


def _boxes(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "page_idx", "bbox").filter("bbox[2] > bbox[0] AND bbox[3] > bbox[1] AND stem IS NOT NULL AND page_idx IS NOT NULL")
    return d.select("stem", "page_idx", "block_id", "bbox", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"""
WITH b AS {_BOXES} SELECT i.stem, i.page_idx, i.block_id AS inner_id, o.block_id AS outer_id, round(((i.x1 - i.x0) * (i.y1 - i.y0))::DOUBLE / ((o.x1 - o.x0) * (o.y1 - o.y0)), 6) AS coverage
FROM b i JOIN b o ON i.stem = o.stem AND i.page_idx = o.page_idx AND i.block_id <> o.block_id AND o.x0 <= i.x0 AND o.y0 <= i.y0 AND o.x1 >= i.x1 AND o.y1 >= i.y1""")
def c14_contained_blocks(spark, sf_dir):
    """Blocks inside others of their page, and how much of these they cover: overlaps found in grid cells whose area is all of one box."""
    d = _boxes(spark, sf_dir)
    size = d.select("block_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("bigint").alias("size"))
    pairs = B.overlapping_boxes(d, ["stem", "page_idx"], "block_id", "bbox")
    j = pairs.join(size.select(F.col("block_id").alias("a_id"), F.col("size").alias("a")), "a_id").join(size.select(F.col("block_id").alias("b_id"), F.col("size").alias("b")), "b_id")
    one = lambda i, o, n, m: j.filter(F.col("area") == F.col(n)).select("stem", "page_idx", F.col(i).alias("inner_id"), F.col(o).alias("outer_id"), round6(safe_div(F.col(n), F.col(m))).alias("coverage"))
    return one("a_id", "b_id", "a", "b").unionByName(one("b_id", "a_id", "b", "a"))


@query(f"""
WITH b AS {_BOXES}, x AS (SELECT DISTINCT stem, page_idx, x0 AS x FROM b UNION SELECT DISTINCT stem, page_idx, x1 FROM b), s AS (SELECT stem, page_idx, x AS a, lead(x) OVER (PARTITION BY stem, page_idx ORDER BY x) AS e FROM x),
c AS (SELECT s.stem, s.page_idx, s.a, s.e, y0, y1, max(y1) OVER (PARTITION BY s.stem, s.page_idx, s.a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s JOIN b ON b.stem = s.stem AND b.page_idx = s.page_idx AND b.x0 <= s.a AND b.x1 >= s.e WHERE s.e IS NOT NULL)
SELECT stem, page_idx, CAST(sum((e - a) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) AS BIGINT) AS area FROM c GROUP BY stem, page_idx""")
def d34_union_area(spark, sf_dir):
    """Area of a page that its boxes cover together: between neighbouring edges every box adds what lies beyond the boxes before it. Windows see one strip of one page."""
    d = _boxes(spark, sf_dir)
    x = d.select("stem", "page_idx", F.explode(F.array("x0", "x1")).alias("a")).distinct()
    s = x.withColumn("e", F.lead("a").over(Window.partitionBy("stem", "page_idx").orderBy("a"))).filter("e IS NOT NULL").alias("s")
    c = s.join(d.alias("b"), F.expr("b.stem = s.stem AND b.page_idx = s.page_idx AND b.x0 <= s.a AND b.x1 >= s.e")).select("s.*", "b.y0", "b.y1")
    top = F.max("y1").over(Window.partitionBy("stem", "page_idx", "a").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    more = (F.col("e") - F.col("a")) * F.greatest(F.lit(0), F.col("y1") - F.greatest("y0", F.coalesce("top", "y0")))
    return c.withColumn("top", top).groupBy("stem", "page_idx").agg(F.sum(more).cast("bigint").alias("area"))


@query("SELECT source, v.major, v.minor, v.patch FROM (SELECT source, max(v) AS v FROM (SELECT source, unnest(list_transform(regexp_extract_all(text, '[0-9]+[.][0-9]+[.][0-9]+'), lambda x: struct_pack(major := CAST(string_split(x, '.')[1] AS INT), minor := CAST(string_split(x, '.')[2] AS INT), patch := CAST(string_split(x, '.')[3] AS INT)))) AS v FROM documents WHERE source IS NOT NULL) GROUP BY source)")
def e06_highest_version(spark, sf_dir):
    """The highest version (numeric triple) that the texts of each source name."""
    part = lambda x, i: F.element_at(F.split(x, "[.]"), i).cast("int")
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("source", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+[.][0-9]+[.][0-9]+"), 0)).alias("x"))
    return d.groupBy("source").agg(F.max(F.struct(part("x", 1).alias("major"), part("x", 2).alias("minor"), part("x", 3).alias("patch"))).alias("v")).select("source", "v.*")


@query("""
WITH s AS (SELECT p_partkey, p_name, trim(regexp_replace(lower(substr(p_name, 1, 8)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS base FROM part), n AS (SELECT base, count(*) AS k FROM s GROUP BY base)
SELECT p_partkey, CASE WHEN k > 1 THEN s.base || '-' || substr(sha256(p_name || '#' || p_partkey), 1, 8) ELSE s.base END AS slug FROM s JOIN n ON s.base = n.base""")
def g20_slugs(spark, sf_dir):
    """Slugs of names; those that several rows share get a suffix of the content's hash. Counted by slug, so a slug that very many share is pre-summed."""
    s = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.trim(F.regexp_replace(F.lower(F.substring("p_name", 1, 8)), "[^\\p{L}\\p{N}]+", "-"), F.lit("-")).alias("base"))
    n = s.groupBy("base").agg(F.count("*").alias("k"))
    suffix = F.substring(F.sha2(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")), 256), 1, 8)
    return s.join(n, "base").select("p_partkey", F.when(F.col("k") > 1, F.concat("base", F.lit("-"), suffix)).otherwise(F.col("base")).alias("slug"))


@query("""
SELECT doc_id, hit, CAST(length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) + 1 AS INT) AS line FROM (SELECT doc_id, text, 'threshold' AS hit, instr(text, 'threshold') AS pos FROM documents) WHERE pos > 0""")
def g28_first_line_of(spark, sf_dir):
    """The line of the first place that names a word."""
    d = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", F.lit("threshold"))).filter("at > 0")
    before = F.expr("substring(text, 1, at - 1)")
    return d.select("doc_id", F.lit("threshold").alias("hit"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"))


_URL = "regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')"


@query(f"""
WITH r AS (SELECT result_id, CASE WHEN result_id % 3 = 0 THEN ' https://doi.org/10.1/' || upper(stem) END AS doi, CASE WHEN result_id % 3 = 1 THEN ' ' || upper(stem) END AS arxiv_id, CASE WHEN result_id % 2 = 0 THEN 'HTTPS://www.Papers.example/' || stem || '/?v=1' END AS url, coalesce(stem, '') AS title, coalesce(corpus_id, '') AS source
  FROM (SELECT DISTINCT result_id, stem, corpus_id FROM paper_results)),
u AS (SELECT *, {_URL} AS b, coalesce(regexp_extract({_URL}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1), '') AS h FROM r)
SELECT result_id, CASE WHEN trim(coalesce(doi, '')) <> '' THEN 'doi:' || replace(lower(trim(doi)), 'https://doi.org/', '') WHEN trim(coalesce(arxiv_id, '')) <> '' THEN 'arxiv:' || lower(trim(arxiv_id))
  WHEN url IS NOT NULL AND url <> '' THEN replace(lower(h), '://www.', '://') || substr(b, length(h) + 1) ELSE 'title:' || title || '|' || source END AS key FROM u""")
def e02_dedup_keys(spark, sf_dir):
    """Keys under which results of several sources are one: DOI, else arXiv id, else normalised URL, else title and source."""
    d = table(spark, sf_dir, "paper_results").select("result_id", "stem", "corpus_id").distinct()
    r = d.select(
        "result_id", F.when(F.col("result_id") % 3 == 0, F.concat(F.lit(" https://doi.org/10.1/"), F.upper("stem"))).alias("doi"), F.when(F.col("result_id") % 3 == 1, F.concat(F.lit(" "), F.upper("stem"))).alias("arxiv_id"),
        F.when(F.col("result_id") % 2 == 0, F.concat(F.lit("HTTPS://www.Papers.example/"), F.col("stem"), F.lit("/?v=1"))).alias("url"), F.coalesce("stem", F.lit("")).alias("title"), F.coalesce("corpus_id", F.lit("")).alias("source"),
    )
    return r.select("result_id", M.dedup_key(*map(F.col, ("doi", "arxiv_id", "url", "title", "source"))).alias("key"))
