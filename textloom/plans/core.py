"""Queries over the analytics operators, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lexical as L
from textloom.operators import blocks as B
from textloom.operators import merge as M
from textloom.operators import sqlgate, stats
from textloom.session import round6, safe_div, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


_IN = lambda name: "(" + ", ".join(f"'{w}'" for w in L.LEXICON[name]) + ")"
_TOK = "list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*'), lambda x: lower(x))"
_HIT = lambda g: f"len(list_filter(tok, lambda x: x IN {_IN(g)}))"
_LATEST = "(SELECT DISTINCT ON (block_id) * FROM content_blocks ORDER BY block_id, ingested_at DESC)"


def _latest_blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return B.latest_rows(table(spark, sf_dir, "content_blocks").select("block_id", "ingested_at", *columns), "block_id", "ingested_at")


# ---- blocks and sections


@query(f"""
SELECT stem, block_index, block_id, last_value(CASE WHEN kind = 'prose' AND text_level = 2 THEN text_plain END IGNORE NULLS)
  OVER (PARTITION BY stem ORDER BY block_index NULLS FIRST, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_label
FROM {_LATEST}""")
def b05_section_forward_fill(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "block_index", "kind", "text_level", "text_plain").withColumn("h", F.when((F.col("kind") == "prose") & (F.col("text_level") == 2), F.col("text_plain")))
    return B.forward_fill(d, "stem", "block_index", "h", "section_label", "block_id").select("stem", "block_index", "block_id", "section_label")


@query(f"""
SELECT stem, kind, count(*) AS n_blocks, CAST(coalesce(sum(length(text_plain)), 0) AS BIGINT) AS chars, count(caption) AS captions,
  CAST(coalesce(sum(caption_digits), 0) AS BIGINT) AS caption_digits FROM {_LATEST} GROUP BY stem, kind""")
def d04_stream_census(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "text_plain", "caption", "caption_digits")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return d.groupBy("stem", "kind").agg(F.count("*").alias("n_blocks"), zero(F.length("text_plain")).alias("chars"), F.count("caption").alias("captions"), zero("caption_digits").alias("caption_digits"))


_REASON = """CASE WHEN kind <> 'prose' THEN 'not_prose' WHEN text_level IS NOT NULL THEN 'heading' WHEN text_plain IS NULL OR trim(text_plain) = '' THEN 'empty'
  WHEN section IS NULL THEN 'no_section' WHEN section IN ('references','appendix','acknowledgments','keywords','front_matter') THEN section ELSE 'kept' END"""


@query(f"SELECT {_REASON} AS reason, count(*) AS n_blocks, CAST(coalesce(sum(length(text_plain)), 0) AS BIGINT) AS chars FROM {_LATEST} GROUP BY 1")
def b06_body_projection_ledger(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "kind", "text_level", "text_plain", "section").withColumn("reason", F.expr(_REASON))
    return d.groupBy("reason").agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum(F.length("text_plain")), F.lit(0)).cast("bigint").alias("chars"))


@query(f"""
SELECT stem, count(*) AS n_headings, CAST(max(block_index) - min(block_index) AS INT) AS spread, CAST(max(gap) AS INT) AS longest_section FROM (
  SELECT stem, block_index, lead(block_index) OVER (PARTITION BY stem ORDER BY block_index, block_id) - block_index AS gap
  FROM {_LATEST} WHERE kind = 'prose' AND text_level IS NOT NULL) GROUP BY stem""")
def w02_section_ends(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "block_index", "kind", "text_level").filter("kind = 'prose' AND text_level IS NOT NULL")
    gap = F.lead("block_index").over(Window.partitionBy("stem").orderBy("block_index", "block_id")) - F.col("block_index")
    return d.withColumn("gap", gap).groupBy("stem").agg(
        F.count("*").alias("n_headings"), (F.max("block_index") - F.min("block_index")).cast("int").alias("spread"), F.max("gap").cast("int").alias("longest_section")
    )


@query(f"""
SELECT stem, count(*) AS n_floats, count(CASE WHEN trim(coalesce(caption, '')) <> '' THEN 1 END) AS captioned,
  round(count(CASE WHEN trim(coalesce(caption, '')) <> '' THEN 1 END)::DOUBLE / count(*), 6) AS coverage FROM {_LATEST} WHERE kind IN ('figures', 'tables') GROUP BY stem""")
def s_cap_01_caption_coverage(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "caption").filter(F.col("kind").isin("figures", "tables"))
    captioned = F.count(F.when(F.trim(F.coalesce("caption", F.lit(""))) != "", 1))
    return d.groupBy("stem").agg(F.count("*").alias("n_floats"), captioned.alias("captioned")).withColumn("coverage", L.share(F.col("captioned"), F.col("n_floats")))


_CELLS = "list_transform(regexp_extract_all(table_body, '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g')))"
_NUM = "regexp_matches(regexp_replace(translate(c, '０１２３４５６７８９', '0123456789'), '[,\\s]', '', 'g'), '^[-+±~]?[0-9]+([.][0-9]+)?([-~–][0-9]+([.][0-9]+)?)?[A-Za-z%]{0,6}$')"


@query(f"""
SELECT stem, count(*) AS n_tables, CAST(sum(len(cells)) AS BIGINT) AS n_cells, CAST(sum(len(list_filter(cells, lambda c: c = ''))) AS BIGINT) AS empty_cells,
  CAST(sum(len(list_filter(cells, lambda c: {_NUM}))) AS BIGINT) AS numeric_cells,
  round(sum(len(list_filter(cells, lambda c: {_NUM})))::DOUBLE / nullif(sum(len(cells)), 0), 6) AS numeric_share
FROM (SELECT stem, {_CELLS} AS cells FROM {_LATEST} WHERE kind = 'tables' AND table_body IS NOT NULL) GROUP BY stem""")
def s_tbl_11_numeric_cells(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "table_body").filter("kind = 'tables' AND table_body IS NOT NULL").withColumn("cells", B.table_cells(F.col("table_body")))
    total = lambda c: F.sum(F.size(c)).cast("bigint")
    out = d.groupBy("stem").agg(
        F.count("*").alias("n_tables"), total("cells").alias("n_cells"), total(F.filter("cells", lambda c: c == "")).alias("empty_cells"), total(F.filter("cells", B.numeric_cell)).alias("numeric_cells")
    )
    return out.withColumn("numeric_share", L.share(F.col("numeric_cells"), F.col("n_cells")))


@query(f"""
WITH b AS (SELECT DISTINCT stem, page_idx, block_id, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM {_LATEST} WHERE bbox[3] > bbox[1] AND bbox[4] > bbox[2])
SELECT a.stem, a.page_idx, a.block_id AS a_id, b.block_id AS b_id,
  CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS BIGINT) AS area
FROM b a JOIN b ON a.stem = b.stem AND a.page_idx = b.page_idx AND a.block_id < b.block_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def c12_overlapping_blocks(spark, sf_dir):
    return B.overlapping_boxes(_latest_blocks(spark, sf_dir, "stem", "page_idx", "bbox"), ["stem", "page_idx"], "block_id", "bbox")


@query(f"""
WITH n AS (SELECT DISTINCT stem, TRY_CAST(regexp_extract(caption, '[0-9]+') AS INT) AS k FROM {_LATEST} WHERE kind = 'figures' AND regexp_matches(caption, '[0-9]')),
m AS (SELECT stem, max(k) AS top, count(*) AS declared FROM n WHERE k BETWEEN 1 AND 999 GROUP BY stem)
SELECT stem, CAST(top AS INT) AS top, declared, CAST(top - declared AS BIGINT) AS missing FROM m""")
def w12_missing_numbers(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "caption").filter("kind = 'figures' AND caption rlike '[0-9]'")
    n = d.select("stem", F.regexp_extract("caption", "[0-9]+", 0).try_cast("int").alias("k")).filter("k between 1 and 999").distinct()
    return n.groupBy("stem").agg(F.max("k").alias("top"), F.count("*").alias("declared")).withColumn("missing", F.col("top") - F.col("declared"))


@query(f"""
WITH d AS (SELECT DISTINCT stem, page_idx AS v FROM {_LATEST} WHERE page_idx IS NOT NULL), r AS (SELECT stem, v, v - row_number() OVER (PARTITION BY stem ORDER BY v) AS g FROM d),
i AS (SELECT stem, min(v) AS first, max(v) AS last, count(*) AS size FROM r GROUP BY stem, g)
SELECT stem, first, last, size, CAST(first - lag(last) OVER (PARTITION BY stem ORDER BY first) - 1 AS INT) AS gap_before FROM i""")
def w05_page_islands(spark, sf_dir):
    return M.islands(_latest_blocks(spark, sf_dir, "stem", "page_idx"), ["stem"], "page_idx")


# ---- prose metrics


@query(f"""
WITH t AS (SELECT doc_id, text, {_TOK} AS tok FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(tok) AS n_tokens, {_HIT('hedge')} AS hedges, {_HIT('booster')} AS boosters, {_HIT('causal')} AS causal, {_HIT('contrast')} AS contrast, {_HIT('additive')} AS additive, {_HIT('academic')} AS academic,
  round({_HIT('hedge')}::DOUBLE / nullif(len(tok), 0), 6) AS m_hed_14, round({_HIT('booster')}::DOUBLE / nullif(len(tok), 0), 6) AS m_boo_15, round({_HIT('academic')}::DOUBLE / nullif(len(tok), 0), 6) AS m_awr_03,
  round({_HIT('causal')} * 1000.0::DOUBLE / nullif(len(tok), 0), 6) + round({_HIT('contrast')} * 1000.0::DOUBLE / nullif(len(tok), 0), 6) + round({_HIT('additive')} * 1000.0::DOUBLE / nullif(len(tok), 0), 6) AS m_conn_30,
  round({_HIT('present')}::DOUBLE / nullif({_HIT('present')} + {_HIT('past')}, 0), 6) AS m_tense_28 FROM t""")
def m_prose_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", L.tokens(F.col("text")).alias("tok"))
    d = d.select("doc_id", F.size("tok").alias("n_tokens"), L.of_lexicon(F.col("tok")).alias("tok"))
    t = F.col("tok")
    d = d.select("doc_id", "n_tokens", *[L.hits(t, g).alias(a) for g, a in (("hedge", "hedges"), ("booster", "boosters"), ("causal", "causal"), ("contrast", "contrast"), ("additive", "additive"), ("academic", "academic"), ("present", "p"), ("past", "q"))])
    c = F.col
    connectors = sum((L.share(c(g), c("n_tokens"), 1000.0) for g in ("contrast", "additive")), L.share(c("causal"), c("n_tokens"), 1000.0))
    return d.withColumns(
        {"m_hed_14": L.share(c("hedges"), c("n_tokens")), "m_boo_15": L.share(c("boosters"), c("n_tokens")), "m_awr_03": L.share(c("academic"), c("n_tokens")), "m_conn_30": connectors, "m_tense_28": L.share(c("p"), c("p") + c("q"))}
    ).drop("p", "q")


_LANG = """CASE WHEN cjk > 0.1 * (cjk + words) THEN 'zh' WHEN words > 0 THEN 'en' ELSE 'unknown' END"""


@query(f"""
WITH c AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*')) AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(cjk AS INT) AS cjk, CAST(words AS INT) AS words, CAST(cjk + words AS INT) AS units, {_LANG} AS detected, lang IS NULL OR lower(lang[1:2]) <> {_LANG} AS differs FROM c""")
def b28_language_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    d = d.select("doc_id", "lang", F.regexp_count("text", F.lit(L.CJK)).alias("cjk"), F.regexp_count("text", F.lit(L.TOKEN)).alias("words"), L.cjk_units(F.col("text")).alias("units"), L.detect_language(F.col("text")).alias("detected"))
    return d.withColumn("differs", F.col("lang").isNull() | (F.lower(F.substring("lang", 1, 2)) != F.col("detected"))).drop("lang")


@query(None)
def m_mtld_02(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", L.mtld(L.tokens(F.col("text"))).alias("mtld"))


@query("""
WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+'))) AS run, doc_id FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, substr(run, i, k) AS gram FROM (SELECT doc_id, run, unnest(range(1, length(run) + 1)) AS i FROM w), (VALUES (2), (3), (4)) v(k) WHERE i + k - 1 <= length(run))
SELECT gram, count(*) AS n FROM g WHERE substr(gram, 1, 1) NOT IN ('的','了','是') AND substr(gram, length(gram), 1) NOT IN ('的','了','是') GROUP BY gram HAVING count(*) >= 5 ORDER BY n DESC, gram LIMIT 100""")
def d16_ngram_mining(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[\\x{4e00}-\\x{9fff}]+"), 0))).alias("run"))
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i")).select("run", "i", F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("k")).filter("i + k - 1 <= length(run)")
    stop = ["的", "了", "是"]
    grams = at.select(F.expr("substring(run, i, k)").alias("gram")).filter(~F.substring("gram", 1, 1).isin(stop) & ~F.expr("substring(gram, -1, 1)").isin(stop))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n >= 5").orderBy(F.desc("n"), "gram").limit(100)


# ---- corpus statistics


@query("""
WITH s AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL),
q AS (SELECT lang, n, max(CASE WHEN r = CAST(round_even(0.75 * (n - 1), 0) AS BIGINT) THEN v END) AS nearest, max(CASE WHEN r = greatest(CAST(ceil(0.75 * n) AS BIGINT), 1) - 1 THEN v END) AS ceil_rank,
  max(CASE WHEN r = n // 2 THEN v END) AS upper_median FROM s GROUP BY lang, n)
SELECT q.lang, q.n, q.nearest::DOUBLE AS nearest, round(c.linear, 6) AS linear, q.ceil_rank::DOUBLE AS ceil_rank, q.upper_median::DOUBLE AS upper_median, round(c.med, 6) AS true_median
FROM q JOIN (SELECT lang, quantile_cont(n_chars, 0.75)::DOUBLE AS linear, median(n_chars)::DOUBLE AS med FROM documents WHERE n_chars IS NOT NULL GROUP BY lang) c ON q.lang = c.lang""")
def d05_five_quantiles(spark, sf_dir):
    return stats.order_statistics(table(spark, sf_dir, "documents").filter("lang IS NOT NULL"), ["lang"], "n_chars")


@query("""
SELECT c_mktsegment, count(c_acctbal) AS n_valid, count(*) - count(c_acctbal) AS n_missing, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max,
  round(avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 6) AS ci_low, round(avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 6) AS ci_high, '' AS warnings
FROM customer GROUP BY c_mktsegment""")
def d01_describe(spark, sf_dir):
    return stats.describe(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")


@query("""
WITH p AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT l_returnflag, x, y, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2.0 AS ry FROM p)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY l_returnflag""")
def d08_correlations(spark, sf_dir):
    return stats.correlations(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


_Z = stats.Z95


@query(f"""
WITH a AS (SELECT event_type, count(*) AS trials, count(CASE WHEN value > 50 THEN 1 END) AS hits FROM events GROUP BY event_type), p AS (SELECT *, hits::DOUBLE / trials AS p, trials::DOUBLE AS n, {_Z} * {_Z} AS z2 FROM a)
SELECT event_type, trials, hits, round(greatest(0, (p + z2 / (2 * n)) / (1 + z2 / n) - sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * {_Z} / (1 + z2 / n)), 6) AS low,
  round(least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * {_Z} / (1 + z2 / n)), 6) AS high FROM p""")
def d10_wilson_interval(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("trials"), F.count(F.when(F.col("value") > 50, 1)).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("trials"))
    return a.select("event_type", "trials", "hits", low.alias("low"), high.alias("high"))


@query("""
WITH p AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS b FROM orders), n AS (SELECT count(*) AS t, count(CASE WHEN a = b THEN 1 END) AS s FROM p WHERE a IS NOT NULL),
c AS (SELECT coalesce(sum(x.na * y.nb), 0)::DOUBLE AS bt FROM (SELECT a, count(*) AS na FROM p GROUP BY a) x JOIN (SELECT b, count(*) AS nb FROM p WHERE a IS NOT NULL GROUP BY b) y ON x.a = y.b)
SELECT t AS n, round(s::DOUBLE / t, 6) AS po, round(bt / (t::DOUBLE * t), 6) AS pe, round((s::DOUBLE / t - bt / (t::DOUBLE * t)) / (1 - bt / (t::DOUBLE * t)), 6) AS kappa FROM n, c""")
def d11_cohen_kappa(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O").alias("b"))
    return stats.kappa(d, "a", "b")


_CLASS = """CASE WHEN v IS NULL OR trim(v) = '' THEN 'empty' WHEN regexp_matches(trim(v), '^#(N/A|REF!|VALUE!|DIV/0!|NAME\\?|NULL!|NUM!)$') THEN 'error' WHEN regexp_matches(trim(v), '^(0[0-9]+|[0-9]{11,})$') THEN 'string_id'
  WHEN regexp_matches(trim(v), '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$') THEN 'date' WHEN regexp_matches(trim(v), '^[-+]?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?%?$') THEN 'number'
  WHEN lower(trim(v)) IN ('true','false','yes','no') THEN 'bool' ELSE 'string' END"""


@query(f"""
WITH c AS (SELECT 'c_name' AS col, c_name AS v FROM customer UNION ALL SELECT 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT col, {_CLASS} AS type, count(*) AS n, min(v) AS example FROM c GROUP BY col, {_CLASS}""")
def d17_column_profile(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr("stack(4, 'c_name', c_name, 'c_custkey', cast(c_custkey as string), 'c_mktsegment', c_mktsegment, 'c_nationkey', cast(c_nationkey as string)) AS (col, v)")
    return d.groupBy("col", L.classify_cell(F.col("v")).alias("type")).agg(F.count("*").alias("n"), F.min("v").alias("example"))


@query("""
WITH r AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k, count(*) OVER () AS n FROM nation)
SELECT n_name FROM r WHERE k % greatest(1, n // 6) = 0 AND k // greatest(1, n // 6) < 6""")
def w10_systematic_sample(spark, sf_dir):
    """Every (n div 6)-th row: the feature is the sample. The table is one of settings, with a fixed number of rows."""
    d = table(spark, sf_dir, "nation")
    n = d.count()
    stride = max(1, n // 6)
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_nationkey")) - 1
    return d.withColumn("k", k).filter((F.col("k") % stride == 0) & (F.floor(F.col("k") / stride) < 6)).select("n_name")


# ---- joins, sets, ranking


@query("""
SELECT coalesce(l.stem, r.stem) AS stem, CASE WHEN r.stem IS NULL THEN 'only_declared' WHEN l.stem IS NULL THEN 'only_referenced' ELSE 'shared' END AS state
FROM (SELECT DISTINCT stem FROM documents WHERE stem IS NOT NULL) l FULL JOIN (SELECT DISTINCT stem FROM content_blocks WHERE stem IS NOT NULL) r ON l.stem = r.stem""")
def c03_set_consistency(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("stem").filter("stem IS NOT NULL").distinct().withColumn("l", F.lit(1))
    right = table(spark, sf_dir, "content_blocks").select("stem").filter("stem IS NOT NULL").distinct().withColumn("r", F.lit(1))
    state = F.when(F.col("r").isNull(), "only_declared").when(F.col("l").isNull(), "only_referenced").otherwise("shared")
    return left.join(right, "stem", "full_outer").select("stem", state.alias("state"))


@query("""
WITH m AS (SELECT source, avg(n_chars) AS v FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM m)
SELECT source, round(v, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN v IS NULL THEN 'skipped' WHEN v BETWEEN lo AND hi THEN 'pass' ELSE 'warn' END AS verdict,
  round(CASE WHEN v < lo THEN lo - v WHEN v > hi THEN v - hi WHEN v IS NOT NULL THEN 0 END, 6) AS deviation FROM m, c""")
def c07_contract_validation(spark, sf_dir):
    """Target = the middle half of the sources' means; one row a source."""
    m = table(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.avg("n_chars").alias("v"))
    ends = m.agg(F.percentile("v", 0.25), F.percentile("v", 0.75)).first()  # the target: two numbers
    v, lo, hi = F.col("v"), F.lit(ends[0]).cast("double"), F.lit(ends[1]).cast("double")
    verdict = F.when(v.isNull(), "skipped").when(v.between(lo, hi), "pass").otherwise("warn")
    return m.select("source", round6(v).alias("value"), round6(lo).alias("lo"), round6(hi).alias("hi"), verdict.alias("verdict"), round6(F.when(v < lo, lo - v).when(v > hi, v - hi).when(v.isNotNull(), 0.0)).alias("deviation"))


_W = "(VALUES ('src_lantern', 0.8, 1), ('src_amber', 1.2, 0), ('src_birch', 0.5, 2)) w(source, weight, source_order)"


@query(f"""
WITH r AS (SELECT d.stem AS key, d.source, d.doc_id AS pos, coalesce(d.n_chars, 0) / 1000.0::DOUBLE AS score, coalesce(w.weight::DOUBLE, 1.0) AS weight, coalesce(w.source_order, 1073741824) AS so FROM documents d LEFT JOIN {_W} ON d.source = w.source WHERE d.stem IS NOT NULL AND d.source IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY so, pos) AS rn FROM r)
SELECT key, max(CASE WHEN rn = 1 THEN source END) AS source, round(max(CASE WHEN rn = 1 THEN score * weight END) + 0.15 * sum(CASE WHEN rn > 1 THEN weight ELSE 0 END), 6) AS score, count(*) - 1 AS also_from FROM k GROUP BY key ORDER BY score DESC, key LIMIT 50""")
def e01_dedup_and_rank(spark, sf_dir):
    w = spark.createDataFrame([("src_lantern", 0.8, 1), ("src_amber", 1.2, 0), ("src_birch", 0.5, 2)], "source string, weight double, source_order int")
    r = table(spark, sf_dir, "documents").filter("stem IS NOT NULL AND source IS NOT NULL").select(F.col("stem").alias("key"), "source", F.col("doc_id").alias("pos"), (F.coalesce("n_chars", F.lit(0)) / 1000.0).alias("score"))
    return M.dedup_and_rank(r, w, 50)


@query("""
WITH s AS (SELECT DISTINCT source AS i, stem AS m FROM documents WHERE source IS NOT NULL AND stem IS NOT NULL), n AS (SELECT i, count(*) AS n FROM s GROUP BY i)
SELECT a.i AS item_a, b.i AS item_b, count(*) AS shared, round(count(*)::DOUBLE / (max(x.n) + max(y.n) - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.m = b.m AND a.i < b.i JOIN n x ON x.i = a.i JOIN n y ON y.i = b.i GROUP BY a.i, b.i""")
def d26_source_agreement(spark, sf_dir):
    return M.agreement(table(spark, sf_dir, "documents"), "source", "stem")


@query("""
SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS period, count(*) AS used, greatest(0, 60 - count(*)) AS remaining, count(*) >= 60 AS exhausted FROM events GROUP BY 1, 2""")
def d27_period_quota(spark, sf_dir):
    return M.quota(table(spark, sf_dir, "events"), "event_type", "ts", 60, "yyyy-MM-dd")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 10")
def b02_bounded_select(spark, sf_dir):
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return sqlgate.run(spark, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name;", 10)


_URLS = "(VALUES ('HTTPS://www.Corpus.example/A/b/?q=1#x'), ('http://corpus.example'), ('Corpus.Example/P/'), (NULL), ('')) u(url)"


@query(f"""
SELECT url, CASE WHEN h = '' THEN lower(b) ELSE replace(lower(h), '://www.', '://') || substr(b, length(h) + 1) END AS normalized FROM (
  SELECT url, b, coalesce(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1), '') AS h FROM (SELECT url, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS b FROM {_URLS}))""")
def g17_normalize_url(spark, sf_dir):
    d = spark.createDataFrame([("HTTPS://www.Corpus.example/A/b/?q=1#x",), ("http://corpus.example",), ("Corpus.Example/P/",), (None,), ("",)], "url string")
    return d.select("url", M.normalize_url(F.col("url")).alias("normalized"))


@query("SELECT c AS letters, CAST(list_reduce(list_transform(string_split(c, ''), lambda x: ascii(x) - 64), lambda a, b: a * 26 + b) AS INT) AS idx FROM (VALUES ('A'), ('Z'), ('AA'), ('XFD')) v(c)")
def g19_column_index(spark, sf_dir):
    return spark.createDataFrame([("A",), ("Z",), ("AA",), ("XFD",)], "letters string").select("letters", L.column_index(F.col("letters")).alias("idx"))


@query("""
SELECT doc_id, len(refs) AS n_refs, len(list_distinct(refs)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(text, '\\[([0-9]{1,3})\\]', 1) AS refs FROM documents WHERE text IS NOT NULL) WHERE len(refs) > 0""")
def g11_citation_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit("\\[([0-9]{1,3})\\]"), 1).alias("refs"))
    return d.filter(F.size("refs") > 0).select("doc_id", F.size("refs").alias("n_refs"), F.size(F.array_distinct("refs")).alias("n_distinct"))


@query(f"""
WITH y AS (SELECT stem, block_id, TRY_CAST(regexp_extract(text_plain, '(19|20)[0-9][0-9]') AS INT) AS y FROM {_LATEST} WHERE section = 'references' AND regexp_matches(text_plain, '(19|20)[0-9][0-9]')), m AS (SELECT stem, max(y) AS newest FROM y GROUP BY stem)
SELECT y.stem, count(*) AS dated, CAST(max(newest) AS INT) AS newest, round(count(CASE WHEN y >= newest - 5 THEN 1 END)::DOUBLE / count(*), 6) AS m_refage_53 FROM y JOIN m ON y.stem = m.stem GROUP BY y.stem""")
def m_refage_53(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "section", "text_plain").filter("section = 'references' AND text_plain rlike '(19|20)[0-9][0-9]' AND stem IS NOT NULL")
    y = d.select("stem", F.regexp_extract("text_plain", "(19|20)[0-9][0-9]", 0).cast("int").alias("y"))
    newest = y.groupBy("stem").agg(F.max("y").alias("newest"))
    return y.join(newest, "stem").groupBy("stem").agg(F.count("*").alias("dated"), F.max("newest").alias("newest"), round6(safe_div(F.count(F.when(F.col("y") >= F.col("newest") - 5, 1)), F.count("*"))).alias("m_refage_53"))


@query(f"SELECT section, kind, count(*) AS n FROM {_LATEST} WHERE kind IN ('figures','tables','equations') GROUP BY section, kind")
def d20_asset_patterns(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "section", "kind").filter(F.col("kind").isin("figures", "tables", "equations"))
    return d.groupBy("section", "kind").agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n, grouping(l_linestatus) AS is_total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def d35_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return d.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"), F.grouping("l_linestatus").cast("bigint").alias("is_total"))


@query("""
SELECT s.clause_id, b.block_id, s.text = substr(b.text_plain, s.start_pos + 1, s.end_pos - s.start_pos) AS matches
FROM (SELECT DISTINCT clause_id, block_id, start_pos, end_pos, text FROM clause_spans) s JOIN (SELECT DISTINCT block_id, text_plain FROM content_blocks) b ON s.block_id = b.block_id""")
def c20_evidence_check(spark, sf_dir):
    """Spans against the text they cite: exact equality of the slice."""
    s = table(spark, sf_dir, "clause_spans").select("clause_id", "block_id", "start_pos", "end_pos", "text").distinct()
    b = table(spark, sf_dir, "content_blocks").select("block_id", "text_plain").distinct()
    return s.join(b, "block_id").select("clause_id", "block_id", (F.col("text") == F.expr("substring(text_plain, start_pos + 1, end_pos - start_pos)")).alias("matches"))
