"""Corpus profile, contract, validation and further queries, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lexical as L
from textloom.operators import corpus as C
from textloom.plans.core import _LATEST, _latest_blocks, query
from textloom.session import round6, safe_div, table

_TOKENS = "len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*'))"
_CJK = "len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]'))"
_DIGITS = "len(regexp_extract_all(text, '[0-9]'))"
#: Metric values of documents, long: tokens, digits by character, CJK characters by unit.
_LONG_SQL = f"""
WITH b AS (SELECT coalesce(source, '') AS corpus, doc_id, {_TOKENS} AS tok, {_CJK} AS cjk, {_DIGITS} AS dig, length(text) AS n FROM documents),
v AS (SELECT corpus, doc_id, tok, 'tokens' AS metric, tok::DOUBLE AS value FROM b UNION ALL SELECT corpus, doc_id, tok, 'cjk_ratio', round(cjk::DOUBLE / nullif(cjk + tok, 0), 6) FROM b
  UNION ALL SELECT corpus, doc_id, tok, 'digit_share', round(dig::DOUBLE / nullif(n, 0), 6) FROM b)
"""


def metric_values(spark, sf_dir):
    """(corpus, doc_id, tok, metric, value): one row for each document and metric, value null where it is not measurable."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("corpus"), "doc_id", count(L.TOKEN).alias("tok"), count(L.CJK).alias("cjk"), count("[0-9]").alias("dig"), F.length("text").alias("n"))
    pairs = {"tokens": F.col("tok").cast("double"), "cjk_ratio": round6(safe_div(F.col("cjk"), F.col("cjk") + F.col("tok"))), "digit_share": round6(safe_div(F.col("dig"), F.col("n")))}
    return d.select("corpus", "doc_id", "tok", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in pairs.items()])).alias("x")).select("corpus", "doc_id", "tok", "x.*")


_T = "[" + ", ".join(map(str, C.T95)) + "]"
_PROFILE_SQL = (
    _LONG_SQL
    + f""", k AS (SELECT corpus, metric, value, row_number() OVER (PARTITION BY corpus, metric ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY corpus, metric) AS n FROM v WHERE value IS NOT NULL),
q AS (SELECT corpus, metric, max(CASE WHEN r = round_even(0.25 * (n - 1), 0) THEN value END) AS p25, max(CASE WHEN r = round_even(0.5 * (n - 1), 0) THEN value END) AS median, max(CASE WHEN r = round_even(0.75 * (n - 1), 0) THEN value END) AS p75 FROM k GROUP BY ALL),
a AS (SELECT corpus, metric, count(value) AS n_valid, count(*) - count(value) AS n_missing, avg(value) AS mean, CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END AS sd, min(value) AS mi, max(value) AS ma FROM v GROUP BY ALL),
h AS (SELECT a.*, q.p25, q.median, q.p75, CASE WHEN n_valid > 1 THEN (CASE WHEN n_valid > 31 THEN 1.96 ELSE list_extract({_T}, CAST(n_valid - 1 AS INT)) END)::DOUBLE * sd / sqrt(n_valid) WHEN n_valid = 1 THEN 0 END AS half FROM a LEFT JOIN q ON a.corpus = q.corpus AND a.metric = q.metric),
p AS (SELECT corpus, metric, n_valid, n_missing, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, round(p75 - p25, 6) AS iqr, round(mi, 6) AS "min", round(ma, 6) AS "max",
  round(mean - half, 6) AS ci95_low, round(mean + half, 6) AS ci95_high, array_to_string(list_filter([CASE WHEN n_valid = 0 THEN 'NO_VALID_VALUES' END, CASE WHEN n_valid < 5 THEN 'N_LT_5' END, CASE WHEN n_valid < 3 THEN 'N_VALID_LT_3' END,
  CASE WHEN p75 - p25 = 0 THEN 'IQR_ZERO' END, CASE WHEN n_valid > 0 AND n_missing > 0.3 * (n_valid + n_missing) THEN 'HIGH_MISSING' END], lambda x: x IS NOT NULL), ',') AS warnings FROM h)
"""
)


@query(_PROFILE_SQL + "SELECT * FROM p")
def d02_corpus_profile(spark, sf_dir):
    return C.profile(metric_values(spark, sf_dir), ["corpus", "metric"])


_CONTRACT_SQL = (
    _PROFILE_SQL
    + """, c AS (SELECT corpus, metric, n_valid, CASE WHEN p25 < p75 THEN p25 END AS low, CASE WHEN p25 < p75 THEN p75 END AS high, CASE WHEN p25 < p75 AND n_valid >= 5 THEN 'gate' ELSE 'warn' END AS level,
  CASE WHEN p25 IS NULL OR p75 IS NULL THEN 'stats_null' WHEN p25 = p75 THEN 'iqr_zero' WHEN p25 > p75 THEN 'inverted_quantiles' END AS reason, CASE WHEN n_valid < 5 THEN 'N_LT_5' END AS warning FROM p)
"""
)


def _contract(spark, sf_dir):
    return C.contract(C.profile(metric_values(spark, sf_dir), ["corpus", "metric"]), ["corpus", "metric"], gate=True)


@query(_CONTRACT_SQL + "SELECT * FROM c")
def v01_contract(spark, sf_dir):
    return _contract(spark, sf_dir)


_VALIDATED_SQL = (
    _CONTRACT_SQL
    + """, x AS (SELECT doc_id, v.corpus, v.metric, value, low, high, level, greatest(low - value, value - high, 0) AS away, value IS NULL OR low IS NULL OR coalesce(tok < 20, true) AS skip FROM v JOIN c ON v.corpus = c.corpus AND v.metric = c.metric),
y AS (SELECT doc_id, corpus, metric, round(value, 6) AS actual, CASE WHEN NOT skip THEN round(away, 6) END AS deviation, CASE WHEN skip THEN 'skipped' WHEN away = 0 THEN 'pass' WHEN level = 'gate' THEN 'fail' ELSE 'warn' END AS status FROM x)
"""
)


def _validated(spark, sf_dir):
    return C.validate(metric_values(spark, sf_dir), _contract(spark, sf_dir), ["corpus", "metric"], "doc_id", tokens="tok", least_tokens=20)


@query(_VALIDATED_SQL + "SELECT * FROM y")
def v02_validation(spark, sf_dir):
    return _validated(spark, sf_dir)


@query(_VALIDATED_SQL + """SELECT doc_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'skipped') AS n_skipped,
  CASE WHEN count(*) FILTER (status <> 'skipped') < 0.5 * count(*) THEN 2 WHEN count(*) FILTER (status = 'fail') > 0 THEN 1 ELSE 0 END AS exit_code FROM y GROUP BY doc_id""")
def v02_verdicts(spark, sf_dir):
    return C.verdicts(_validated(spark, sf_dir), "doc_id")


@query("""
WITH v AS (SELECT 'marker' AS e, result_id, metric, value FROM (SELECT result_id, marker.elapsed_sec AS elapsed, marker.img_count::DOUBLE AS images FROM paper_results) UNPIVOT (value FOR metric IN (elapsed, images))
  UNION ALL SELECT 'mineru', result_id, metric, value FROM (SELECT result_id, mineru.elapsed_sec AS elapsed, mineru.img_count::DOUBLE AS images FROM paper_results) UNPIVOT (value FOR metric IN (elapsed, images))),
g AS (SELECT e, result_id, metric, max(value) AS value FROM v GROUP BY ALL), d AS (SELECT a.metric, a.value AS x, b.value - a.value AS d FROM g a JOIN g b ON a.result_id = b.result_id AND a.metric = b.metric AND a.e = 'marker' AND b.e = 'mineru')
SELECT metric, count(*) AS n_pairs, round(avg(d), 6) AS mean_signed, round(avg(abs(d)), 6) AS mean_abs, round(max(abs(d)), 6) AS max_abs, round(avg(abs(d) / nullif(x, 0)), 6) AS mean_rel FROM d GROUP BY metric""")
def d36_engine_drift(spark, sf_dir):
    d = table(spark, sf_dir, "paper_results")
    one = lambda e: d.select(F.lit(e).alias("e"), "result_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{e}.{c}").cast("double").alias("value")) for m, c in (("elapsed", "elapsed_sec"), ("images", "img_count"))])))
    return C.drift(one("marker").unionByName(one("mineru")), "e", "marker", "mineru", "result_id")


@query(f"""
WITH p AS (SELECT stem, block_id, text_plain, length(text_plain) AS n FROM {_LATEST} WHERE kind = 'prose' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL)
SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY n DESC, block_id) AS INT) AS place, block_id, CAST(n AS INT) AS n FROM p QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, block_id) <= 3""")
def e04_longest_paragraphs(spark, sf_dir):
    """The three longest paragraphs of each document; ties: the first block. Three is the feature."""
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "text_level", "text_plain").filter("kind = 'prose' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL").withColumn("n", F.length("text_plain"))
    return C.top_by(d, ["stem"], [-F.col("n"), F.col("block_id")], ["block_id", "n"], 3)


@query(f"""
WITH s AS (SELECT stem, section, count(*) AS n FROM {_LATEST} WHERE kind = 'figures' AND stem IS NOT NULL AND section IS NOT NULL GROUP BY ALL)
SELECT stem, section, n FROM s QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, section) = 1""")
def e05_top_section(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "section").filter("kind = 'figures' AND stem IS NOT NULL AND section IS NOT NULL")
    s = d.groupBy("stem", "section").agg(F.count("*").alias("n")).groupBy("stem").agg(F.min(F.struct((-F.col("n")).alias("m"), "section", "n")).alias("w"))
    return s.select("stem", "w.section", "w.n")


@query(f"""
SELECT block_id, stem, CAST(row_number() OVER (PARTITION BY stem, image_path ORDER BY block_index, block_id) AS INT) AS occurrence, count(*) OVER (PARTITION BY stem, image_path) AS total FROM {_LATEST} WHERE image_path IS NOT NULL""")
def w04_image_occurrences(spark, sf_dir):
    """Windows over (document, image): small groups."""
    d = _latest_blocks(spark, sf_dir, "stem", "block_index", "image_path").filter("image_path IS NOT NULL")
    w = Window.partitionBy("stem", "image_path")
    return d.select("block_id", "stem", F.row_number().over(w.orderBy(F.col("block_index").asc_nulls_last(), "block_id")).alias("occurrence"), F.count("*").over(w).alias("total"))


_HEADING = "^\\s*([0-9]{1,3}(?:[.][0-9]{1,3}){0,2})[.]?\\s"


@query(f"""
WITH h AS (SELECT stem, block_index, block_id, regexp_extract(text_plain, '{_HEADING}', 1) AS num FROM {_LATEST} WHERE kind = 'prose' AND text_level IS NOT NULL AND stem IS NOT NULL),
p AS (SELECT *, regexp_replace(num, '[.]?[0-9]+$', '') AS parent, CAST(regexp_extract(num, '[0-9]+$') AS INT) AS last FROM h WHERE num <> ''),
d AS (SELECT stem, parent, last, min(block_index) AS at, count(*) AS times FROM p GROUP BY ALL),
l AS (SELECT *, lag(last) OVER (PARTITION BY stem, parent ORDER BY last) AS before FROM d)
SELECT stem, parent, last, times, CASE WHEN times > 1 THEN 'duplicate' WHEN before IS NULL AND last <> 1 THEN 'start' WHEN last <> before + 1 THEN 'discontinuity' END AS problem FROM l WHERE times > 1 OR (before IS NULL AND last <> 1) OR last <> before + 1""")
def w09_heading_continuity(spark, sf_dir):
    """Numbered headings below each parent that repeat a number, do not start at 1 or skip one."""
    h = _latest_blocks(spark, sf_dir, "stem", "kind", "text_level", "text_plain", "block_index").filter("kind = 'prose' AND text_level IS NOT NULL AND stem IS NOT NULL")
    num = h.select("stem", "block_index", F.regexp_extract("text_plain", _HEADING, 1).alias("num")).filter("num <> ''")
    d = num.groupBy("stem", F.regexp_replace("num", "[.]?[0-9]+$", "").alias("parent"), F.regexp_extract("num", "[0-9]+$", 0).cast("int").alias("last")).agg(F.count("*").alias("times"))
    before = F.lag("last").over(Window.partitionBy("stem", "parent").orderBy("last"))
    problem = F.when(F.col("times") > 1, "duplicate").when(F.col("before").isNull() & (F.col("last") != 1), "start").when(F.col("last") != F.col("before") + 1, "discontinuity")
    return d.withColumn("before", before).select("stem", "parent", "last", "times", problem.alias("problem")).filter("problem IS NOT NULL")


@query(f"""
SELECT id, CASE WHEN l IS NULL AND d = 'unknown' THEN 'none' WHEN l IS NULL THEN 'label_missing' WHEN d = 'unknown' THEN 'detect_missing' WHEN l = d THEN 'none' ELSE 'mismatch' END AS kind, count(*) AS n
FROM (SELECT DISTINCT id, text, nullif(lower(trim(regexp_extract(expected.language, '^[A-Za-z]+'))), '') AS l, CASE WHEN {_CJK} > 0.1 * ({_CJK} + {_TOKENS}) THEN 'zh' WHEN {_TOKENS} > 0 THEN 'en' ELSE 'unknown' END AS d FROM lang_spec_cases WHERE text IS NOT NULL) GROUP BY ALL""")
def c17_recorded_language(spark, sf_dir):
    """Recorded against detected language (the two that metrics support), by kind of disagreement."""
    label = F.nullif(F.lower(F.trim(F.regexp_extract("expected.language", "^[A-Za-z]+", 0))), F.lit(""))
    d = table(spark, sf_dir, "lang_spec_cases").filter("text IS NOT NULL").select("id", "text", label.alias("l"), L.detect_language(F.col("text")).alias("d")).distinct()
    kind = F.when(F.col("l").isNull() & (F.col("d") == "unknown"), "none").when(F.col("l").isNull(), "label_missing").when(F.col("d") == "unknown", "detect_missing").when(F.col("l") == F.col("d"), "none").otherwise("mismatch")
    return d.groupBy("id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT DISTINCT clause_id, block_id FROM clause_spans UNION SELECT DISTINCT clause_id + 1, -block_id FROM clause_spans WHERE clause_id % 5 = 0), n AS (SELECT DISTINCT block_id FROM content_blocks)
SELECT e.clause_id, e.block_id FROM e ANTI JOIN n ON e.block_id = n.block_id""")
def c18_orphan_endpoints(spark, sf_dir):
    """Edges whose end is no node: spans, and some that point to no block."""
    s = table(spark, sf_dir, "clause_spans").select("clause_id", "block_id")
    e = s.unionByName(s.filter("clause_id % 5 = 0").select((F.col("clause_id") + 1).alias("clause_id"), (-F.col("block_id")).alias("block_id"))).distinct()
    return e.join(table(spark, sf_dir, "content_blocks").select("block_id").distinct(), "block_id", "left_anti").select("clause_id", "block_id")


_PHRASES = "(?:we (?:propose|present|introduce|show|design|collected|measured)|our (?:contributions?|results?) (?:are|is|show)|我们(?:提出|设计|采用|发现))"


@query(f"SELECT stem, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '{_PHRASES}'))))), '|') AS phrases FROM documents WHERE stem IS NOT NULL AND regexp_matches(lower(text), '{_PHRASES}') GROUP BY stem")
def d22_contribution_phrases(spark, sf_dir):
    """Distinct phrases that announce a contribution, sorted, by document: as many at most as the pattern has forms."""
    d = table(spark, sf_dir, "documents").filter("stem IS NOT NULL").select("stem", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_PHRASES), 0)).alias("p"))
    return d.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("p")), "|").alias("phrases"))


@query("""
WITH p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL)), v AS (SELECT doc_id, w, list(i ORDER BY i) AS at FROM p GROUP BY ALL)
SELECT doc_id, text AS rebuilt FROM documents WHERE doc_id IN (SELECT doc_id FROM v)""")
def a15_inverted_index_rebuild(spark, sf_dir):
    """Texts as maps word -> positions, rebuilt from them: explode, sort by position, join. Equal to the text, which the SQL gives."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    index = d.groupBy("doc_id", "w").agg(F.collect_list("i").alias("at"))
    return index.select("doc_id", F.explode("at").alias("i"), "w").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("rebuilt"))
