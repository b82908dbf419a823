"""More queries over the analytics operators, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lexical as L
from textloom.operators import stats
from textloom.plans.core import _LATEST, _latest_blocks, query
from textloom.session import round6, safe_div, table
from textloom.sources.readers import plain_text_blocks
from textloom.streaming.counters import windowed_counts


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_index, p AS text_plain FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL))")
def a07_plain_text_blocks(spark, sf_dir):
    return plain_text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'threshold') AND ingested_at IS NOT NULL ORDER BY ingested_at DESC, doc_id LIMIT 20")
def a12_history_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("threshold")) & F.col("ingested_at").isNotNull()).orderBy(F.desc("ingested_at"), "doc_id").limit(20).select("doc_id", "source")


@query(f"""
SELECT block_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(table_body, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM {_LATEST} WHERE table_body IS NOT NULL""")
def b15_html_to_text(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "table_body").filter("table_body IS NOT NULL")
    t = F.col("table_body")
    for pattern, to in (("(?s)<!--.*?-->", ""), ("<[^>]*>", " "), ("&lt;", "<"), ("&amp;", "&"), ("\\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return d.select("block_id", F.trim(t).alias("text"))


@query(f"SELECT lower(trim(regexp_replace(regexp_replace(text_plain, '^[0-9.]+\\s*', ''), '[.:]+$', ''))) AS title, count(*) AS n FROM {_LATEST} WHERE kind = 'prose' AND text_level IS NOT NULL AND text_plain IS NOT NULL GROUP BY 1")
def b08_normalized_titles(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "kind", "text_level", "text_plain").filter("kind = 'prose' AND text_level IS NOT NULL AND text_plain IS NOT NULL")
    return d.groupBy(F.lower(F.trim(F.regexp_replace(F.regexp_replace("text_plain", "^[0-9.]+\\s*", ""), "[.:]+$", ""))).alias("title")).agg(F.count("*").alias("n"))


@query(f"""
SELECT block_id, regexp_matches(text_plain, '^\\s*(\\[[0-9]+\\]|[0-9]+[.])\\s') OR (len(string_split_regex(trim(text_plain), '\\s+')) >= 5 AND regexp_matches(text_plain, '(19|20)[0-9][0-9]') AND regexp_matches(text_plain, '^\\s*[A-Z][A-Za-z''-]+,? ')) AS is_reference
FROM {_LATEST} WHERE section = 'references' AND text_plain IS NOT NULL""")
def b18_reference_entries(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "section", "text_plain").filter("section = 'references' AND text_plain IS NOT NULL")
    return d.select("block_id", L.looks_like_reference(F.col("text_plain")).alias("is_reference"))


@query("""
WITH c AS (SELECT id, CAST(expected.cjk_ratio AS DOUBLE) AS ratio, expected.cjk_chars AS e, len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]')) AS a FROM (SELECT DISTINCT id, text, expected FROM lang_spec_cases) WHERE text IS NOT NULL)
SELECT id, CASE WHEN e IS NULL THEN 'not_assessed' WHEN e = a THEN 'same' ELSE 'differs' END AS state, CAST(a AS INT) AS actual FROM c""")
def c06_expected_registry(spark, sf_dir):
    d = table(spark, sf_dir, "lang_spec_cases").select("id", "text", "expected").distinct().filter("text IS NOT NULL")
    actual = F.regexp_count("text", F.lit(L.CJK))
    state = F.when(F.col("expected.cjk_chars").isNull(), "not_assessed").when(F.col("expected.cjk_chars") == actual, "same").otherwise("differs")
    return d.select("id", state.alias("state"), actual.alias("actual"))


@query("""
WITH s AS (SELECT DISTINCT clause_id, block_id, start_pos, end_pos FROM clause_spans), c AS (SELECT DISTINCT block_id, length(text_plain) AS n FROM content_blocks WHERE text_plain IS NOT NULL),
i AS (SELECT clause_id AS id, block_id, start_pos AS a, end_pos AS e FROM s), o AS (SELECT 'block' AS what, block_id AS id, block_id, 0 AS a, n AS e FROM c UNION ALL SELECT 'span', id, block_id, a, e FROM i)
SELECT i.id AS inner_id, o.what AS outer_kind, o.id AS outer_id FROM i JOIN o ON i.block_id = o.block_id AND (o.what = 'block' OR o.id <> i.id) AND o.a <= i.a AND i.e <= o.e""")
def c11_span_containment(spark, sf_dir):
    """Spans inside other spans of their block, or inside its text: an equi-join on the block, the containment on its rows."""
    i = table(spark, sf_dir, "clause_spans").select(F.col("clause_id").cast("bigint").alias("id"), "block_id", F.col("start_pos").alias("a"), F.col("end_pos").alias("e")).distinct()
    c = table(spark, sf_dir, "content_blocks").filter("text_plain IS NOT NULL").select(F.lit("block").alias("what"), F.col("block_id").alias("id"), "block_id", F.lit(0).alias("a"), F.length("text_plain").alias("e")).distinct()
    o = c.unionByName(i.withColumn("what", F.lit("span"))).alias("o")
    inside = F.expr("i.block_id = o.block_id AND (o.what = 'block' OR o.id <> i.id) AND o.a <= i.a AND i.e <= o.e")
    return i.alias("i").join(o, inside).select(F.col("i.id").alias("inner_id"), F.col("o.what").alias("outer_kind"), F.col("o.id").alias("outer_id"))


@query("SELECT source, section, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd FROM documents GROUP BY GROUPING SETS ((source), (source, section))")
def d03_stratified_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "section", "n_chars")
    sets = d.groupingSets([[F.col("source")], [F.col("source"), F.col("section")]], F.col("source"), F.col("section"))
    return sets.agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("sd"))


_VALUES = ", ".join(f"('{g}', '{w}')" for g, ws in L.LEXICON.items() for w in ws)


@query(f"""
WITH x(grp, entry) AS (VALUES {_VALUES}), t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*'), lambda x: lower(x))) AS entry FROM documents WHERE text IS NOT NULL),
h AS (SELECT entry, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM t GROUP BY entry) SELECT x.grp, x.entry, coalesce(hits, 0) AS hits, coalesce(docs, 0) AS docs, hits IS NULL AS never_fired FROM x LEFT JOIN h ON x.entry = h.entry""")
def d14_lexicon_audit(spark, sf_dir):
    """Entries first, then counts: words outside the lexicon are dropped before the shuffle, which its few entries allow (their number is fixed)."""
    x = spark.createDataFrame([(g, w) for g, ws in L.LEXICON.items() for w in ws], "grp string, entry string")
    t = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(L.tokens(F.col("text"))).alias("entry"))
    by_doc = t.join(F.broadcast(x.select("entry").distinct()), "entry", "left_semi").groupBy("entry", "doc_id").agg(F.count("*").alias("n"))
    h = by_doc.groupBy("entry").agg(F.sum("n").alias("hits"), F.count("*").alias("docs"))
    return x.join(h, "entry", "left").select("grp", "entry", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("docs", F.lit(0)).alias("docs"), F.col("hits").isNull().alias("never_fired"))


@query("""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\\[[0-9]{1,3}\\]')) AS num, len(regexp_extract_all(text, '\\([A-Z][a-z]+( et al[.])?,? (19|20)[0-9][0-9]\\)')) AS ay FROM documents WHERE text IS NOT NULL)
SELECT CAST(sum(num) AS BIGINT) AS numeric, CAST(sum(ay) AS BIGINT) AS author_year, CASE WHEN sum(num) + sum(ay) = 0 THEN 'unknown' WHEN sum(num) >= 0.85 * (sum(num) + sum(ay)) THEN 'numeric' WHEN sum(num) <= 0.15 * (sum(num) + sum(ay)) THEN 'author_year' ELSE 'mixed' END AS style FROM c""")
def d21_citation_style(spark, sf_dir):
    c = table(spark, sf_dir, "documents").filter("text IS NOT NULL").agg(
        F.sum(F.regexp_count("text", F.lit("\\[[0-9]{1,3}\\]"))).alias("numeric"), F.sum(F.regexp_count("text", F.lit("\\([A-Z][a-z]+( et al[.])?,? (19|20)[0-9][0-9]\\)"))).alias("author_year")
    )
    n, all_ = F.col("numeric"), F.col("numeric") + F.col("author_year")
    return c.withColumn("style", F.when(all_ == 0, "unknown").when(n >= 0.85 * all_, "numeric").when(n <= 0.15 * all_, "author_year").otherwise("mixed"))


@query("""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[０-９]')) AS wide_digits, len(regexp_extract_all(text, '[A-Za-z]')) AS alpha, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS cjk, length(text) AS chars FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(digits AS INT) AS digits, CAST(wide_digits AS INT) AS wide_digits, CAST(alpha AS INT) AS alpha, CAST(cjk AS INT) AS cjk, CAST(chars AS INT) AS chars, round(greatest(0, digits - wide_digits)::DOUBLE / nullif(digits, 0), 6) AS loss FROM c""")
def d28_text_layer_counts(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p))
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", count("[0-9]").alias("digits"), count("[０-９]").alias("wide_digits"), count("[A-Za-z]").alias("alpha"), count("[\\x{4e00}-\\x{9fff}]").alias("cjk"), F.length("text").alias("chars"))
    return d.withColumn("loss", round6(safe_div(F.greatest(F.lit(0), F.col("digits") - F.col("wide_digits")), F.col("digits"))))


@query("""
WITH k AS (SELECT stem, doc_id, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[$]')) AS formulas, length(text) AS chars FROM documents WHERE stem IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT ON (stem) stem, doc_id AS best_doc, CAST(digits AS INT) AS digits FROM k ORDER BY stem, digits DESC, formulas DESC, chars DESC, doc_id DESC""")
def d30_info_score(spark, sf_dir):
    """The most informative text of each stem: digits, formulas, length, compared in this order."""
    d = table(spark, sf_dir, "documents").filter("stem IS NOT NULL AND text IS NOT NULL")
    score = F.struct(F.regexp_count("text", F.lit("[0-9]")).alias("digits"), F.regexp_count("text", F.lit("[$]")).alias("formulas"), F.length("text").alias("chars"), F.col("doc_id"))
    return d.groupBy("stem").agg(F.max(score).alias("s")).select("stem", F.col("s.doc_id").alias("best_doc"), F.col("s.digits").alias("digits"))


@query("SELECT block_id, count(*) AS deliveries FROM content_blocks GROUP BY block_id HAVING count(*) > 1")
def f10_duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "content_blocks").groupBy("block_id").agg(F.count("*").alias("deliveries")).filter("deliveries > 1")


@query(f"WITH x(grp, entry) AS (VALUES {_VALUES}, ('own', 'because'), ('own', 'novel')), n AS (SELECT entry, count(DISTINCT grp) AS k FROM x GROUP BY entry) SELECT grp, count(*) AS entries, count(*) FILTER (k > 1) AS shared FROM x JOIN n ON x.entry = n.entry GROUP BY grp")
def f01_lexicon_disjointness(spark, sf_dir):
    """Entries of each lexicon group, and those that another group has too; a user's group shares one."""
    x = spark.createDataFrame([(g, w) for g, ws in (L.LEXICON | {"own": ("because", "novel")}).items() for w in ws], "grp string, entry string")
    n = x.groupBy("entry").agg(F.countDistinct("grp").alias("k"))
    return x.join(n, "entry").groupBy("grp").agg(F.count("*").alias("entries"), F.count_if(F.col("k") > 1).alias("shared"))


@query("SELECT stem FROM documents WHERE stem IS NOT NULL EXCEPT SELECT stem FROM meta_records")
def f03_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("stem IS NOT NULL").select("stem").subtract(table(spark, sf_dir, "meta_records").select("stem"))


@query("""
WITH r(doc, expr) AS (VALUES ('a', '13-15'), ('a', '3'), ('b', '7-90'), ('c', '9-2')), p AS (SELECT doc, CAST(string_split(expr, '-')[1] AS INT) AS lo, CAST(string_split(expr, '-')[-1] AS INT) AS hi FROM r)
SELECT doc, CAST(unnest(range(lo, hi + 1)) AS INT) AS num FROM p WHERE hi >= lo AND hi - lo <= 50""")
def g10_range_expansion(spark, sf_dir):
    """Reference ranges to numbers; ranges of more than 50 are no references."""
    r = spark.createDataFrame([("a", "13-15"), ("a", "3"), ("b", "7-90"), ("c", "9-2")], "doc string, expr string")
    lo, hi = F.element_at(F.split("expr", "-"), 1).cast("int"), F.element_at(F.split("expr", "-"), -1).cast("int")
    return r.select("doc", lo.alias("lo"), hi.alias("hi")).filter("hi >= lo AND hi - lo <= 50").select("doc", F.explode(F.sequence("lo", "hi")).alias("num"))


_HEX = [("c1", "#1f77b4"), ("c2", "#ffffff"), ("c3", "#000000"), ("c4", "#d62728")]
_CH = lambda i: f"('0x' || substr(hex, {i}, 2))::INT / 255.0::DOUBLE"
_LIN = lambda x: f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"


@query(f"""
WITH c(slot, hex) AS (VALUES {', '.join(map(str, _HEX))}), l AS (SELECT slot, 0.2126 * ({_LIN(_CH(2))}) + 0.7152 * ({_LIN(_CH(4))}) + 0.0722 * ({_LIN(_CH(6))}) AS y FROM c)
SELECT a.slot AS a, b.slot AS b, round((greatest(a.y, b.y) + 0.05) / (least(a.y, b.y) + 0.05), 6) AS contrast FROM l a JOIN l b ON a.slot < b.slot""")
def g25_colour_contrast(spark, sf_dir):
    """WCAG contrast of every two colours of a palette (a fixed, small list)."""
    c = spark.createDataFrame(_HEX, "slot string, hex string")

    def linear(i):
        x = F.conv(F.substring("hex", i, 2), 16, 10).cast("double") / 255
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    y = c.select("slot", (0.2126 * linear(2) + 0.7152 * linear(4) + 0.0722 * linear(6)).alias("y"))
    a, b = y.alias("a"), y.alias("b")
    return a.join(b, F.col("a.slot") < F.col("b.slot")).select(F.col("a.slot").alias("a"), F.col("b.slot").alias("b"), F.round((F.greatest("a.y", "b.y") + 0.05) / (F.least("a.y", "b.y") + 0.05), 6).alias("contrast"))


_ZH = "(SELECT DISTINCT clause_id, text FROM clause_spans WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) > 0)"


@query(f"""
SELECT clause_id, CAST(len(regexp_extract_all(text, '[，；：,;:]')) AS INT) AS m_spat_44, CAST(len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}][性度率]')) AS INT) AS m_nom_10, CAST(len(regexp_extract_all(text, '(被|由|受到)[\\x{{4e00}}-\\x{{9fff}}]')) AS INT) AS m_pas_09,
  list_any_value(list_filter(['因此', '然而', '此外', '若', '与'], lambda x: starts_with(text, x))) IS NOT NULL AS m_spat_46 FROM {_ZH}""")
def m_zh_clause_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "clause_spans").select("clause_id", "text").distinct().filter(F.regexp_count("text", F.lit("[\\x{4e00}-\\x{9fff}]")) > 0)
    count = lambda p: F.regexp_count("text", F.lit(p))
    starts = F.exists(F.array(*map(F.lit, ("因此", "然而", "此外", "若", "与"))), lambda x: F.startswith("text", x))
    return d.select("clause_id", count("[，；：,;:]").alias("m_spat_44"), count("[\\x{4e00}-\\x{9fff}][性度率]").alias("m_nom_10"), count("(被|由|受到)[\\x{4e00}-\\x{9fff}]").alias("m_pas_09"), starts.alias("m_spat_46"))


@query(f"""
WITH w AS (SELECT stem, len(list_filter(string_split_regex(trim(text_plain), '\\s+'), lambda x: x <> '')) AS n FROM {_LATEST} WHERE kind = 'prose' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL)
SELECT stem, count(*) AS paragraphs, round(avg(n), 6) AS m_pcnt_25, round(stddev_pop(n), 6) AS sd FROM w WHERE n >= 15 GROUP BY stem""")
def m_pcnt_25_paragraph_length(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "text_level", "text_plain").filter("kind = 'prose' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL")
    d = d.withColumn("n", F.size(F.filter(F.split(F.trim("text_plain"), "\\s+"), lambda x: x != ""))).filter("n >= 15")
    return d.groupBy("stem").agg(F.count("*").alias("paragraphs"), round6(F.avg("n")).alias("m_pcnt_25"), round6(F.stddev_pop("n")).alias("sd"))


@query(f"""
WITH l AS (SELECT stem, length(caption) AS v FROM {_LATEST} WHERE caption IS NOT NULL AND stem IS NOT NULL), r AS (SELECT stem, v, row_number() OVER (PARTITION BY stem ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY stem) AS n FROM l)
SELECT stem, n, max(CASE WHEN k = n // 2 THEN v END)::DOUBLE AS s_capl_05 FROM r GROUP BY stem, n""")
def s_capl_05_caption_length(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "stem", "caption").filter("caption IS NOT NULL AND stem IS NOT NULL").select("stem", F.length("caption").alias("v"))
    return stats.order_statistics(d, ["stem"], "v").select("stem", "n", F.col("upper_median").alias("s_capl_05"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber - lag(l_linenumber, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS jump FROM lineitem")
def w07_numbering_continuity(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - F.lag("l_linenumber", 1, 0).over(order) - 1).alias("jump"))


@query("SELECT s_nationkey, s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0::DOUBLE AS avg_rank FROM supplier")
def w03_average_rank(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    ranks = stats.average_ranks(s, ["s_nationkey"], "s_acctbal").select("s_nationkey", "s_acctbal", "avg_rank")
    return s.join(ranks, ["s_nationkey", "s_acctbal"]).select("s_nationkey", "s_suppkey", "avg_rank")


@query("SELECT doc_id, k, hit FROM (SELECT doc_id, unnest(hs) AS hit, generate_subscripts(hs, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '(Fig|Tab|Sec|Eq)[.] [0-9]+', 0)[1:5] AS hs FROM documents WHERE text IS NOT NULL))")
def w11_first_evidence(spark, sf_dir):
    """The first five mentions of each text, in order: the bound is the feature."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit("(Fig|Tab|Sec|Eq)[.] [0-9]+"), 0), 1, 5)).alias("p", "hit"))
    return d.select("doc_id", (F.col("p") + 1).alias("k"), "hit")


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def streaming_daily_counts(spark, sf_dir):
    """The streaming counter's plan over the same events as a batch."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
