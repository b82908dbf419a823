"""Figures, tables and references of documents: numbering, mentions, shape, placement, reference lists and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lexical as L
from textloom.operators import blocks as B
from textloom.operators import stats
from textloom.plans.core import _CELLS, _LATEST, _NUM, _latest_blocks, query
from textloom.session import round6, safe_div

#: Sections of a paper's body, how figures and tables are named, the widest range of numbers that counts as one.
BODY = ("introduction", "related_work", "method", "experiments", "results", "discussion", "conclusion")
NAMES = {"figures": "(?:Figures?|Figs?[.]?|图)", "tables": "(?:Tables?|Tabs?[.]|表)"}
WIDEST = 50
_NUMBERS = "\\s*([0-9]+(?:\\s*[-–]\\s*[0-9]+)?)"
_BODY_SQL = "(" + ", ".join(f"'{s}'" for s in BODY) + ")"
_FOLD = "translate({}, '０１２３４５６７８９', '0123456789')"


def _folded(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def expand_range(expr: Column) -> Column:
    """The numbers of "7" or "13-15" (in either order); none for a range of more than WIDEST."""
    ends = F.transform(F.regexp_extract_all(expr, F.lit("[0-9]+"), 0), lambda x: x.try_cast("int"))
    lo, hi = F.array_min(ends), F.array_max(ends)
    return F.when(hi - lo < WIDEST, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _expand_sql(e: str) -> str:
    ends = f"list_transform(regexp_extract_all({e}, '[0-9]+'), lambda x: TRY_CAST(x AS INT))"
    return f"CASE WHEN list_max({ends}) - list_min({ends}) < {WIDEST} THEN range(list_min({ends}), list_max({ends}) + 1) ELSE [] END"


def _body(spark, sf_dir) -> DataFrame:
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "text_level", "text_plain", "section")
    return d.filter((F.col("kind") == "prose") & F.col("text_level").isNull() & F.col("section").isin(*BODY) & F.col("text_plain").isNotNull() & F.col("stem").isNotNull()).select("stem", "block_id", "text_plain")


_BODY_BLOCKS_SQL = f"(SELECT stem, block_id, text_plain FROM {_LATEST} WHERE kind = 'prose' AND text_level IS NULL AND section IN {_BODY_SQL} AND text_plain IS NOT NULL AND stem IS NOT NULL)"


def declared(spark, sf_dir) -> DataFrame:
    """(stem, stream, num): the numbers that captions give their figures and tables, one row a caption and number."""
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "caption").filter("kind IN ('figures', 'tables') AND caption IS NOT NULL AND stem IS NOT NULL")
    name = lambda k: F.regexp_extract(_folded(F.trim("caption")), f"^{NAMES[k]}{_NUMBERS}", 1)
    return d.select("stem", F.col("kind").alias("stream"), F.explode(expand_range(F.when(F.col("kind") == "figures", name("figures")).otherwise(name("tables")))).alias("num"))


def mentioned(spark, sf_dir) -> DataFrame:
    """(stem, stream, num, mentions): how often the body's prose names each figure and table, ranges expanded."""
    body = _body(spark, sf_dir)
    one = lambda k: body.select("stem", F.lit(k).alias("stream"), F.explode(F.regexp_extract_all(_folded(F.col("text_plain")), F.lit(NAMES[k] + _NUMBERS), 1)).alias("e"))
    return one("figures").unionByName(one("tables")).select("stem", "stream", F.explode(expand_range(F.col("e"))).alias("num")).groupBy("stem", "stream", "num").agg(F.count("*").alias("mentions"))


def _named_sql(k: str, at_start: bool) -> str:
    return f"'{'^' if at_start else ''}{NAMES[k]}{_NUMBERS}'"


_NUMBERS_SQL = f"""
WITH cap AS (SELECT stem, kind AS stream, regexp_extract({_FOLD.format('trim(caption)')}, CASE WHEN kind = 'figures' THEN {_named_sql('figures', True)} ELSE {_named_sql('tables', True)} END, 1) AS e
  FROM {_LATEST} WHERE kind IN ('figures', 'tables') AND caption IS NOT NULL AND stem IS NOT NULL),
dec AS (SELECT stem, stream, CAST(unnest({_expand_sql('e')}) AS INT) AS num FROM cap),
men0 AS (SELECT stem, 'figures' AS stream, unnest(regexp_extract_all({_FOLD.format('text_plain')}, {_named_sql('figures', False)}, 1)) AS e FROM {_BODY_BLOCKS_SQL}
  UNION ALL SELECT stem, 'tables', unnest(regexp_extract_all({_FOLD.format('text_plain')}, {_named_sql('tables', False)}, 1)) FROM {_BODY_BLOCKS_SQL}),
men AS (SELECT stem, stream, num, count(*) AS mentions FROM (SELECT stem, stream, CAST(unnest({_expand_sql('e')}) AS INT) AS num FROM men0) GROUP BY ALL)
"""


@query(_NUMBERS_SQL + "SELECT stem, stream, num, mentions FROM men")
def g10_mentioned_numbers(spark, sf_dir):
    return mentioned(spark, sf_dir)


@query(_NUMBERS_SQL + """, n AS (SELECT stem, stream, num, count(*) AS times FROM dec GROUP BY ALL),
a AS (SELECT stem, stream, CAST(sum(times) AS BIGINT) AS declared, CAST(sum(times) - count(*) AS BIGINT) AS repeated, max(num) AS top, list_sort(list(num) FILTER (times > 1)) AS duplicates, list(num) AS seen FROM n GROUP BY ALL)
SELECT stem, stream, declared, repeated, coalesce(array_to_string(list_filter(range(1, least(top, 10000) + 1), lambda x: NOT list_contains(seen, x)), ','), '') AS gaps, coalesce(array_to_string(duplicates, ','), '') AS duplicates,
  round((declared - repeated)::DOUBLE / declared, 6) AS s_num_02 FROM a""")
def s_num_02_numbering(spark, sf_dir):
    """Declared numbers that are no repetition, by all; the numbers missing below the greatest (looked for up to 10,000), and those given twice."""
    n = declared(spark, sf_dir).groupBy("stem", "stream", "num").agg(F.count("*").alias("times"))
    a = n.groupBy("stem", "stream").agg(F.sum("times").alias("declared"), F.count("*").alias("k"), F.max("num").alias("top"), F.array_sort(F.collect_list(F.when(F.col("times") > 1, F.col("num")))).alias("dup"), F.collect_list("num").alias("seen"))
    gaps = F.when(F.col("top") >= 1, F.array_except(F.sequence(F.lit(1), F.least("top", F.lit(10000))), "seen")).otherwise(F.array().cast("array<int>"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    repeated = F.col("declared") - F.col("k")
    return a.select("stem", "stream", "declared", repeated.alias("repeated"), text(gaps).alias("gaps"), text(F.col("dup")).alias("duplicates"), round6(safe_div(F.col("k"), F.col("declared"))).alias("s_num_02"))


@query(_NUMBERS_SQL + """, j AS (SELECT coalesce(d.stem, m.stem) AS stem, coalesce(d.stream, m.stream) AS stream, coalesce(d.num, m.num) AS num, d.num IS NOT NULL AS d, m.num IS NOT NULL AS m
  FROM (SELECT DISTINCT stem, stream, num FROM dec) d FULL JOIN men m ON d.stem = m.stem AND d.stream = m.stream AND d.num = m.num)
SELECT stem, count(*) FILTER (d AND m) AS shared, count(*) FILTER (NOT d) AS dangling, count(*) FILTER (NOT m) AS uncited, round(count(*) FILTER (d AND m)::DOUBLE / count(*), 6) AS s_ref_03 FROM j GROUP BY stem""")
def s_ref_03_mentions_against_captions(spark, sf_dir):
    """Jaccard overlap of declared and mentioned numbers of a document, figures and tables pooled; mentioned only (dangling), declared only (uncited)."""
    d = declared(spark, sf_dir).distinct().withColumn("d", F.lit(1))
    j = d.join(mentioned(spark, sf_dir), ["stem", "stream", "num"], "full")
    shared = F.count_if(F.col("d").isNotNull() & F.col("mentions").isNotNull())
    return j.groupBy("stem").agg(shared.alias("shared"), F.count_if(F.col("d").isNull()).alias("dangling"), F.count_if(F.col("mentions").isNull()).alias("uncited"), round6(safe_div(shared, F.count("*"))).alias("s_ref_03"))


@query(_NUMBERS_SQL + """, t AS (SELECT d.stem, coalesce(mentions, 0) AS v FROM (SELECT DISTINCT stem, stream, num FROM dec WHERE stream = 'tables') d LEFT JOIN men m ON d.stem = m.stem AND d.stream = m.stream AND d.num = m.num),
r AS (SELECT stem, v, row_number() OVER (PARTITION BY stem ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY stem) AS n FROM t)
SELECT stem, n AS n_tables, max(CASE WHEN k = n // 2 THEN v END)::DOUBLE AS s_ref_14 FROM r GROUP BY stem, n""")
def s_ref_14_reference_depth(spark, sf_dir):
    """Mentions in prose of each declared table of a document: their upper median."""
    d = declared(spark, sf_dir).filter("stream = 'tables'").distinct()
    v = d.join(mentioned(spark, sf_dir), ["stem", "stream", "num"], "left").select("stem", F.coalesce("mentions", F.lit(0)).alias("v"))
    return stats.order_statistics(v, ["stem"], "v").select("stem", F.col("n").alias("n_tables"), F.col("upper_median").alias("s_ref_14"))


# ---- tables

_ROWS_SQL = "list_transform(regexp_extract_all(table_body, '(?s)<tr[^>]*>(.*?)</tr>', 1), lambda r: {})"
_COLSPANS = "list_transform(regexp_extract_all(r, '<t[dh][^>]*>'), lambda c: coalesce(TRY_CAST(regexp_extract(c, 'colspan=[\"'']?([0-9]+)', 1) AS INT), 1))"
_TABLES_SQL = f"(SELECT stem, block_id, section, table_body FROM {_LATEST} WHERE kind = 'tables' AND stem IS NOT NULL)"


def _tables(spark, sf_dir) -> DataFrame:
    return _latest_blocks(spark, sf_dir, "stem", "kind", "section", "table_body").filter("kind = 'tables' AND stem IS NOT NULL")


def table_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1)


def declared_columns(html: Column) -> Column:
    """Columns of a table: the most that a row has, colspans added up. Null without a row."""
    span = lambda c: F.coalesce(F.regexp_extract(c, "colspan=[\"']?([0-9]+)", 1).try_cast("int"), F.lit(1))
    per_row = F.transform(table_rows(html), lambda r: F.aggregate(F.regexp_extract_all(r, F.lit("<t[dh][^>]*>"), 0), F.lit(0), lambda acc, c: acc + span(c)))
    return F.array_max(per_row)


_ROW_CELLS = "list_transform(regexp_extract_all(r, '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g')))"


@query(f"""
WITH t AS (SELECT stem, {_ROWS_SQL.format(f'list_sum({_COLSPANS})')} AS cols, {_ROWS_SQL.format(_ROW_CELLS)} AS rws, {_CELLS} AS cells FROM {_TABLES_SQL}),
v AS (SELECT stem, CAST(list_max(cols) AS INT) AS c, CASE WHEN coalesce(len(cells), 0) = 0 THEN 1 ELSE 0 END AS no_body, len(list_filter(cells, lambda c: contains(c, '$'))) AS latex, len(cells) AS n_cells,
  len(rws) AS n_rows, len(list_filter(rws, lambda r: len(r) > 0 AND len(list_filter(r, lambda c: {_NUM})) >= greatest(1, len(r) // 2))) AS num_rows FROM t),
r AS (SELECT stem, c, row_number() OVER (PARTITION BY stem ORDER BY c) - 1 AS k, count(*) OVER (PARTITION BY stem) AS n FROM v WHERE c IS NOT NULL),
m AS (SELECT stem, max(CASE WHEN k = n // 2 THEN c END)::DOUBLE AS s_tbl_06 FROM r GROUP BY stem)
SELECT v.stem, count(*) AS n_tables, any_value(s_tbl_06) AS s_tbl_06, round(avg(no_body), 6) AS s_tbl_08, round(sum(num_rows)::DOUBLE / nullif(sum(n_rows), 0), 6) AS s_tbl_12, round(sum(latex)::DOUBLE / nullif(sum(n_cells), 0), 6) AS s_tbl_13
FROM v LEFT JOIN m ON v.stem = m.stem GROUP BY v.stem""")
def s_tbl_shapes(spark, sf_dir):
    """Of a document's tables: upper median of columns, share without cells, share of rows with half their cells (one at least) numeric, share of cells with formulas left."""
    cells = B.table_cells(F.col("table_body"))
    numeric_row = lambda r: F.size(r) - F.size(F.filter(r, lambda c: ~B.numeric_cell(c))) >= F.greatest(F.lit(1), F.floor(F.size(r) / 2))
    rows = F.transform(table_rows(F.col("table_body")), B.table_cells)
    v = _tables(spark, sf_dir).select(
        "stem", declared_columns(F.col("table_body")).alias("c"), F.when(F.coalesce(F.size(cells), F.lit(0)) <= 0, 1).otherwise(0).alias("no_body"), F.greatest(F.size(cells), F.lit(0)).alias("n_cells"),
        F.greatest(F.size(F.filter(cells, lambda c: F.contains(c, F.lit("$")))), F.lit(0)).alias("latex"), F.greatest(F.size(rows), F.lit(0)).alias("n_rows"), F.greatest(F.size(F.filter(rows, lambda r: (F.size(r) > 0) & numeric_row(r))), F.lit(0)).alias("num_rows"),
    )
    a = v.groupBy("stem").agg(F.count("*").alias("n_tables"), round6(F.avg("no_body")).alias("s_tbl_08"), round6(safe_div(F.sum("num_rows"), F.sum("n_rows"))).alias("s_tbl_12"), round6(safe_div(F.sum("latex"), F.sum("n_cells"))).alias("s_tbl_13"))
    m = stats.order_statistics(v.filter("c IS NOT NULL"), ["stem"], "c").select("stem", F.col("upper_median").alias("s_tbl_06"))
    return a.join(m, "stem", "left").select("stem", "n_tables", "s_tbl_06", "s_tbl_08", "s_tbl_12", "s_tbl_13")


_W = "len(regexp_extract_all(text_plain, '[A-Za-z][A-Za-z''\\-]*')) + len(regexp_extract_all(text_plain, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]'))"


@query(f"""
WITH u AS (SELECT stem, CAST(sum({_W}) AS BIGINT) AS units FROM {_BODY_BLOCKS_SQL} GROUP BY stem), s AS (SELECT stem, section, count(*) AS n FROM {_TABLES_SQL} GROUP BY stem, section),
t AS (SELECT stem, CAST(sum(n) AS BIGINT) AS n_tables, CAST(coalesce(sum(n) FILTER (section = 'results'), 0) AS BIGINT) AS in_results, max(n) AS top FROM s GROUP BY stem),
f AS (SELECT s.stem, min(coalesce(section, '')) AS top_section FROM s JOIN t ON s.stem = t.stem AND s.n = t.top GROUP BY s.stem)
SELECT t.stem, n_tables, units, round(n_tables * 1000.0::DOUBLE / nullif(units, 0), 6) AS s_tbl_09, top_section, round(top::DOUBLE / n_tables, 6) AS s_tbl_10, round(in_results::DOUBLE / n_tables, 6) AS results_share
FROM t JOIN f ON t.stem = f.stem LEFT JOIN u ON t.stem = u.stem""")
def s_tbl_density_and_placement(spark, sf_dir):
    """Tables by thousand units of the body's prose, and the section that most of them are in (ties: the first name)."""
    u = _body(spark, sf_dir).groupBy("stem").agg(F.sum(L.cjk_units(F.col("text_plain"))).alias("units"))
    s = _tables(spark, sf_dir).groupBy("stem", "section").agg(F.count("*").alias("n"))
    t = s.groupBy("stem").agg(F.sum("n").alias("n_tables"), F.coalesce(F.sum(F.when(F.col("section") == "results", F.col("n"))), F.lit(0)).alias("in_results"), F.max("n").alias("top"), F.min(F.struct(-F.col("n"), F.coalesce("section", F.lit("")).alias("s"))).alias("f"))
    share = lambda c: round6(safe_div(F.col(c), F.col("n_tables")))
    return t.join(u, "stem", "left").select("stem", "n_tables", "units", round6(safe_div(F.col("n_tables") * 1000, F.col("units"))).alias("s_tbl_09"), F.col("f.s").alias("top_section"), share("top").alias("s_tbl_10"), share("in_results").alias("results_share"))


# ---- references

_MARK = "[\\[［]\\s*([0-9]+)\\s*[\\]］]"
_SIGN = "\U000f0003"


def entries(spark, sf_dir) -> DataFrame:
    """(stem, block_id, entry_no, number, entry): entries of reference lists; several "[n] ..." of one line are entries of their own. number: the one in front, or null."""
    d = _latest_blocks(spark, sf_dir, "stem", "section", "text_level", "text_plain").filter("section = 'references' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL")
    lines = F.transform(F.split("text_plain", "\\n+"), lambda p: F.trim(p))
    several = lambda p: F.split(F.regexp_replace(p, _MARK, f"{_SIGN}[$1]"), _SIGN)
    parts = F.flatten(F.transform(lines, lambda p: F.when(p.rlike(f"^.{{0,2}}{_MARK}"), several(p)).otherwise(F.array(p))))
    one = d.select("stem", "block_id", F.posexplode(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")).alias("entry_no", "entry"))
    return one.select("stem", "block_id", "entry_no", F.regexp_extract("entry", f"^{_MARK}", 1).try_cast("int").alias("number"), "entry")


_LINES = "list_transform(regexp_split_to_array(text_plain, '\\n+'), lambda p: trim(p, ' '))"
_ENTRIES_SQL = f"""
WITH r AS (SELECT stem, block_id, flatten(list_transform({_LINES}, lambda p: CASE WHEN regexp_matches(p, '^.{{0,2}}{_MARK}') THEN string_split(regexp_replace(p, '{_MARK}', '{_SIGN}[\\1]', 'g'), '{_SIGN}') ELSE [p] END)) AS ps
  FROM {_LATEST} WHERE section = 'references' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL),
q AS (SELECT stem, block_id, list_filter(list_transform(ps, lambda p: trim(p, ' ')), lambda p: p <> '') AS ps FROM r),
n AS (SELECT stem, block_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS entry_no, unnest(ps) AS entry FROM q),
e AS (SELECT stem, block_id, entry_no, TRY_CAST(regexp_extract(entry, '^{_MARK}', 1) AS INT) AS number, entry FROM n)
"""


@query(_ENTRIES_SQL + "SELECT * FROM e")
def g15_reference_entries(spark, sf_dir):
    return entries(spark, sf_dir)


@query(_ENTRIES_SQL + """, c AS (SELECT stem, count(*) AS n_entries FROM e GROUP BY stem), z AS (SELECT n_entries AS v, row_number() OVER (ORDER BY n_entries) - 1 AS k, count(*) OVER () AS n FROM c)
SELECT CAST(any_value(n) AS BIGINT) AS n, max(CASE WHEN k = round_even(0.25 * (n - 1), 0) THEN v END)::DOUBLE AS p25, max(CASE WHEN k = round_even(0.5 * (n - 1), 0) THEN v END)::DOUBLE AS median, max(CASE WHEN k = round_even(0.75 * (n - 1), 0) THEN v END)::DOUBLE AS p75 FROM z""")
def m_refcnt_51(spark, sf_dir):
    """References of a document, over all documents that have any: nearest-rank quantiles."""
    c = entries(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("v")).withColumn("one", F.lit(1))
    r = stats.ranked(c, ["one"], "v")
    total = r.groupBy("one").agg(F.sum("times").alias("n"))
    at = lambda p: F.max(F.when((F.col("below") <= F.bround(p * (F.col("n") - 1))) & (F.bround(p * (F.col("n") - 1)) < F.col("below") + F.col("times")), F.col("v"))).cast("double")
    return r.join(total, "one").agg(F.max("n").alias("n"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"))


@query(_ENTRIES_SQL + """, k AS (SELECT stem, number, lag(number) OVER (PARTITION BY stem ORDER BY block_id, entry_no) AS before, count(*) OVER (PARTITION BY stem, number) AS times FROM e WHERE number IS NOT NULL)
SELECT stem, number, CASE WHEN times > 1 THEN 'duplicate' WHEN before IS NULL AND number <> 1 THEN 'start' WHEN number <> before + 1 THEN 'discontinuity' END AS problem, count(*) AS n FROM k
WHERE times > 1 OR (before IS NULL AND number <> 1) OR number <> before + 1 GROUP BY ALL""")
def w08_reference_numbering(spark, sf_dir):
    """Reference lists that start elsewhere than at 1, repeat a number or skip one, in block order."""
    e = entries(spark, sf_dir).filter("number IS NOT NULL")
    k = e.withColumns({"before": F.lag("number").over(Window.partitionBy("stem").orderBy("block_id", "entry_no")), "times": F.count("*").over(Window.partitionBy("stem", "number"))})
    problem = F.when(F.col("times") > 1, "duplicate").when(F.col("before").isNull() & (F.col("number") != 1), "start").when(F.col("number") != F.col("before") + 1, "discontinuity")
    return k.select("stem", "number", problem.alias("problem")).filter("problem IS NOT NULL").groupBy("stem", "number", "problem").agg(F.count("*").alias("n"))


_BRACKET = "[\\[［]([0-9][0-9,，\\s–-]*)[\\]］]"


def citations(text: Column) -> Column:
    """array<struct<num, single>>: the numbers in brackets, ranges and lists expanded; single: alone in its brackets."""

    def parts(group: Column) -> Column:
        ps = F.filter(F.transform(F.split(group, "[,，]"), lambda p: F.trim(p)), lambda p: p != "")
        numbers = F.flatten(F.transform(ps, lambda p: F.when(p.rlike("^[0-9]{1,6}$"), F.array(p.cast("int"))).when(p.rlike("^[0-9]{1,6}\\s*[-–]\\s*[0-9]{1,6}$"), expand_range(p)).otherwise(F.array().cast("array<int>"))))
        return F.transform(numbers, lambda x: F.struct(x.alias("num"), group.rlike("^[0-9]+\\s*$").alias("single")))

    return F.flatten(F.transform(F.regexp_extract_all(_folded(text), F.lit(_BRACKET), 1), parts))


_CITED_SQL = f"""
SELECT stem, g, regexp_matches(g, '^[0-9]+\\s*$') AS single, CAST(unnest(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(g, '[,，]'), lambda p: trim(p)), lambda p: p <> ''),
  lambda p: CASE WHEN regexp_matches(p, '^[0-9]{{1,6}}$') THEN [CAST(p AS BIGINT)] WHEN regexp_matches(p, '^[0-9]{{1,6}}\\s*[-–]\\s*[0-9]{{1,6}}$') THEN {_expand_sql('p')} ELSE [] END))) AS INT) AS num
FROM (SELECT stem, unnest(regexp_extract_all({_FOLD.format('text_plain')}, '{_BRACKET}', 1)) AS g FROM {_BODY_BLOCKS_SQL})"""


@query(_ENTRIES_SQL + f""", c AS (SELECT stem, count(*) AS n_entries FROM e GROUP BY stem), t AS ({_CITED_SQL}), k AS (SELECT DISTINCT t.stem, num FROM t JOIN c ON t.stem = c.stem WHERE single OR num BETWEEN 1 AND n_entries)
SELECT c.stem, n_entries, count(num) AS cited, count(*) FILTER (num > n_entries) AS dangling, n_entries - count(*) FILTER (num BETWEEN 1 AND n_entries) AS uncited,
  CASE WHEN count(num) > 0 THEN round(count(*) FILTER (num BETWEEN 1 AND n_entries)::DOUBLE / (n_entries + count(*) FILTER (num < 1 OR num > n_entries)), 6) END AS m_reflink_54
FROM c LEFT JOIN k ON c.stem = k.stem GROUP BY c.stem, n_entries""")
def m_reflink_54(spark, sf_dir):
    """Citations against the reference list: |cited and listed| by |cited or listed|, null without numeric citations. In lists and ranges only numbers of the list count as citations."""
    c = entries(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("n_entries"))
    t = _body(spark, sf_dir).select("stem", F.explode(citations(F.col("text_plain"))).alias("x")).select("stem", "x.num", "x.single").distinct()
    k = t.join(c, "stem").filter(F.col("single") | F.col("num").between(1, F.col("n_entries"))).select("stem", "num").distinct()
    inside = F.col("num").between(1, F.col("n_entries"))
    hit = F.count_if(F.coalesce(inside, F.lit(False)))
    a = c.join(k, "stem", "left").groupBy("stem", "n_entries").agg(F.count("num").alias("cited"), F.count_if(F.col("num") > F.col("n_entries")).alias("dangling"), hit.alias("hit"), F.count_if(F.coalesce(~inside, F.lit(False))).alias("outside"))
    return a.select("stem", "n_entries", "cited", "dangling", (F.col("n_entries") - F.col("hit")).alias("uncited"), F.when(F.col("cited") > 0, round6(safe_div(F.col("hit"), F.col("n_entries") + F.col("outside")))).alias("m_reflink_54"))
