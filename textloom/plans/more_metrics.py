"""Token offsets, strata for spot checks, divergence of abstracts, lexicon concentration, block words, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import adapters as A
from textloom.functions import lexical as L
from textloom.functions import lexicon as X
from textloom.functions.text import let, running_starts
from textloom.operators import prose as P
from textloom.plans.core import _LATEST, _latest_blocks, query
from textloom.plans.prose_metrics import _ADJECTIVE, _PASSIVE, _SPACED_SQL, AUXILIARIES, SENTENCES_SQL, _or, _sentences
from textloom.session import round6, safe_div, table

_PIECES = "[A-Za-z][A-Za-z'\\-]*|[^A-Za-z]+"


@query("""
WITH p AS (SELECT clause_id, text, regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*|[^A-Za-z]+') AS ps FROM (SELECT DISTINCT clause_id, text FROM clause_spans WHERE text IS NOT NULL)),
u AS (SELECT clause_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p), o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY clause_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM u)
SELECT clause_id, lower(piece) AS token, CAST(pos AS INT) AS start_pos, CAST(pos + length(piece) AS INT) AS end_pos FROM o WHERE regexp_matches(piece, '^[A-Za-z]')""")
def g02_token_spans(spark, sf_dir):
    """Tokens with their offsets: the text falls into tokens and what is between them, whose lengths add up to the offsets. No window, no function of Python."""

    def spans(pieces):
        return let(running_starts(F.transform(pieces, F.length)), lambda at: F.array_compact(F.transform(pieces, lambda p, i: F.when(p.rlike("^[A-Za-z]"), F.struct(F.lower(p).alias("token"), F.get(at, i).alias("start_pos"), (F.get(at, i) + F.length(p)).alias("end_pos"))))))

    d = table(spark, sf_dir, "clause_spans").filter("text IS NOT NULL").select("clause_id", "text").distinct()
    return d.select("clause_id", F.inline(let(F.regexp_extract_all("text", F.lit(_PIECES), 0), spans)))


@query(SENTENCES_SQL + f""", v AS (SELECT doc_id, sentence_index, {_SPACED_SQL} AS t FROM s WHERE language = 'en')
SELECT doc_id, sentence_index, CASE WHEN regexp_matches(regexp_replace(t, '{_ADJECTIVE}', ' # ', 'g'), '{_PASSIVE}') THEN 'positive' WHEN regexp_matches(t, ' (?:{_or(AUXILIARIES)}) ') THEN 'boundary' WHEN len(string_split(trim(t), '  ')) >= 6 THEN 'plain' ELSE 'short' END AS stratum FROM v""")
def d37_spotcheck_strata(spark, sf_dir):
    """English sentences by what a spot check of the passive asks: positive, boundary (an auxiliary without participle), plain (six tokens or more), short."""
    t = F.col("t")
    stratum = F.when(F.regexp_replace(t, _ADJECTIVE, " # ").rlike(_PASSIVE.replace("''", "'")), "positive").when(t.rlike(f" (?:{_or(AUXILIARIES)}) "), "boundary").when(F.size(F.split(F.trim(t), "  ")) >= 6, "plain").otherwise("short")
    return _sentences(spark, sf_dir).filter("language = 'en'").select("doc_id", "sentence_index", P.spaced_tokens(F.col("sentence")).alias("t")).select("doc_id", "sentence_index", stratum.alias("stratum"))


_TOK = "[A-Za-z][A-Za-z''\\-]*"
_SPACED_BLOCK = f"' ' || array_to_string(list_transform(regexp_extract_all(text_plain, '{_TOK}'), lambda x: lower(x)), '  ') || ' '"
_HEDGE, _BOOST = (P.phrase_pattern(X.built_in()["en", n, ""]) for n in ("hedge", "booster"))


def _divergence_sql(name: str, empty_body: str) -> str:
    a, b = f"{name}_a::DOUBLE / nullif(tok_a, 0)", f"{name}_b::DOUBLE / nullif(tok_b, 0)"
    return f"CASE WHEN tok_a > 0 AND tok_b > 0 THEN CASE WHEN {name}_b = 0 THEN CASE WHEN {name}_a = 0 THEN 1.0 ELSE {empty_body} END ELSE round(({a}) / ({b}), 4) END END"


@query(f"""
WITH t AS (SELECT stem, section = 'abstract' AS a, {_SPACED_BLOCK} AS t FROM {_LATEST} WHERE kind = 'prose' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL AND section IN ('abstract', 'introduction', 'related_work', 'method', 'experiments', 'results', 'discussion', 'conclusion')),
h AS (SELECT stem, a, len(regexp_extract_all(t, '{_TOK}')) AS tok, len(regexp_extract_all(t, '{_HEDGE}')) AS h, len(regexp_extract_all(t, '{_BOOST}')) AS b FROM t),
g AS (SELECT stem, coalesce(sum(tok) FILTER (a), 0) AS tok_a, coalesce(sum(tok) FILTER (NOT a), 0) AS tok_b, coalesce(sum(h) FILTER (a), 0) AS h_a, coalesce(sum(h) FILTER (NOT a), 0) AS h_b, coalesce(sum(b) FILTER (a), 0) AS b_a, coalesce(sum(b) FILTER (NOT a), 0) AS b_b FROM h GROUP BY stem)
SELECT stem, {_divergence_sql('b', '999.0')} AS booster_ratio, {_divergence_sql('h', '0.0')} AS hedge_ratio FROM g WHERE tok_a > 0""")
def d33_abstract_divergence(spark, sf_dir):
    """Boosters and hedges by tokens of the abstract against the body's. A body without any: 1 if the abstract has none either, else 999 for boosters, 0 for hedges."""
    body = ("introduction", "related_work", "method", "experiments", "results", "discussion", "conclusion")
    d = _latest_blocks(spark, sf_dir, "stem", "kind", "text_level", "text_plain", "section").filter("kind = 'prose' AND text_level IS NULL AND text_plain IS NOT NULL AND stem IS NOT NULL").filter(F.col("section").isin("abstract", *body))
    t = d.select("stem", (F.col("section") == "abstract").alias("a"), P.spaced_tokens(F.col("text_plain")).alias("t"))
    h = t.select("stem", "a", F.regexp_count("t", F.lit(L.TOKEN)).alias("tok"), F.regexp_count("t", F.lit(_HEDGE)).alias("h"), F.regexp_count("t", F.lit(_BOOST)).alias("b"))
    part = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    g = h.groupBy("stem").agg(*[part(c, F.col("a") if s == "a" else ~F.col("a")).alias(f"{c}_{s}") for c in ("tok", "h", "b") for s in "ab"])

    def ratio(n: str, empty_body: float):
        share = lambda s: safe_div(F.col(f"{n}_{s}"), F.col(f"tok_{s}"))
        none = F.when(F.col(f"{n}_a") == 0, 1.0).otherwise(empty_body)
        return F.when((F.col("tok_a") > 0) & (F.col("tok_b") > 0), F.when(F.col(f"{n}_b") == 0, none).otherwise(F.round(share("a") / share("b"), 4)))

    return g.filter("tok_a > 0").select("stem", ratio("b", 999.0).alias("booster_ratio"), ratio("h", 0.0).alias("hedge_ratio"))


_WORDS = ", ".join(f"('{g}', '{w}')" for g, ws in L.LEXICON.items() for w in ws)


@query(f"""
WITH x(grp, entry) AS (VALUES {_WORDS}), t AS (SELECT unnest(list_transform(regexp_extract_all(text, '{_TOK}'), lambda y: lower(y))) AS entry FROM documents WHERE text IS NOT NULL), h AS (SELECT entry, count(*) AS n FROM t GROUP BY entry),
c AS (SELECT grp, x.entry, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY grp ORDER BY coalesce(n, 0) DESC, x.entry) AS r, count(*) OVER (PARTITION BY grp) AS k FROM x LEFT JOIN h ON x.entry = h.entry)
SELECT grp, count(*) AS entries, CAST(sum(n) AS BIGINT) AS hits, round(sum(CASE WHEN r <= greatest(1, ceil(0.2 * k)) THEN n ELSE 0 END)::DOUBLE / nullif(sum(n), 0), 6) AS top_share FROM c GROUP BY grp""")
def d15_lexicon_concentration(spark, sf_dir):
    """How much of a group's hits its most frequent fifth of entries has: words outside the lexicon, of fixed size, are dropped before the shuffle."""
    x = spark.createDataFrame([(g, w) for g, ws in L.LEXICON.items() for w in ws], "grp string, entry string")
    h = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.explode(L.of_lexicon(L.tokens(F.col("text")))).alias("entry")).groupBy("entry").agg(F.count("*").alias("n"))
    c = x.join(h, "entry", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("grp")
    c = c.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "entry")), "k": F.count("*").over(w)})
    top = F.sum(F.when(F.col("r") <= F.greatest(F.lit(1), F.ceil(0.2 * F.col("k"))), F.col("n")).otherwise(0))
    return c.groupBy("grp").agg(F.count("*").alias("entries"), F.sum("n").alias("hits"), round6(safe_div(top, F.sum("n"))).alias("top_share"))


_STRIPPED = "regexp_replace(table_body, '<[^>]*>', ' ', 'g')"
_SIZE = lambda e: f"len(list_filter(regexp_split_to_array({e}, '\\s+'), lambda x: x <> ''))"


@query(f"SELECT block_id, kind, CAST(CASE WHEN kind = 'equations' THEN 1 WHEN kind = 'tables' THEN coalesce({_SIZE(_STRIPPED)}, 0) ELSE coalesce({_SIZE('text_plain')}, 0) END AS INT) AS words FROM {_LATEST}")
def b12_block_words(spark, sf_dir):
    """Words of a block: an equation is one, a table's tags are none."""
    size = lambda c: F.coalesce(F.size(F.filter(F.split(c, "\\s+"), lambda x: x != "")), F.lit(0))
    d = _latest_blocks(spark, sf_dir, "kind", "text_plain", "table_body")
    body = F.regexp_replace("table_body", "<[^>]*>", " ")
    words = F.when(F.col("kind") == "equations", 1).when(F.col("kind") == "tables", F.when(body.isNull(), 0).otherwise(size(body))).otherwise(F.when(F.col("text_plain").isNull(), 0).otherwise(size(F.col("text_plain"))))
    return d.select("block_id", "kind", words.alias("words"))


@query(f"""
SELECT block_id, trim(regexp_replace(regexp_replace(regexp_replace(text_plain, '\\\\[a-zA-Z]+', ' ', 'g'), '[{{}}$^_&~\\\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM {_LATEST} WHERE kind = 'equations' AND text_plain IS NOT NULL""")
def b16_latex_to_text(spark, sf_dir):
    d = _latest_blocks(spark, sf_dir, "kind", "text_plain").filter("kind = 'equations' AND text_plain IS NOT NULL")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text_plain", "\\\\[a-zA-Z]+", " "), "[{}$^_&~\\\\]", " "), "\\s+", " ")
    return d.select("block_id", F.trim(t).alias("text"))


@query(f"""
WITH d AS (SELECT doc_id, text, CASE WHEN len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]')) > 0.1 * (len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]')) + len(regexp_extract_all(text, '{_TOK}'))) THEN 'zh'
  WHEN len(regexp_extract_all(text, '{_TOK}')) > 0 THEN 'en' ELSE 'unknown' END AS language FROM documents WHERE text IS NOT NULL)
SELECT doc_id, language, 'units' AS metric, CASE language WHEN 'zh' THEN len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]')) + len(regexp_extract_all(text, '{_TOK}')) WHEN 'en' THEN len(regexp_extract_all(text, '{_TOK}')) END::DOUBLE AS value FROM d
UNION ALL SELECT doc_id, language, 'hedges', CASE language WHEN 'zh' THEN len(regexp_extract_all(text, '{P.phrase_pattern(X.built_in()['zh', 'hedge', ''], spaced=False)}')) WHEN 'en' THEN len(regexp_extract_all({_SPACED_BLOCK.replace('text_plain', 'text')}, '{_HEDGE}')) END::DOUBLE FROM d""")
def d39_metric_dispatch(spark, sf_dir):
    """Metrics by the adapter of each text's language; all metrics are there for all texts, null where a language has no adapter."""
    lexicon = X.built_in()
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")

    def hedges(a: A.Adapter, t: F.Column) -> F.Column:
        return F.when(F.col("language") == "zh", a.hits(t, lexicon["zh", "hedge", ""])).otherwise(a.hits(t, lexicon["en", "hedge", ""]))

    return A.measure(d, "doc_id", "text", {"units": lambda a, t: a.units(t), "hedges": hedges})
