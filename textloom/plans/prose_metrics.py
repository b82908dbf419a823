"""Writing metrics over sentences, clauses and phrases of documents, with the SQL that gives the same result.

The SQL has no look-behind: it judges every stop by the characters around it, one row a stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexical as L
from textloom.functions import lexicon as X
from textloom.operators import prose as P
from textloom.plans.core import query
from textloom.session import round6, safe_div, table

_T = "[A-Za-z][A-Za-z''\\-]*"
_C = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]"
_WS = P._SPACE.replace("\\s", "\\s\\x{0b}")
_CL = P._CLOSERS.replace("'", "''")


def _blank(expr: str, pattern: str, rest: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({expr}, '{pattern}|{rest}'), lambda x: CASE WHEN regexp_full_match(x, '{pattern}') THEN repeat(' ', length(x)) ELSE x END), '')"


def _masked(expr: str) -> str:
    expr = _blank(expr, P.KEYWORD_LINE, "[^\\n]+|\\n")
    for pattern, rest in P.NOT_PROSE:
        expr = _blank(expr, pattern, rest)
    return expr


_SHORT = ", ".join(f"'{a}'" for a in P.ABBREVIATIONS.split())
#: s: (doc_id, language, sentence_index, start_pos, end_pos, sentence).
SENTENCES_SQL = f"""
WITH d AS (SELECT doc_id, text, {_masked('text')} AS m FROM documents WHERE text IS NOT NULL),
ch AS (SELECT doc_id, unnest(string_split(m, '')) AS c, generate_subscripts(string_split(m, ''), 1) AS i FROM d WHERE m <> ''),
st AS (SELECT ch.doc_id, c, i, substr(m, greatest(1, i - 96), least(96, i - 1)) AS lft, substr(m, i + 1, 96) AS rgt FROM ch JOIN d USING (doc_id) WHERE c IN ('.', '!', '?', '。', '！', '？', '…')),
w AS (SELECT *, regexp_extract(lft, '[A-Za-z]+(?:[.][A-Za-z]+)*$') AS word, right(lft, 1) AS prv, left(rgt, 1) AS nxt, regexp_matches(rgt, '^{_CL}*({_WS}|$)') AS free FROM st),
b AS (SELECT doc_id, i, CASE
  WHEN c IN ('!', '?') THEN CASE WHEN free THEN i END
  WHEN c = '.' AND free AND lower(word) NOT IN ({_SHORT}) AND NOT (regexp_full_match(word, '[A-Z]') AND regexp_matches(rgt, '^[ \\t]+[A-Z][A-Za-z.]'))
    AND NOT regexp_matches(lft, '(^|\\n){_WS}*\\p{{Nd}}{{1,3}}$') AND NOT regexp_matches(rgt, '^{_CL}*[ \\t\\f\\x0B]*\\p{{Ll}}') THEN i
  WHEN (c <> '.' OR NOT (regexp_matches(prv, '[\\p{{Nd}}A-Za-z]') OR regexp_matches(nxt, '[\\p{{Nd}}A-Za-z]'))) AND nxt NOT IN ('。', '！', '？', '…', '.')
    THEN i + length(regexp_extract(rgt, '^[{P.CJK_CLOSERS}]*')) END AS e FROM w),
e AS (SELECT doc_id, e FROM b WHERE e IS NOT NULL UNION SELECT doc_id, length(m) FROM d WHERE m <> ''),
p AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS a, e FROM e),
x AS (SELECT doc_id, a, substr(m, a + 1, e - a) AS piece, text FROM p JOIN d USING (doc_id)),
y AS (SELECT doc_id, text, a + length(piece) - length(regexp_replace(piece, '^{_WS}+', '')) AS s, length(regexp_replace(regexp_replace(piece, '^{_WS}+', ''), '{_WS}+$', '')) AS n
  FROM x WHERE regexp_matches(piece, '[A-Za-z]|{_C}')),
l AS (SELECT doc_id, len(regexp_extract_all(text, '{_C}')) AS cjk, len(regexp_extract_all(text, '{_T}')) AS tok FROM d),
s AS (SELECT y.doc_id, CASE WHEN cjk > 0.1 * (cjk + tok) THEN 'zh' WHEN tok > 0 THEN 'en' ELSE 'unknown' END AS language, CAST(row_number() OVER (PARTITION BY y.doc_id ORDER BY s) - 1 AS INT) AS sentence_index,
  CAST(s AS INT) AS start_pos, CAST(s + n AS INT) AS end_pos, substr(text, s + 1, n) AS sentence FROM y JOIN l USING (doc_id))
"""
_UNITS_SQL = f"CASE WHEN language = 'zh' THEN len(regexp_extract_all(sentence, '{_C}')) + len(regexp_extract_all(sentence, '{_T}')) ELSE len(regexp_extract_all(sentence, '{_T}')) END"
_SPACED_SQL = f"' ' || array_to_string(list_transform(regexp_extract_all(sentence, '{_T}'), lambda x: lower(x)), '  ') || ' '"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", L.detect_language(F.col("text")).alias("language"))
    return d.select("doc_id", "language", F.posexplode(P.sentences(F.col("text"))).alias("sentence_index", "_s")).select("doc_id", "language", "sentence_index", "_s.*")


def _units() -> F.Column:
    return F.when(F.col("language") == "zh", L.cjk_units(F.col("sentence"))).otherwise(F.regexp_count("sentence", F.lit(L.TOKEN)))


@query(SENTENCES_SQL + "SELECT * FROM s")
def g03_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


_Q = lambda q: f"round(quantile_cont(n, {q}), 6)"


@query(SENTENCES_SQL + f""", u AS (SELECT doc_id, language, {_UNITS_SQL} AS n FROM s WHERE language <> 'unknown')
SELECT doc_id, language, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS units, round(avg(n), 6) AS m_slen_01, round(stddev_pop(n), 6) AS sd, {_Q(0.25)} AS p25, {_Q(0.5)} AS median, {_Q(0.75)} AS p75,
  round(avg(CASE WHEN n >= (CASE WHEN language = 'zh' THEN 80 ELSE 40 END) THEN 1.0 ELSE 0.0 END), 6) AS m_lsf_16,
  CASE WHEN language = 'zh' THEN {_Q(0.9)} END AS m_slen_34, CASE WHEN language = 'zh' THEN {_Q(0.95)} END AS m_slen_35 FROM u GROUP BY doc_id, language""")
def m_sentence_length(spark, sf_dir):
    """Mean, spread, quantiles (linear) of sentence length, share of long sentences, and for Chinese the 90th and 95th percentiles."""
    u = _sentences(spark, sf_dir).filter("language <> 'unknown'").select("doc_id", "language", _units().alias("n"))
    q = F.percentile("n", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    long = F.avg(F.when(F.col("n") >= F.when(F.col("language") == "zh", 80).otherwise(40), 1.0).otherwise(0.0))
    a = u.groupBy("doc_id", "language").agg(F.count("*").alias("sentences"), F.sum("n").alias("units"), round6(F.avg("n")).alias("m_slen_01"), round6(F.stddev_pop("n")).alias("sd"), q.alias("q"), round6(long).alias("m_lsf_16"))
    zh = lambda c: F.when(F.col("language") == "zh", c)
    return a.select("doc_id", "language", "sentences", "units", "m_slen_01", "sd", *[round6(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "median", "p75"))], "m_lsf_16", round6(zh(F.col("q")[3])).alias("m_slen_34"), round6(zh(F.col("q")[4])).alias("m_slen_35"))


def _masked_brackets(expr: str) -> str:
    for _ in range(3):
        for a, b in P.PAIRS:
            a, b = (f"\\{x}" if x in "()" else x for x in (a, b))
            expr = f"list_transform([{expr}], lambda x: {_blank('x', f'{a}[^{a}{b}]*{b}', f'[^{a}]+|{a}')})[1]"
    return expr


#: Sentences with brackets go through the pairs one by one in a chain of subqueries, which keeps the SQL short.
def _clauses_sql() -> str:
    steps, name = [], "k0"
    steps.append(f"k0 AS (SELECT doc_id, sentence_index, sentence, {_masked('sentence')} AS k FROM s WHERE language = 'zh')")
    for i in range(3 * len(P.PAIRS)):
        a, b = (f"\\{x}" if x in "()" else x for x in P.PAIRS[i % len(P.PAIRS)])
        steps.append(f"k{i + 1} AS (SELECT doc_id, sentence_index, sentence, {_blank('k', f'{a}[^{a}{b}]*{b}', f'[^{a}]+|{a}')} AS k FROM {name})")
        name = f"k{i + 1}"
    steps.append(f"c AS (SELECT doc_id, sentence, len(list_filter(regexp_split_to_array(k, '[{P.SEPARATORS}]'), lambda x: regexp_matches(x, '[A-Za-z]|{_C}'))) AS n, len(regexp_extract_all(sentence, '{_C}')) + len(regexp_extract_all(sentence, '{_T}')) AS units FROM {name})")
    return SENTENCES_SQL + ", " + ",\n".join(steps)


_OPENERS = [e for (lang, name, _), es in X.built_in().items() if lang == "zh" and name == "connectors" for e in es]
_STARTS = " OR ".join(f"starts_with(sentence, '{e}')" for e in _OPENERS)


@query(_clauses_sql() + f"""
SELECT doc_id, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS clauses, round(avg(n), 6) AS m_cls_31, round(sum(units)::DOUBLE / nullif(sum(n), 0), 6) AS m_cls_32,
  round(avg(len(regexp_extract_all(sentence, '[{P.SEPARATORS}]'))), 6) AS m_spat_44, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS m_spat_45, round(avg(CASE WHEN {_STARTS} THEN 1.0 ELSE 0.0 END), 6) AS m_spat_46
FROM c GROUP BY doc_id""")
def m_clauses_zh(spark, sf_dir):
    """Clauses a sentence, units a clause, separators a sentence, share of sentences with several clauses and of those that a connector opens."""
    s = _sentences(spark, sf_dir).filter("language = 'zh'").select("doc_id", "sentence", P.clause_count(F.col("sentence")).alias("n"), L.cjk_units(F.col("sentence")).alias("units"))
    share = lambda c: round6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    opens = F.col("sentence").rlike("^" + P.phrase_pattern(_OPENERS, spaced=False))
    return s.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.sum("n").alias("clauses"), round6(F.avg("n")).alias("m_cls_31"), round6(safe_div(F.sum("units"), F.sum("n"))).alias("m_cls_32"),
        round6(F.avg(F.regexp_count("sentence", F.lit(f"[{P.SEPARATORS}]")))).alias("m_spat_44"), share(F.col("n") > 1).alias("m_spat_45"), share(opens).alias("m_spat_46"),
    )


def _list(entries: list[str]) -> str:
    return "[" + ", ".join(f"'{e}'" for e in entries) + "]"


@query(SENTENCES_SQL + f""", v AS (SELECT doc_id, len(list_filter({_list(X.built_in()['zh', 'booster', ''])}, lambda x: contains(sentence, x))) AS b, len(list_filter({_list(X.built_in()['zh', 'hedge', ''])}, lambda x: contains(sentence, x))) AS h FROM s WHERE language = 'zh')
SELECT doc_id, count(*) AS sentences, round(avg(CASE WHEN h > b THEN 1.0 ELSE 0.0 END), 6) AS m_stnc_41, round(avg(CASE WHEN b > h THEN 1.0 ELSE 0.0 END), 6) AS m_stnc_42, round(avg(CASE WHEN b = h THEN 1.0 ELSE 0.0 END), 6) AS m_stnc_43 FROM v GROUP BY doc_id""")
def m_stance_zh(spark, sf_dir):
    """Shares of hedging, boosting and assertive sentences: by which of the two lexicons has more distinct entries in a sentence."""
    lexicon = X.built_in()
    has = lambda name: F.size(F.filter(F.array(*map(F.lit, lexicon["zh", name, ""])), lambda e: F.contains(F.col("sentence"), e)))
    v = _sentences(spark, sf_dir).filter("language = 'zh'").select("doc_id", has("booster").alias("b"), has("hedge").alias("h"))
    share = lambda c: round6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    b, h = F.col("b"), F.col("h")
    return v.groupBy("doc_id").agg(F.count("*").alias("sentences"), share(h > b).alias("m_stnc_41"), share(b > h).alias("m_stnc_42"), share(b == h).alias("m_stnc_43"))


# ---- phrases of the lexicons


_GROUPS = [("hed_14", "hedge", ""), ("boo_15", "booster", ""), ("conn_30c", "connectors", "causal"), ("conn_30k", "connectors", "contrastive"), ("conn_30r", "connectors", "result"), ("awr_03", "academic_words", "")]


def _hits_sql() -> str:
    cols = []
    for out, name, grp in _GROUPS:
        en = P.phrase_pattern(X.built_in()["en", name, grp]).replace("'", "''")
        zh = P.phrase_pattern(X.built_in()["zh", name, grp], spaced=False)
        cols.append(f"len(regexp_extract_all(CASE WHEN language = 'zh' THEN z_{'c' if name == 'connectors' else 'a'} ELSE t END, CASE WHEN language = 'zh' THEN '{_zh_of(grp) if name == 'connectors' else zh}' ELSE '{en}' END)) AS {out}")
    return ", ".join(cols)


#: The groups of Chinese connectors are matched together: one private-use character for each group takes the place of its hits.
_ZH_GROUPS = ("causal", "contrastive", "result", "temporal", "condition")
_zh_of = lambda g: chr(0xE100 + _ZH_GROUPS.index(g))


def _zh_connectors(lexicon: X.Lexicon) -> list[tuple[str, str]]:
    """(entry, sign of its group), the longest first: replaced in this order, a shorter entry is never found inside a longer one."""
    pairs = [(e, _zh_of(g)) for g in _ZH_GROUPS for e in lexicon.get(("zh", "connectors", g), [])]
    return sorted(pairs, key=lambda p: (-len(p[0]), p[0]))


def _replaced_sql(expr: str) -> str:
    for e, sign in _zh_connectors(X.built_in()):
        expr = f"replace({expr}, '{e}', '{sign}')"
    return expr


@query(SENTENCES_SQL + f""", lp AS (SELECT doc_id, language, {_UNITS_SQL} AS units, {_SPACED_SQL} AS t, sentence AS z_a, {_replaced_sql('sentence')} AS z_c FROM s WHERE language <> 'unknown'),
h AS (SELECT doc_id, language, units, {_hits_sql()}, CASE WHEN language = 'zh' THEN len(regexp_extract_all(z_c, '{_zh_of('temporal')}')) END AS conn_30t, CASE WHEN language = 'zh' THEN len(regexp_extract_all(z_c, '{_zh_of('condition')}')) END AS conn_30q FROM lp),
g AS (SELECT doc_id, language, sum(units)::DOUBLE AS u, {', '.join(f'sum({c}) AS {c}' for c in [g[0] for g in _GROUPS] + ['conn_30t', 'conn_30q'])} FROM h GROUP BY doc_id, language)
SELECT doc_id, language, CAST(u AS BIGINT) AS units, {', '.join(f"round({c}{' * 1000' if 'conn' in c else ''} / nullif(u, 0), 6) AS m_{c}" for c in [g[0] for g in _GROUPS] + ['conn_30t', 'conn_30q'])},
  round(round(conn_30c * 1000 / nullif(u, 0), 6) + round(conn_30k * 1000 / nullif(u, 0), 6) + round(conn_30r * 1000 / nullif(u, 0), 6), 6) AS m_conn_30 FROM g""")
def m_lexicon_phrases(spark, sf_dir):
    return lexicon_phrases(_sentences(spark, sf_dir), X.built_in())


def lexicon_phrases(sentences: DataFrame, lexicon: X.Lexicon) -> DataFrame:
    """Hits of hedges, boosters, connectors and academic words, by tokens (en) or units (zh); connectors by thousand, their total the sum of the three rounded parts.

    English groups are matched each on its own, the longest phrase at each place; Chinese connectors all together. sentences: doc_id, language, sentence.
    """
    d = sentences.filter("language <> 'unknown'").withColumn("units", _units()).withColumn("t", P.spaced_tokens(F.col("sentence")))
    z = F.col("sentence")
    for e, sign in _zh_connectors(lexicon):
        z = F.replace(z, F.lit(e), F.lit(sign))
    d = d.withColumn("z", F.when(F.col("language") == "zh", z))
    is_zh, count = F.col("language") == "zh", lambda c, p: F.regexp_count(c, F.lit(p))
    hits = {}
    for out, name, grp in _GROUPS:
        en = P.phrase_count(F.col("t"), lexicon.get(("en", name, grp), []))
        zh = count("z", _zh_of(grp)) if name == "connectors" else P.phrase_count(F.col("sentence"), lexicon.get(("zh", name, grp), []), spaced=False)
        hits[out] = F.when(is_zh, zh).otherwise(en)
    hits |= {f"conn_30{k}": F.when(is_zh, count("z", _zh_of(g))) for k, g in (("t", "temporal"), ("q", "condition"))}
    a = d.groupBy("doc_id", "language").agg(F.sum("units").alias("units"), *[F.sum(c).alias(n) for n, c in hits.items()])
    rate = lambda n: round6(safe_div(F.col(n) * (1000 if "conn" in n else 1), F.col("units")))
    total = round6(rate("conn_30c") + rate("conn_30k") + rate("conn_30r"))
    return a.select("doc_id", "language", "units", *[rate(n).alias(f"m_{n}") for n in hits], total.alias("m_conn_30"))


# ---- voice and nominalisation

#: Auxiliaries of the passive, adverbs that may stand between, participles without -ed, and forms in -ed that are adjectives.
AUXILIARIES = "be am is are was were been being get gets got gotten become becomes became"
ADVERBS = "not never also often already widely commonly frequently generally usually typically currently recently then further finally only still just well fully partially directly indirectly explicitly implicitly successfully automatically manually carefully quickly gradually previously systematically significantly substantially largely mainly closely highly rapidly slowly exactly almost nearly always sometimes rarely simply thus hence therefore first now soon later easily consistently correctly"
PARTICIPLES = "built known given shown made taken seen found done written chosen driven drawn held kept left lost met paid put read said sent set sold spent taught told thought understood won worn brought bought caught felt grown heard hidden laid led meant run split spread stuck thrown"
ADJECTIVES = "related limited based detailed advanced complicated sophisticated dedicated biased unbiased aforementioned nested oriented sized tired interested excited involved concerned satisfied surprised pleased worried committed equipped skilled crowded damaged unexpected"
_or = lambda words: "|".join(words.split())
_ADJECTIVE = f" (?:{_or(ADJECTIVES)}) "
_PASSIVE = f" (?:{_or(AUXILIARIES)}) (?: (?:{_or(ADVERBS)}) ){{0,2}} (?:{_or(PARTICIPLES)}|[a-z][a-z''\\-]+ed) "
#: Marks of the Chinese passive; suffixes of abstract nouns.
ZH_PASSIVE, ZH_NOUN = "(?:受到|得到|加以|予以|被)", "[性度率]"


@query(SENTENCES_SQL + f""", v AS (SELECT doc_id, language, {_UNITS_SQL} AS units, sentence, regexp_replace({_SPACED_SQL}, '{_ADJECTIVE}', ' # ', 'g') AS t FROM s WHERE language <> 'unknown'),
h AS (SELECT doc_id, language, units, CASE WHEN language = 'en' THEN CAST(regexp_matches(t, '{_PASSIVE}') AS INT) ELSE len(regexp_extract_all(sentence, '{ZH_PASSIVE}{_C}')) END AS p,
  CASE WHEN language = 'zh' THEN len(regexp_extract_all(regexp_replace(sentence, '({_C}){ZH_NOUN}', '\\1' || chr(57600), 'g') , chr(57600))) + len(regexp_extract_all(regexp_replace(sentence, '({_C}){ZH_NOUN}', '\\1' || chr(57600), 'g'), chr(57600) || '{ZH_NOUN}')) END AS q FROM v)
SELECT doc_id, language, count(*) AS sentences, CAST(sum(p) AS BIGINT) AS passives, round(sum(p)::DOUBLE / count(*), 6) AS m_pas_09, round(sum(q) * 1000.0::DOUBLE / nullif(sum(units), 0), 6) AS m_nom_10 FROM h GROUP BY doc_id, language""")
def m_voice(spark, sf_dir):
    """Passive sentences by sentences (en: an auxiliary, up to two adverbs, a participle) or passive phrases by sentences (zh), and Chinese abstract nouns by 1000 units."""
    d = _sentences(spark, sf_dir).filter("language <> 'unknown'").withColumn("units", _units())
    t = F.regexp_replace(P.spaced_tokens(F.col("sentence")), _ADJECTIVE, " # ")
    p = F.when(F.col("language") == "en", t.rlike(_PASSIVE.replace("''", "'")).cast("int")).otherwise(F.regexp_count("sentence", F.lit(f"{ZH_PASSIVE}(?={L.CJK})")))
    q = F.when(F.col("language") == "zh", F.regexp_count("sentence", F.lit(f"(?<={L.CJK}){ZH_NOUN}")))
    a = d.groupBy("doc_id", "language").agg(F.count("*").alias("sentences"), F.sum(p).alias("passives"), F.sum(q).alias("q"), F.sum("units").alias("u"))
    return a.select("doc_id", "language", "sentences", "passives", round6(safe_div(F.col("passives"), F.col("sentences"))).alias("m_pas_09"), round6(safe_div(F.col("q") * 1000, F.col("u"))).alias("m_nom_10"))


#: Own small lists of suffixes, of verbs they are put to, and of words that only look like it.
SUFFIXES = "ation tion sion ment ance ence al".split()
VERBS = "measure estimate calibrate represent describe recognize transform segment align improve agree assess evaluate apply differ refer perform transcribe convert simulate normalize optimise annotate collect reduce validate propose translate abstract evaluate regress correct".split()
NOT_NOUNS = "final total moment element section station".split()


def _array_sql(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_STEMS_SQL = f"""
t AS (SELECT DISTINCT token FROM k), v AS (SELECT token, token AS v, 0 AS ord FROM t UNION ALL SELECT token, CASE WHEN ends_with(token, 'ies') AND length(token) > 4 THEN left(token, -3) || 'y' WHEN ends_with(token, 'es') AND length(token) > 3 THEN left(token, -2)
  WHEN ends_with(token, 's') AND length(token) > 3 THEN left(token, -1) END, 1 FROM t),
sx AS (SELECT token, v, ord, left(v, -length(s)) AS st FROM v, (SELECT unnest({_array_sql(SUFFIXES)}) AS s) WHERE v IS NOT NULL AND ends_with(v, s) AND length(v) > length(s)),
c AS (SELECT token, ord, unnest([st, st || 'e', st || 'y', st || 'te', st || 'ate', st || 'de', st || 't'] || CASE WHEN right(st, 1) IN ('a','e','i','o','u') THEN [left(st, -1), left(st, -1) || 'e', left(st, -1) || 'y'] ELSE [] END
  || CASE WHEN ends_with(st, 'ica') AND length(st) > 3 THEN [left(st, -3) || 'y'] ELSE [] END || CASE WHEN right(st, 1) IN ('p', 'b') AND length(st) > 1 THEN [left(st, -1) || 'be'] ELSE [] END || CASE WHEN right(st, 1) = 'i' THEN [st || 'ze'] ELSE [] END) AS verb FROM sx),
bad AS (SELECT token, min(ord) AS ord FROM v WHERE list_contains({_array_sql(NOT_NOUNS)}, v) GROUP BY token),
n AS (SELECT DISTINCT c.token FROM c LEFT JOIN bad ON c.token = bad.token WHERE list_contains({_array_sql(VERBS)}, verb) AND (bad.ord IS NULL OR c.ord < bad.ord))
"""


@query(SENTENCES_SQL + f""", k AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(sentence, '{_T}'), lambda y: lower(y))) AS token FROM s WHERE language = 'en'), {_STEMS_SQL}
SELECT doc_id, count(*) AS tokens, count(n.token) AS nominalizations, round(count(n.token)::DOUBLE / count(*), 6) AS m_nom_10 FROM k LEFT JOIN n ON k.token = n.token GROUP BY doc_id""")
def m_nom_10_en(spark, sf_dir):
    """Nouns made of verbs by a suffix, by tokens. Words are judged once each; tokens are counted by document and word before they meet the verdicts."""
    s = _sentences(spark, sf_dir).filter("language = 'en'")
    k = s.select("doc_id", F.explode(F.transform(F.regexp_extract_all("sentence", F.lit(L.TOKEN), 0), F.lower)).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("times"))
    n = nominalizations(k.select("token").distinct(), SUFFIXES, VERBS, NOT_NOUNS).withColumn("hit", F.lit(1))
    a = k.join(n, "token", "left").groupBy("doc_id").agg(F.sum("times").alias("tokens"), F.coalesce(F.sum(F.col("times") * F.col("hit")), F.lit(0)).alias("nominalizations"))
    return a.withColumn("m_nom_10", round6(safe_div(F.col("nominalizations"), F.col("tokens"))))


def nominalizations(tokens: DataFrame, suffixes: list[str], verbs: list[str], not_nouns: list[str]) -> DataFrame:
    """The distinct tokens that, themselves or as a singular, are a verb with a suffix; a form that is no such noun ends the search."""
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    t = F.col("token")
    singular = F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(cut(t, 3), F.lit("y"))).when(t.endswith("es") & (F.length(t) > 3), cut(t, 2)).when(t.endswith("s") & (F.length(t) > 3), cut(t, 1))

    def candidates(s: F.Column) -> F.Column:
        add = lambda c, e: F.concat(c, F.lit(e))
        none = F.array().cast("array<string>")
        return F.concat(
            F.array(s, *[add(s, e) for e in ("e", "y", "te", "ate", "de", "t")]), F.when(s.rlike("[aeiou]$"), F.array(cut(s, 1), add(cut(s, 1), "e"), add(cut(s, 1), "y"))).otherwise(none),
            F.when(s.rlike(".ica$"), F.array(add(cut(s, 3), "y"))).otherwise(none), F.when(s.rlike(".[pb]$"), F.array(add(cut(s, 1), "be"))).otherwise(none), F.when(s.endswith("i"), F.array(add(s, "ze"))).otherwise(none),
        )

    known = F.array(*map(F.lit, verbs))

    def made(v: F.Column) -> F.Column:
        stems = F.filter(F.array(*[F.when(v.endswith(x) & (F.length(v) > len(x)), cut(v, len(x))) for x in suffixes]), lambda s: s.isNotNull())
        return F.exists(stems, lambda s: F.arrays_overlap(candidates(s), known))

    bad = lambda v: v.isin(not_nouns)
    one = F.col("singular")
    hit = ~bad(t) & (made(t) | F.coalesce(~bad(one) & made(one), F.lit(False)))
    return tokens.withColumn("singular", singular).filter(hit).select("token")
