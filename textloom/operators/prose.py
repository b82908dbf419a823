"""Sentences, clauses and phrases of English and Chinese prose, as the writing metrics count them.

Sentence ends are marked by one regular expression over a masked copy of the text, in which what is no prose (keyword
lines, formulas, sub- and superscript tags) is blank, one for one. All of it is SQL expressions: one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.lexical import CJK, TOKEN
from textloom.functions.text import blank_out, let, over_pieces

MARK = "\U000f0001"
#: What is no prose, and what may stand between such passages.
KEYWORD_LINE = "(?im)^[ \\t]*(?:keywords?|key[ \\t]+words|关键词|关键字|主題詞|主题词)[ \\t]*[:：][^\\n]*"
NOT_PROSE = (
    ("\\$\\$[^$\\n]*\\$\\$", "[^$]+|\\$"),
    ("\\$[^$\\n]*\\$", "[^$]+|\\$"),
    ("</?(?:[sS][uU][bB]|[sS][uU][pP])\\b[^>]*>", "[^<]+|<"),
)
#: Abbreviations whose stop ends no sentence.
ABBREVIATIONS = (
    "al etc fig figs eq eqs vs cf cmp approx no nos sec secs ref refs i.e e.g u.s u.k e.u ph.d m.s b.s dr prof mr mrs ms st jr sr inc ltd co corp dept univ vol vols pp p ch chap app appendix "
    "min max avg est resp ibid viz seq alii jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun"
)
_SPACE = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_CLOSERS = "[\"')\\]}»”’]"
CJK_STOPS, CJK_CLOSERS = "。！？…", "」』】》）＞〉"
LETTER = "[A-Za-z]|" + CJK


def sentence_end() -> str:
    """Matches a stop that ends a sentence, with what of its closing signs belongs to it."""
    short = "|".join(sorted((a.replace(".", "[.]") for a in ABBREVIATIONS.split()), key=lambda a: (-len(a), a)))
    word = "(?<![A-Za-z])(?<![A-Za-z][.])"
    plain = (
        f"[.](?<!{word}(?i:{short})[.])(?!(?<={word}[A-Z][.])[ \\t]+[A-Z][A-Za-z.])(?<!(?:^|\\n){_SPACE}{{0,90}}\\p{{Nd}}{{1,3}}[.])"
        f"(?={_CLOSERS}*+(?:{_SPACE}|\\z))(?!{_CLOSERS}*+[ \\t\\f\\x0B]*+\\p{{Ll}})"
    )
    other = f"[!?](?={_CLOSERS}*+(?:{_SPACE}|\\z))"
    cjk = f"(?:[{CJK_STOPS}]|[.](?<![\\p{{Nd}}A-Za-z][.])(?![\\p{{Nd}}A-Za-z]))(?![{CJK_STOPS}.])[{CJK_CLOSERS}]*+"
    return f"{plain}|{other}|{cjk}"


def _blank_if(text: Column, pattern: str, rest: str) -> Column:
    return let(text, lambda t: F.when(t.rlike(pattern), blank_out(t, pattern, rest)).otherwise(t))


def mask_non_prose(text: Column) -> Column:
    """The text with what is no prose as spaces, one for one."""
    text = _blank_if(text, KEYWORD_LINE, "[^\\n]+|\\n")
    for pattern, rest in NOT_PROSE:
        text = _blank_if(text, pattern, rest)
    return text


def sentences(text: Column) -> Column:
    """array<struct<start_pos,end_pos,sentence>> without white space around; pieces without a letter are none. Null for null."""

    def span(p: Column, at: Column, cut) -> Column:
        rest = F.regexp_replace(p, f"^{_SPACE}+", "")
        lead, n = F.length(p) - F.length(rest), F.length(F.regexp_replace(rest, f"{_SPACE}+\\z", ""))
        return F.when(p.rlike(LETTER), F.struct((at + lead).alias("start_pos"), (at + lead + n).alias("end_pos"), cut(lead, n).alias("sentence")))

    marked = F.regexp_replace(mask_non_prose(text), F.lit(sentence_end()), F.lit(f"$0{MARK}"))
    return F.when(text.isNotNull(), let(F.split(marked, MARK), lambda pieces: over_pieces(text, pieces, span)))


#: What separates clauses, and the pairs of signs inside which nothing does.
SEPARATORS = "，；：,;:"
PAIRS = ("（）", "()", "【】", "「」", "『』", "《》", "“”", "‘’")


def mask_brackets(text: Column) -> Column:
    """Innermost pairs of brackets and quotes as spaces, one for one; pairs around them likewise, three deep."""
    for _ in range(3):
        for a, b in PAIRS:
            a, b = (f"\\{x}" if x in "()" else x for x in (a, b))
            text = _blank_if(text, f"{a}[^{a}{b}]*{b}", f"[^{a}]+|{a}")
    return text


def clause_count(sentence: Column) -> Column:
    """How many clauses a sentence has: its parts between separators outside brackets that hold a letter."""
    signs = "".join(PAIRS)
    masked = let(mask_non_prose(sentence), lambda t: F.when(t.rlike("[" + signs.replace("(", "\\(").replace(")", "\\)") + "]"), mask_brackets(t)).otherwise(t))
    return F.size(F.filter(F.split(masked, f"[{SEPARATORS}]"), lambda p: p.rlike(LETTER)))


# ---- phrases


def spaced_tokens(text: Column) -> Column:
    """English tokens in lower case, each between spaces of its own, so that phrases are patterns that share none."""
    return F.concat(F.lit(" "), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower), "  "), F.lit(" "))


def phrase_pattern(entries: list[str], spaced: bool = True) -> str:
    """Leftmost longest matches of any entry: for spaced tokens (English), or literal (Chinese). A pattern that matches nothing for no entry."""
    import re

    found = re.compile("[A-Za-z][A-Za-z'\\-]*").findall
    made = sorted({"  ".join(found(e.lower())) if spaced else e for e in entries} - {""}, key=lambda e: (-len(e.split()) if spaced else -len(e), e))
    escape = lambda e: re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", e)
    return (" (?:{}) " if spaced else "(?:{})").format("|".join(map(escape, made))) if made else "[^\\s\\S]"


def phrase_count(text: Column, entries: list[str], spaced: bool = True) -> Column:
    """Non-overlapping hits of the entries, the longest at each place. text: spaced_tokens() if spaced."""
    return F.regexp_count(text, F.lit(phrase_pattern(entries, spaced)))


def sentence_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence_index, start_pos, end_pos, sentence) of every row's text; null texts have none. Other columns are ignored."""
    return df.select(F.col(key), F.posexplode(sentences(F.col(text))).alias("sentence_index", "_s")).select(key, "sentence_index", "_s.*")
