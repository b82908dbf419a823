"""Tokens, units, language and lexicon counts of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.session import round6, safe_div

TOKEN = "[A-Za-z][A-Za-z'\\-]*"
CJK = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]"
#: Own word lists of the prose metrics.
LEXICON = {
    "hedge": ("may", "might", "could", "approximately", "presumably", "slightly", "rarely", "suggested", "approx"),
    "booster": ("clearly", "significantly", "considerably", "consistently", "always", "substantial"),
    "causal": ("because", "therefore", "thus", "hence"),
    "contrast": ("although", "however", "whereas", "but"),
    "additive": ("moreover", "furthermore", "also", "and"),
    "academic": ("analysis", "hypothesis", "framework", "parameter", "evaluation", "criterion", "inference", "calibration"),
    "present": ("explains", "supports", "reduces", "improves", "confirms", "depends", "follows", "exceeds"),
    "past": ("reached", "stayed", "rose", "reported", "measured", "collected", "changed", "wrote"),
}


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)


def cjk_units(text: Column) -> Column:
    """CJK characters and ASCII words."""
    return F.regexp_count(text, F.lit(CJK)) + F.regexp_count(text, F.lit(TOKEN))


def detect_language(text: Column) -> Column:
    """zh if over a tenth of CJK characters and ASCII words are CJK; else en if there is a word; else unknown."""
    cjk, words = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(TOKEN))
    return F.when(cjk > 0.1 * (cjk + words), "zh").when(words > 0, "en").otherwise("unknown")


def of_lexicon(token_array: Column) -> Column:
    """The few tokens that are in any group: one pass over all tokens, by a hash set, before the groups are counted."""
    return F.filter(token_array, lambda t: t.isin(sorted({w for ws in LEXICON.values() for w in ws})))


def hits(token_array: Column, group: str) -> Column:
    return F.size(F.filter(token_array, lambda t: t.isin(list(LEXICON[group]))))


def share(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """NULL without a denominator: missing is not zero."""
    return round6(safe_div(numerator * scale, denominator))


def mtld(token_array: Column, threshold: float = 0.72, least: int = 20) -> Column:
    """Lexical diversity: mean length of token runs that keep the type-token ratio above the threshold, both directions.

    Null under ``least`` tokens. A fold over the array, so it stays in the JVM.
    """

    def one_way(arr: Column) -> Column:
        empty = F.struct(F.lit(0.0).alias("factors"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("types"))

        def step(acc: Column, tok: Column) -> Column:
            n = acc["n"] + 1
            types = F.when(F.array_contains(acc["types"], tok), acc["types"]).otherwise(F.array_append(acc["types"], tok))
            full = F.size(types) <= threshold * n
            return F.struct(
                F.when(full, acc["factors"] + 1).otherwise(acc["factors"]).alias("factors"),
                F.when(full, F.lit(0)).otherwise(n).alias("n"),
                F.when(full, F.array().cast("array<string>")).otherwise(types).alias("types"),
            )

        def finish(acc: Column) -> Column:
            rest = F.when(acc["n"] > 0, (1 - F.size(acc["types"]) / acc["n"]) / (1 - threshold)).otherwise(F.lit(0.0))
            return acc["factors"] + rest

        return safe_div(F.size(arr), F.aggregate(arr, empty, step, finish))

    return F.when(F.size(token_array) >= least, round6((one_way(token_array) + one_way(F.reverse(token_array))) / 2))


def classify_cell(value: Column) -> Column:
    """Type of a spreadsheet cell: empty, error, string_id, date, number, bool or string, in this order."""
    v = F.trim(value)
    return (
        F.when(value.isNull() | (v == ""), "empty")
        .when(v.rlike("^#(N/A|REF!|VALUE!|DIV/0!|NAME\\?|NULL!|NUM!)$"), "error")
        .when(v.rlike("^(0[0-9]+|[0-9]{11,})$"), "string_id")
        .when(v.rlike("^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$"), "date")
        .when(v.rlike("^[-+]?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?%?$"), "number")
        .when(F.lower(v).isin("true", "false", "yes", "no"), "bool")
        .otherwise("string")
    )


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters to a 1-based index."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))


def looks_like_reference(text: Column) -> Column:
    """A numbered marker decides; else at least five words with a year and a capital."""
    return text.rlike("^\\s*(\\[[0-9]+\\]|[0-9]+[.])\\s") | ((F.size(F.split(F.trim(text), "\\s+")) >= 5) & text.rlike("(19|20)[0-9]{2}") & text.rlike("^\\s*[A-Z][A-Za-z'-]+,? "))
