"""Statistics of a text that tell natural prose from lists, tables and junk.

A text is judged by its paragraphs, each weighed by its length. Tables show in the vertical alignment of
delimiters and in line lengths that return with the numbers, lists in markers and indentation that return
line by line and in the autocorrelation of line lengths, junk in symbol, repetition and word-form ratios; prose has sentences of words, common ones among
them. Everything is computed in one pass over Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent words of the languages at hand.
COMMON = frozenset(
    (
        "the of and to a in is that it for was on with be by as are were at from this an or we which has had not its their whereas while although if then into than according under between both all "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über wurde jedes allen ca zum fehlt "
        "le la les de des et un une dans en du que est pour qui par sur au avec ce il sont plus ne pas se a été ont où tous chaque comme cas après entre à selon "
        "el los las y del un una que en por con para es se su al lo como más o fue son entre este cada todas donde según aunque también después "
        "в и на не что с по как к из от для это его но за то или о при так же если весь каждой так авторы"
    ).split()
)
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_KANA_OR_PARTICLE = re.compile(r"[了是在不则会若为对将被从并往即也就把这该我们时]|[ぁ-ん]{2}")
_STOP = re.compile(r"(?:[^\W\d_][^\W_]|[%)\]”’\"»])[.!?]{1,3}[\"'”’»)\]]*(?=\s|$)|[。！？…｡।]|[.!?]{3}")
_MARKER = re.compile(r"\s*(?:[-–—•◦▪*·+‣●○](?=\s)|[(（]?\d{1,3}[.)）、:](?=\s|[^\d\s])|[(（]?[a-zA-Zivx]{1,4}[)）](?=\s)|\[\d{1,4}\]|\d+(?:\.\d+)+\.?(?=\s)|[①-⑳])\s*\S")
_LEADER = re.compile(r"(?:\.{4,}|…{2,}|(?:\. ){4,})\s*\d+\s*$")
_PAIR = re.compile(r"\s*[^\s:：][^:：]{0,48}[:：]\s*\S[^:：]{0,80}$")
_NUMBER = re.compile(r"[-+±~≈<>]?[$€£]?\d[\d.,:/%×eE+-]*[a-z%]{0,3}|n/a|N/A|yes|no|[-–—✓✗]|nan|NA")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)|\S {4,}$")
_FIRST = re.compile(r"\s*([぀-ヿ㐀-鿿豈-﫿]|\S+)")
#: From this autocorrelation on, line lengths or indents return; wrapped text fills this share of its lines.
PERIODIC, WRAPPED = 0.6, 0.5
_LATEX = re.compile(r"\\[a-zA-Z]+\s*\{|[_^]\s*\{")
_VOWELS = frozenset("aeiouyAEIOUYàâäáãåæçéèêëíìîïñóòôöõøœúùûüÿ")
#: Signs that make up symbol soup.
_SOUP = frozenset("|\\/<>=+*^~#@%_■□◆◇●○¤§¬¦{}[]`$&")
#: Controls of web pages and readers.
NAVIGATION = frozenset("home|share|print|log in|sign up|sign in|menu|search|next|prev|previous|back|cookie settings|cookies|download pdf|cite this|metrics|contact|about|help|privacy|subscribe|read more|loading|click here|advertisement".split("|"))
_INLINE = ("·", "•", ";", "；", "/", "、", "|", ",", "，", "‧", "~")


def _is_number(cell: str) -> bool:
    return _NUMBER.fullmatch(cell.strip()) is not None


def _common(words: list[str]) -> int:
    return sum(w in COMMON for w in words)


def alignment(lines: list[str]) -> tuple[str, float]:
    """The delimiter whose count agrees best between neighbouring lines, and the share of agreeing neighbours."""
    best, share = "", 0.0
    for d in ("|", "\t", ",;", "  "):
        counts = [len(_GAP.findall(x)) if d == "  " else sum(x.count(c) for c in d) for x in lines]
        if len(lines) > 1 and max(counts) > 0:
            same = sum(a == b > 0 for a, b in zip(counts, counts[1:])) / (len(lines) - 1)
            if same > share:
                best, share = d, same
    return best, share


def autocorrelation(values: list[int]) -> float | None:
    """Lag-1 autocorrelation; None if there is no variation."""
    x = np.asarray(values, float)
    x -= x.mean()
    power = float((x * x).sum())
    return float((x[1:] * x[:-1]).sum()) / power if len(values) > 2 and power > 0 else None


def periodicity(values: list[int]) -> float:
    """Greatest autocorrelation at lags from 2 to a third of the values, per pair of values; 0 for fewer than six values or no variation."""
    x = np.asarray(values, float)
    x -= x.mean()
    power = float((x * x).mean())
    if len(values) < 6 or power == 0:
        return 0.0
    return max(float((x[k:] * x[:-k]).mean()) / power for k in range(2, len(values) // 3 + 1))


def _wrapped(lines: list[str]) -> bool:
    """Whether lines end because they are full: the next line's first word would not fit."""
    width = max(map(len, lines))
    full = sum(len(a) + 1 + len(_FIRST.match(b)[1]) > width for a, b in zip(lines, lines[1:]))
    return full > WRAPPED * (len(lines) - 1)


def _outline(lines: list[str], stops: int) -> bool:
    """Items without markers that show in the layout: indents that return, hanging indents, line lengths that return."""
    if len(lines) < 3:
        return False
    lines = [x.expandtabs(4).rstrip() for x in lines]
    indents = [len(x) - len(x.lstrip()) for x in lines]
    low, high = min(indents), max(indents)
    if high - low >= 2:
        starts = [i for i, n in enumerate(indents) if n == low]
        # items start at the margin and go on indented; prose has it the other way round
        if len(starts) >= 3 and starts[0] == 0 and indents[-1] > low and all(b - a > 1 for a, b in zip(starts, starts[1:])):
            return True
    if stops * 5 > len(lines):
        return False
    if high >= 2:
        times = Counter(indents if indents.count(indents[0]) > 1 else indents[1:])  # a text's first indent may have been stripped
        back = [n for n in times if times[n] > 1]
        if sum(times[n] for n in back) >= 0.8 * sum(times.values()):
            changes = sum(a != b for a, b in zip(indents, indents[1:]))
            if max(back) - min(back) >= 2 and (changes >= 3 or periodicity(indents) >= PERIODIC) or max(back) >= 2 and not _wrapped(lines):
                return True
    lengths = [len(x) for x in lines]
    return periodicity(lengths) >= PERIODIC and max(lengths) >= 1.5 * min(lengths) and not _wrapped(lines)


def _junk(text: str, words: list[str]) -> bool:
    solid = [c for c in text if not c.isspace()]
    n = len(solid)
    if n >= 12 and len(set(solid)) <= 2:
        return True
    signs = sum(c in _SOUP for c in solid)
    if n >= 8 and signs >= 0.55 * n:
        return True
    if text.count("(cid:") * 6 >= 0.4 * n:
        return True
    if len(_LATEX.findall(text)) >= 3 and sum(len(w) == 1 for w in words) >= 0.5 * len(words):
        return True
    ascii_words = [w for w in words if w.isascii()]
    if len(ascii_words) == len(words):
        if sum(len(w) for w in words if len(w) >= 30 and re.fullmatch(r"[A-Za-z0-9+/=]+", w) and re.search(r"[a-z][A-Z]|\d[A-Za-z]", w)) >= 0.6 * n:
            return True
        letters = [c for w in words for c in w if c.isalpha()]
        if len(letters) >= 20 and len(words) >= 3 and sum(c in _VOWELS for c in letters) < 0.12 * len(letters) and not any(map(_is_number, words)):
            return True
    if len(words) >= 8 and len(set(words)) <= max(2, 0.12 * len(words)):
        return True
    parts = [p.strip(" »«›‹>").lower() for p in re.split(r"[|\n]", text)]
    return len(parts) >= 3 and sum(p in NAVIGATION for p in parts) >= 0.6 * len(parts)


def _table(lines: list[str], words: list[str], stops: int, common: int) -> bool:
    text_cells = common < 0.12 * len(words) + 1 and stops * 12 <= len(words) + 2
    if any("<td" in x or "<tr" in x for x in lines):
        return True
    if len(lines) >= 2:
        d, share = alignment(lines)
        if d == "|" and share >= 0.6 and min(x.count("|") for x in lines) >= 1 and not all(x.count("|") == 0 for x in lines):
            return True
        if d == "\t" and share >= 0.6 and text_cells:
            return True
        delims = [sum(x.count(c) for c in ",;") for x in lines]
        if d == ",;" and share >= 0.6 and text_cells:
            cells = [c for x in lines for c in re.split(r"[,;]", x)]
            if sum(map(_is_number, cells)) >= 0.3 * len(cells) and min(delims) >= 1:
                return True
        gaps = [len(_GAP.findall(x)) for x in lines]
        numbers = sum(map(_is_number, words))
        if sum(g >= 1 for g in gaps) >= 0.6 * len(lines) and numbers >= 0.2 * len(words) and text_cells:
            return True
        if len(lines) >= 5 and sum(len(x.split()) <= 2 for x in lines) >= 0.85 * len(lines) and numbers >= 0.3 * len(lines):
            return True
        # rows whose cells stand below each other: lengths return, and so do the numbers
        if text_cells and sum(map(_is_number, lines)) >= 0.25 * len(lines) and periodicity([len(x.strip()) for x in lines]) >= PERIODIC:
            return True
    return len(words) >= 5 and sum(map(_is_number, words)) >= 0.3 * len(words) and text_cells and stops * 20 <= len(words)


def _list(text: str, lines: list[str], words: list[str], stops: int, common: int) -> bool:
    marked = sum(_MARKER.match(x) is not None for x in lines)
    if len(lines) >= 2:
        if marked >= 0.6 * len(lines):
            return True
        if sum(_LEADER.search(x) is not None for x in lines) >= 0.5 * len(lines):
            return True
        if sum(_PAIR.match(x) is not None for x in lines) >= 0.75 * len(lines) and stops <= 0.3 * len(lines):
            return True
    if _LEADER.search(text) or re.match(r"\s*\[\d+\]\s+\w{1,3}\.\s", text) or len(re.findall(r"(?:^|\n)\s*\[\d+\]\s", text)) >= 2:
        return True
    if _outline(lines, stops):
        return True
    cjk = len(_CJK.findall(text))
    if stops or common > 0.1 * len(words) + (0 if cjk else 1):
        return False
    if cjk > 0.3 * len(text) and _KANA_OR_PARTICLE.search(text):
        return False
    short = (lambda p: len(p) <= 14) if cjk > 0.3 * len(text) else (lambda p: len(p.split()) <= 4)
    if len(lines) >= 3 and all(short(x.strip()) for x in lines):
        return True
    for d in _INLINE:
        parts = [p.strip() for p in text.replace("\n", " ").split(d)]
        if len(parts) >= 4 and sum(short(p) for p in parts) >= 0.9 * len(parts):
            return True
    return False


def paragraph_shape(text: str) -> str:
    """prose, list, table or junk, for one non-blank paragraph."""
    words = text.split()
    one_line = "\n" not in text.strip()
    # the usual case first: one line of sentences, with common words among its words or in a script without spaces
    if one_line and text[0] not in "[0123456789-*•(":
        if len(words) * 6 < len(text) and any(s in text for s in "。！？"):
            return "prose"
        common = _common(text.lower().split())
        if common >= 0.15 * len(words) and common >= 2 and (". " in text or "? " in text or "! " in text or text.rstrip()[-1] in ".!?…”»") and len(set(words)) > 0.3 * len(words):
            return "prose"
    lines = [x for x in text.split("\n") if x.strip()]
    stops, common = len(_STOP.findall(text)), _common([w.strip("“”„«»(),;:.!?\"'").lower() for w in words])
    marked = [x for x in lines if _MARKER.match(x)]
    if len(lines) >= 2 and len(marked) >= 0.6 * len(lines) and sum(map(_is_number, (w for x in marked for w in x.split()[1:]))) <= 0.25 * len(words):
        return "list"
    if _table(lines, words, stops, common):
        return "junk" if _junk(text, words) else "table"
    if _junk(text, words):
        return "junk"
    return "list" if _list(text, lines, words, stops, common) else "prose"


def text_shape(text: str | None) -> str | None:
    """The shape that most of a text has, by characters; None for null and blank texts."""
    if text is None or not text.strip():
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    weights: Counter[str] = Counter()
    for paragraph in text.split("\n\n"):
        if paragraph.strip():
            weights[paragraph_shape(paragraph)] += len(paragraph)
    return max(("prose", "list", "table", "junk"), key=lambda s: weights[s])


#: Counts and ratios that are SQL expressions of the text, and those that need its lines side by side.
COUNTS = ("n_chars", "n_words", "n_lines", "digits", "n_stops", "mean_word_length", "symbol_ratio", "end_punct_share")
LAYOUT = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("common_share", "delimiter_alignment", "indent_share", "line_autocorrelation")), T.StructField("shape", T.StringType())])
#: A sentence's stop as quality counts it, and what a line of prose ends with.
_SQL_STOP = "(?:[\\p{L}\\p{M}][\\p{L}\\p{M}\\p{N}]|[%)\\]”’\"»])[.!?]{1,3}[\"'”’»)\\]]*(?=\\s|$)|[。！？…｡।]|[.!?]{3}"
_SQL_LINE_END = "(?md)[.!?。！？…।;；:：\"”»」][^\\S\\n]*$"


def counts(text: Column) -> dict[str, Column]:
    """COUNTS of a text. Null and blank texts: counts of 0 (characters as they are), ratios null. Digits of all scripts count."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    words, lines, solid = count("\\S+"), count("(?md)^.*\\S.*$"), count("\\S")
    return {
        "n_chars": F.length(t), "n_words": words, "n_lines": lines, "digits": count("\\p{Nd}"), "n_stops": count(_SQL_STOP), "mean_word_length": ratio(solid, words),
        "symbol_ratio": ratio(count("[^\\p{L}\\p{N}\\s]"), solid), "end_punct_share": ratio(count(_SQL_LINE_END), lines),
    }


def layout_stats(text: str | None) -> dict:
    """LAYOUT of one text. Null and blank texts: null."""
    text = text or ""
    lines, words = [x for x in text.split("\n") if x.strip()], text.split()
    ratio = lambda a, b: round(a / b, 6) if b else None
    indents = [len(x) - len(x.lstrip()) for x in lines]
    auto = autocorrelation([len(x) for x in lines])
    return {
        "common_share": ratio(_common([w.strip("“”„«»(),;:.!?\"'").lower() for w in words]), len(words)),
        "delimiter_alignment": ratio(alignment(lines)[1], 1) if len(lines) > 1 else None,
        "indent_share": ratio(sum(a == b > 0 or (_MARKER.match(x) is not None) for a, b, x in zip(indents, indents[1:], lines[1:])), len(lines) - 1) if len(lines) > 1 else None,
        "line_autocorrelation": None if auto is None else round(auto, 6),
        "shape": text_shape(text),
    }


def _per_text(df: DataFrame, key: str, text: str, out: T.StructType, build) -> DataFrame:
    source = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_key", source.schema["_key"].dataType), *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *build(batch.column(1).to_pylist())], names=["_key", *out.names])

    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)


def shapes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, shape) of every row; shape is null for null and blank texts. Other columns are ignored."""
    out = T.StructType([T.StructField("shape", T.StringType())])
    return _per_text(df, key, text, out, lambda texts: [pa.array([text_shape(t) for t in texts], pa.string())])


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, COUNTS, LAYOUT) of every row. Counting stays in the JVM; only layout and shape are judged in Python."""
    out = T.StructType([T.StructField("_s", LAYOUT)])
    kinds = [(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.float64()) for f in LAYOUT.fields]
    made = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).select(F.struct("_k", *[c.alias(n) for n, c in counts(F.col("_t")).items()]).alias("_head"), "_t")
    found = _per_text(made, "_head", "_t", out, lambda texts: [pa.StructArray.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds]) for rows in ([layout_stats(t) for t in texts],)])
    return found.select(F.col("_head._k").alias(key), *[F.col(f"_head.{n}") for n in COUNTS], "_s.*")
