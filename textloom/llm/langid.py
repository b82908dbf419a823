"""Languages of documents and of the segments of mixed documents.

Scripts that one language at hand uses decide themselves (kana: ja, Cyrillic: ru). All else is scored word first: a
known word by its log frequency in each language, an unseen word by progressively shorter character n-grams. In
Latin script the words are those between spaces, in Han script, which zh and ja share, pairs of characters that back
off to single ones. The counts are fitted on a bounded sample of labelled rows; rows whose label the first fit
contradicts are left out of the second. Paragraphs that a wrong decoding has lost for good are scored by n-grams of
what is left of sample texts that went the same way.

One narrow pass: the model is bounded by the sample, so it is broadcast, and every text is read once. Texts in Latin
letters go through it a batch at a time: tokens are split and made distinct by Arrow, only distinct tokens are
scored in Python, and sentences are sums over arrays. The others, and those with several languages, follow one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.mojibake import encode, undo
from textloom.llm.quality import text_shape

#: The model is fitted on at most so many labelled rows, the first in the order of their keys' hash.
SAMPLE_ROWS = 4000
LATIN = ("en", "de", "fr", "es")
LANGUAGES = (*LATIN, "zh", "ja", "ru")
UNKNOWN = "unknown"
#: Longest character n-gram, and the factor for every step to a shorter one.
LONGEST, BACKOFF = 5, math.log(0.4)
#: A sentence in another language than the text's needs so many words (or characters in scripts without spaces) to be a run.
RUN_WORDS, RUN_CHARS, RUN_COMMON = 4, 8, 2

#: Names and codes of the languages (the part before a region or script).
LABELS = {
    "en": "en eng english anglais englisch inglés ingles английский 英语 英文 英語",
    "de": "de deu ger german deutsch allemand alemán aleman немецкий 德语 德文 ドイツ語",
    "fr": "fr fra fre french français francais französisch francés французский 法语 法文 フランス語",
    "es": "es spa spanish español espanol castellano castilian espagnol spanisch испанский 西班牙语 スペイン語",
    "zh": "zh zho chi cmn yue chinese mandarin 中文 汉语 漢語 中国語 chinois chinesisch chino китайский",
    "ja": "ja jpn jp japanese 日本語 日语 japonais japanisch japonés японский",
    "ru": "ru rus russian русский russe russisch ruso 俄语 俄文 ロシア語",
    UNKNOWN: "unknown und unk undetermined none n/a xx zxx",
}
_LABEL_OF = {name: code for code, names in LABELS.items() for name in names.split()}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HIRAGANA = re.compile(r"[ぁ-ゖ]")
_HAN_OR_KANA = re.compile(r"[㐀-鿿豈-﫿぀-ヿㇰ-ㇿｦ-ﾟ]")
_KANA, _HAN, _CYRILLIC = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ]"), re.compile(r"[㐀-鿿豈-﫿]"), re.compile(r"[Ѐ-ԯ]")
_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』》）]*\s*|…+[”’」』》）]*(?=[㐀-鿿぀-ヿ])|\n\s*\n")
_QUOTES = "(“\"«„¿¡"
#: Abbreviations that stand before names.
_ABBREVIATIONS = frozenset("Dr Mr Mrs Ms Prof St Fig Sec Eq Tab App No Nr Abb Tab Sra Sr Mme bzw vs cf approx e.g i.e z.B d.h".split())
_OPENERS = frozenset("¿¡«“„\"(「『")
#: Particles after which a sentence goes on behind a closing quote.
_GOES_ON = frozenset("的地得とのにをがはでも，、：；")
#: Characters beyond ASCII that texts in Latin letters are made of, and the other scripts'; the rest is alien.
_LATIN_SIGNS = "àâäçéèêëîïôöùûüÿñáíóúßœæÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚŒÆ¿¡«»„“”‘’‚‹›–—‐‑…°·•§±×   ​"
_ALIEN = re.compile(rf"[^\x00-\x7f{_LATIN_SIGNS}Ѐ-ӿ　-〿぀-ヿ㐀-鿿！-～￥]")
_NOT_LATIN = rf"[^\x00-\x7f{_LATIN_SIGNS}]"
_MARKS, _LATIN1, _LATIN_LETTER = re.compile(r"[¿¡§±·°×«»]"), re.compile(r"[\xa0-\xff]"), re.compile(r"[A-Za-zÀ-ɏ]")
#: The chains tried on text that is alien throughout.
_CHAINS = (
    "utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1252 twice", "utf-8>latin-1 twice", "gbk>latin-1", "gbk>cp1252", "cp1251>latin-1", "cp1251>cp1252", "koi8-r>latin-1",
    "utf-8>cp1251", "utf-8>cp866", "utf-8>koi8-r", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp850", "cp932>cp1252", "cp932>latin-1", "euc_jp>latin-1", "euc_jp>cp1252",
    "utf-8>gb18030", "utf-8>cp932", "gbk>big5", "euc_jp>cp932", "cp866>cp1251",
)


def normalize_label(label: str | None) -> str | None:
    """The language code a label names; None if it is missing; the label itself, lowered, if it names none at hand."""
    if label is None or not label.strip():
        return None
    low = label.strip().lower()
    return _LABEL_OF.get(low) or _LABEL_OF.get(re.split(r"[-_ (]", low)[0]) or low


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Offsets of sentences, good enough to tell languages apart."""
    out, at = [], 0
    for m in _STOP.finditer(text):
        end, stop = m.end(), m[0]
        following = text[end : end + 1]
        if stop[0] in "。！？…" and following in _GOES_ON and stop[-1] in "”’」』》）":
            continue
        if stop[0] in ".!?" and not (following.isupper() or following in _OPENERS or following > "\u2fff"):
            continue
        if stop[0] == "." and stop[1:2].isspace():
            word = text[max(0, m.start() - 8) : m.start()].rsplit(None, 1)[-1:]
            if word and (word[0].lstrip(_QUOTES) in _ABBREVIATIONS or len(word[0].lstrip(_QUOTES)) == 1):
                continue
        out.append((at, end))
        at = end
    if at < len(text):
        out.append((at, len(text)))
    return out


#: Fields of a token's packed value: its negative log probabilities by language (in 1/64), whether it is a word, whether a common one.
WIDTH, UNIT = 24, 64


def _field(value: int, i: int) -> int:
    return value >> (WIDTH * i) & ((1 << WIDTH) - 1)


class _Scores(dict):
    """token between spaces -> all its scores packed into one integer, so that a sentence is one sum. Bounded."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self._model = model

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value, model = 0, self._model
        for word in _WORD.findall(token.lower()):
            if word[0] >= "Ͱ":
                continue
            value += 1 << (WIDTH * 4)
            for i, lang in enumerate(LATIN):
                known = model.words[lang].get(word)
                score = model.unseen(word, lang) if known is None else known
                value += int(-score * UNIT) << (WIDTH * i)
                value += (word in model.common[lang]) << (WIDTH * (5 + i))
        self[token] = value
        return value


class Model:
    """Counts by language and the scores made from them."""

    def __init__(self, texts: list[tuple[str, str]], with_lost: bool = True) -> None:
        counts = {lang: Counter() for lang in LATIN}
        for lang, text in texts:
            if lang in counts:
                counts[lang].update(_WORD.findall(text.lower()))
        known = {w for c in counts.values() for w in c}
        self.words: dict[str, dict[str, float]] = {}
        self.grams: dict[str, dict[str, float]] = {}
        self.common = {lang: frozenset(w for w, _ in c.most_common(60)) for lang, c in counts.items()}
        for lang, c in counts.items():
            total = sum(c.values()) + 1
            floor = math.log(0.01 / total)
            self.words[lang] = {w: math.log(c[w] / total) if w in c else floor for w in known}
            grams: Counter[str] = Counter()
            for w, n in c.items():
                padded = f" {w} "
                for k in range(1, LONGEST + 1):
                    for i in range(len(padded) - k + 1):
                        grams[padded[i : i + k]] += min(n, 20)
            of_length = Counter()
            for g, n in grams.items():
                of_length[len(g)] += n
            self.grams[lang] = {g: math.log(n / of_length[len(g)]) for g, n in grams.items() if n > 1}
        self.pairs = _han_pairs(texts)
        self.common_han = _common_han(texts)
        self.lost = _lost_grams(texts) if with_lost else {}

    def han(self, text: str) -> float:
        """Log odds of zh against ja, by pairs of Han and kana characters and, where a pair is unseen, by its second one."""
        scores, missing = self.pairs
        chars = _HAN_OR_KANA.findall(text)
        total = 0.0
        for a, b in zip(chars, chars[1:]):
            p = scores.get(a + b)
            total += scores.get(b, missing) if p is None else p
        return total

    def of_lost(self, text: str) -> str | None:
        """The language of what a wrong decoding has left of a text; None if the sample had none such."""
        if not self.lost:
            return None
        grams = [text[i : i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1)]
        return max(sorted(self.lost), key=lambda lang: sum(self.lost[lang][0].get(g, self.lost[lang][1]) for g in grams))

    def unseen(self, word: str, language: str) -> float:
        """Mean log probability of the longest known n-grams at each place."""
        grams, padded = self.grams[language], f" {word} "
        total = 0.0
        for i in range(len(padded)):
            for k in range(min(LONGEST, len(padded) - i), 0, -1):
                if (p := grams.get(padded[i : i + k])) is not None:
                    total += p + (LONGEST - k) * BACKOFF
                    break
            else:
                total += -12.0 + LONGEST * BACKOFF
        return total / len(padded)


#: Characters of a language's sample from which forms lost by wrong decoding are learned, and the chains that lose them.
LOST_CHARS = 60_000
_LOSING = {"zh": ("gbk", "big5"), "ja": ("cp932", "euc_jp"), "ru": ("cp1251", "koi8-r", "cp866"), "en": ("cp1252",), "de": ("cp1252", "cp850"), "fr": ("cp1252", "cp850"), "es": ("cp1252", "cp850")}


#: Characters that a language in Han script has at least, for what a small sample has not seen.
HAN_SIGNS = 3000


def _log_odds(counts: dict[str, Counter]) -> tuple[dict[str, float], float]:
    seen = counts["zh"].keys() | counts["ja"].keys()
    zh, ja = (sum(counts[x].values()) + 0.1 * max(len(seen), HAN_SIGNS) for x in ("zh", "ja"))
    return {g: math.log((counts["zh"][g] + 0.1) / zh) - math.log((counts["ja"][g] + 0.1) / ja) for g in seen}, math.log(ja / zh)


def _han_pairs(texts: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """Log odds zh : ja of pairs seen at least twice and of single characters, and of a character never seen."""
    pairs, singles = {"zh": Counter(), "ja": Counter()}, {"zh": Counter(), "ja": Counter()}
    for lang, text in texts:
        if lang in pairs:
            chars = _HAN_OR_KANA.findall(text)
            singles[lang].update(chars)
            pairs[lang].update(map("".join, zip(chars, chars[1:])))
    often = {g for c in pairs.values() for g, n in c.items() if n > 1}
    both, missing = _log_odds(singles)
    return both | {g: v for g, v in _log_odds(pairs)[0].items() if g in often}, missing


def _lost_grams(texts: list[tuple[str, str]]) -> dict[str, tuple[dict[str, float], float]]:
    """By language: log frequencies of n-grams of sample texts that were saved in an encoding of the language and read as UTF-8, and that of an unseen one."""
    out, left = {}, dict.fromkeys(LANGUAGES, LOST_CHARS)
    counts: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
    for lang, text in texts:
        if left[lang] <= 0:
            continue
        for paragraph in text.split("\n\n"):
            for encoding in _LOSING[lang]:
                lost = paragraph.encode(encoding, "replace").decode("utf-8", "replace")
                if _is_lost(lost):
                    left[lang] -= len(paragraph)
                    counts[lang].update(lost[i : i + k] for k in (1, 2, 3) for i in range(len(lost) - k + 1))
    for lang, c in counts.items():
        if total := sum(c.values()):
            out[lang] = {g: math.log(n / total) for g, n in c.items() if n > 1}, math.log(0.2 / total)
    return out


def _is_lost(p: str) -> bool:
    """Whether a paragraph consists of replacement characters and remains rather than of words."""
    return p.count("\ufffd") > 0.1 * len(p) and len(_HAN.findall(p)) < 0.1 * len(p) and not re.search(r"[A-Za-z]{4}", p)


class Identifier:
    def __init__(self, model: Model) -> None:
        self.model = model
        self._scores = _Scores(model)
        self._odd = re.compile(rf"[^\x00-\x7f{_LATIN_SIGNS}Ѐ-ӿ　-〿぀-ヿ！-～￥{re.escape(''.join(sorted(model.common_han)))}]")

    def latin(self, text: str) -> tuple[str, float, int, int]:
        """(language, confidence, words, common words of the language): the posterior over the languages."""
        packed = sum(map(self._scores.__getitem__, text.split()))
        words = _field(packed, 4)
        if not words:
            return UNKNOWN, 0.0, 0, 0
        sums = sorted((_field(packed, i), i) for i in range(len(LATIN)))
        best = sums[0][1]
        return LATIN[best], 1 / (1 + math.exp(-min(30.0, (sums[1][0] - sums[0][0]) / UNIT))), words, _field(packed, 5 + best)

    def sentence(self, text: str) -> tuple[str, float, int, bool]:
        """(language, confidence, weight in words, whether it is a whole sentence that can make a run)."""
        if not text.isascii():
            kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
            cyrillic = len(_CYRILLIC.findall(text))
            if kana or han or cyrillic:
                latin = len(_LATIN_LETTER.findall(text))
                # a Han or kana character says about as much as two letters
                if 2 * (kana + han) > max(latin, cyrillic):
                    lang = "ja" if kana > 0.1 * (kana + han) or self.model.han(text) < 0 else "zh"
                    return lang, round(2 * (kana + han) / (2 * (kana + han) + latin + cyrillic), 6), max(1, (kana + han) // 2), kana + han >= RUN_CHARS
                if cyrillic > latin:
                    words = len(_WORD.findall(text))
                    return "ru", round(cyrillic / (cyrillic + latin), 6), words, words >= RUN_WORDS
        lang, confidence, words, common = self.latin(text)
        return lang, round(confidence, 6), words, words >= RUN_WORDS and common >= RUN_COMMON

    def readable(self, text: str) -> list[tuple[str, str | None]]:
        """The text in parts with the language where a part's own letters are lost; paragraphs that are alien throughout as their originals where a chain can be undone."""
        if text.isascii() or not _ALIEN.search(text) and not _HAN.search(text):
            return [(text, None)]
        parts: list[tuple[str, str | None]] = []
        for p in text.split("\n\n"):
            lang = self.model.of_lost(p) if "\ufffd" in p and _is_lost(p) else None
            p = p if lang else self._original(p)
            if parts and lang is None is parts[-1][1]:
                parts[-1] = (parts[-1][0] + "\n\n" + p, None)
            else:
                parts.append((p, lang))
        return parts

    def _strange(self, p: str) -> float:
        """Share of characters that texts in these languages hardly have; signs count too where there are too many of them."""
        marks = len(_MARKS.findall(p))
        if marks <= 0.1 * len(p):
            marks = 0
        odd = len(self._odd.findall(p))
        return (odd + marks) / max(1, len("".join(p.split()))) if odd or marks else 0.0

    def _original(self, p: str) -> str:
        if len(_HIRAGANA.findall(p)) > 0.15 * len(p):  # wrong decoding hardly ever makes Hiragana
            return p
        strange = self._strange(p)
        latin1 = len(_LATIN1.findall(p))
        if strange < 0.2 and latin1 < 0.3 * len(p):
            return p
        best, share = p, strange if latin1 < 0.3 * len(p) else 1.0
        for chain in _CHAINS:
            found = undo(p, chain)
            if found is None:  # a few characters were lost
                written, read = chain.split(" ")[0].split(">")
                data = encode(p.replace("�", "?"), read)
                found = data.decode(written, "ignore") if data is not None and " " not in chain and written in ("utf-8", "gbk", "cp932", "euc_jp") else None
            if found and (s := self._strange(found)) + 0.02 < share and len(found) > 0.2 * len(p):
                best, share = found, s
        return best

    def analyze(self, text: str | None) -> tuple[str, float, list[tuple[str, float, int]]]:
        """(language, confidence, runs as (language, confidence, sentences)). Texts without letters: unknown, no runs."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 1.0, []
        votes: dict[str, list[float]] = {}
        seen: list[tuple[str, float, bool]] = []
        judged: list[tuple[str, float, int, bool]] = []
        for part, lost in self.readable(text):
            judged += [(lost, 0.5, max(1, len(part) // 4), len(part) >= RUN_CHARS)] if lost else [self.sentence(part[a:b]) for a, b in sentences_of(part)]
        for lang, confidence, weight, whole in judged:
            if weight:
                v = votes.setdefault(lang, [0.0, 0.0])
                v[0] += 1 if whole else 0.001 * weight
                v[1] += confidence * (1 if whole else 0.001 * weight)
                seen.append((lang, confidence, whole))
        if not votes:
            return UNKNOWN, 0.0, []
        main = max(votes, key=lambda k: (votes[k][0], k))
        confidence = votes[main][1] / sum(v[0] for v in votes.values())
        runs: list[list] = []
        for lang, c, whole in seen:
            if not whole:
                continue
            if runs and runs[-1][0] == lang:
                runs[-1][1] += c
                runs[-1][2] += 1
            else:
                runs.append([lang, c, 1])
        runs = [(lang, round(c / n, 6), n) for lang, c, n in runs]
        return main, round(confidence, 6), runs if len({r[0] for r in runs}) > 1 else []


#: Stands for a blank line among the tokens (private use: texts in Latin letters have none).
_BLANK = "\ue000"
_END = re.compile(r"([.!?…]+)([\"'”’»)\]]*)$")


class Batches:
    """The verdicts of Identifier.analyze for many texts in Latin letters at once."""

    def __init__(self, identifier: Identifier) -> None:
        self._scores = identifier._scores
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1 << 12, 9), np.int32)
        self._flags = np.zeros((1 << 12, 4), bool)  # ends with a stop, that needs a capital after it, is an abbreviation; begins like a sentence

    def _row(self, token: str) -> int:
        if (i := self._rows.get(token)) is not None:
            return i
        i = self._rows[token] = len(self._rows)
        if i == len(self._table):
            self._table, self._flags = np.concatenate([self._table, np.zeros_like(self._table)]), np.concatenate([self._flags, np.zeros_like(self._flags)])
        if token != _BLANK:
            packed = self._scores[token]
            self._table[i] = [_field(packed, k) for k in range(9)]
            if end := _END.search(token):
                low = token[:-1].lstrip(_QUOTES)
                self._flags[i, :3] = True, end[1][0] in ".!?", end[1] == "." and not end[2] and (low[-8:] in _ABBREVIATIONS or len(low) == 1)
            self._flags[i, 3] = token[0].isupper() or token[0] in _OPENERS
        return i

    def analyze(self, texts: pa.Array) -> list[tuple[str, float] | None]:
        """(language, confidence) of each text; None for those that have letters of other scripts, no words or whole sentences in several languages."""
        out: list[tuple[str, float] | None] = [None] * len(texts)
        if len(self._rows) > 300_000:
            self._rows.clear()
        plain = np.flatnonzero(~pc.match_substring_regex(texts, _NOT_LATIN).to_numpy(zero_copy_only=False))
        if not len(plain):
            return out
        latin = texts.take(pa.array(plain))
        spaced = pc.replace_substring_regex(latin, "\\n[\\s\u00a0\u2002-\u200b\u202f]*\\n", f" {_BLANK} ")
        lists = pc.utf8_split_whitespace(spaced)
        flat = lists.flatten()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        distinct = flat.dictionary_encode()
        rows = np.array([self._row(t) if t else self._row(_BLANK) for t in distinct.dictionary.to_pylist()], np.int64)
        tokens = rows[distinct.indices.to_numpy(zero_copy_only=False)]
        if not len(tokens):
            return out
        stop, capital, short, begins = self._flags[tokens].T
        blank = tokens == self._rows.get(_BLANK, -1)
        last = np.cumsum(lengths)[lengths > 0] - 1
        after = lambda x: np.append(x[1:], False)
        before_blank = after(blank)
        next_begins = np.where(before_blank, after(after(begins)), after(begins))
        ends = np.where(stop, ~short & (~capital | next_begins), before_blank) & ~blank
        ends[last] = True
        to = np.flatnonzero(ends)
        sums = np.add.reduceat(self._table[tokens], np.append(0, to[:-1] + 1), axis=0, dtype=np.int64)
        doc = np.repeat(np.arange(len(plain)), lengths)[to]
        best = sums[:, :4].argmin(1)
        ordered = np.sort(sums[:, :4], axis=1)
        confidence = np.round(1 / (1 + np.exp(-np.minimum(30.0, (ordered[:, 1] - ordered[:, 0]) / UNIT))), 6)
        words = sums[:, 4]
        whole = (words >= RUN_WORDS) & (sums[np.arange(len(best)), 5 + best] >= RUN_COMMON)
        weight = np.where(whole, 1.0, 0.001 * words)
        cell = doc * 4 + best
        size = len(plain) * 4
        votes = np.bincount(cell, weight, size).reshape(-1, 4)
        sure = np.bincount(cell, weight * confidence, size).reshape(-1, 4)
        languages = (np.bincount(cell, whole, size).reshape(-1, 4) > 0).sum(1)
        by_name = sorted(range(4), key=lambda i: LATIN[i], reverse=True)  # equal votes: the last name
        main = np.array(by_name)[votes[:, by_name].argmax(1)]
        total = votes.sum(1)
        decided = (total > 0) & (languages <= 1)
        share = np.round(sure[np.arange(len(main)), main] / np.where(total > 0, total, 1), 6)
        for i, k, c in zip(plain[decided].tolist(), main[decided].tolist(), share[decided].tolist()):
            out[i] = (LATIN[k], c)
        return out


def fit(sample: list[tuple[str | None, str | None]]) -> Identifier:
    """From (label, text) rows. Rows whose label the first fit contradicts do not enter the second."""
    rows = [(code, text) for label, text in sample if text and (code := normalize_label(label)) in LANGUAGES]
    first = Identifier(Model(rows, with_lost=False))
    quick = Batches(first).analyze(pa.array([text for _, text in rows], pa.string()))
    kept = [(lang, text) for (lang, text), q in zip(rows, quick) for found in ((q[0], 0.0, []) if q else first.analyze(text),) if found[0] == lang and not found[2]]
    return Identifier(Model(kept or rows))


def _common_han(rows: list[tuple[str, str]]) -> frozenset[str]:
    """Han characters that at least three texts labelled zh or ja have."""
    df: Counter[str] = Counter()
    for lang, text in rows:
        if lang in ("zh", "ja"):
            df.update(set(_HAN.findall(text)))
    return frozenset(c for c, n in df.items() if n >= 3)


def sample_rows(df: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[str | None, str | None]]:
    """At most ``rows`` labelled rows, whole texts: those whose key's hash is under a threshold that leaves about three quarters of the bound.

    A count and a filter: what the driver gets depends on the bound alone, not on the number of partitions.
    """
    labelled = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    n = labelled.count()
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    if n > rows:
        labelled = labelled.filter(place < int((1 << 30) * 0.75 * rows / n))
    taken = labelled.select(place.alias("h"), F.col(label).cast("string").alias("l"), F.col(text).cast("string").alias("t")).limit(rows).collect()
    return [(r.l, r.t) for r in sorted(taken)]


RESULT = T.StructType([T.StructField("seg_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("label_wrong", T.BooleanType())])



def identify(df: DataFrame, key: str, text: str, label: str, identifier: Identifier, shaped: bool = False, wrong_only: bool = False) -> DataFrame:
    """(key, seg_no, lang, confidence, n_sentences, label_wrong): seg_no 0 is the text's language, 1, 2, ... its runs if it is mixed.

    label_wrong is set on seg_no 0: the label is missing or names another language. Null texts give no row.
    wrong_only leaves out seg_no 0 of rightly labelled texts. shaped: texts that are no prose give no row.
    """
    spark: SparkSession = df.sparkSession
    source = df.select(F.col(key).alias("_key"), F.col(label).cast("string").alias("_label"), F.col(text).cast("string").alias("_text")).filter("_text is not null")
    schema = T.StructType([T.StructField("_key", source.schema["_key"].dataType), *RESULT.fields])
    counts = spark.sparkContext.broadcast(identifier.model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(counts.value)
        fast = Batches(own)
        codes: dict[str | None, str | None] = {}
        for batch in batches:
            keys, out = [], [[] for _ in RESULT.fields]
            texts = batch.column(2)
            for i, (k, lab, easy) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), fast.analyze(texts))):
                if lab not in codes:
                    if len(codes) > 10_000:
                        codes.clear()
                    codes[lab] = normalize_label(lab)
                lang, confidence, runs = (*easy, ()) if easy else own.analyze(texts[i].as_py())
                wrong = codes[lab] != lang
                rows = [(0, lang, confidence, None, wrong)] if wrong or not wrong_only else []
                rows += [(n, r[0], r[1], r[2], None) for n, r in enumerate(runs, 1)]
                if rows and not (shaped and text_shape(texts[i].as_py()) not in ("prose", None)):
                    for row in rows:
                        keys.append(k)
                        for column, v in zip(out, row):
                            column.append(v)
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, kind) for c, kind in zip(out, kinds))], names=schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)
