"""Text from scanned pages: words broken at line ends, misrecognised characters, running headers, page numbers.

Clean text of the corpus gives a lexicon (words; in scripts without spaces pairs and triples of characters) and
skip-gram vectors, learned by factorising the words' pointwise mutual information with their hashed neighbours.
A word of a scan that the lexicon lacks is linked to the frequent words that plausible glyph edits make of it.
Which of them stands there is decided for each occurrence by its own neighbours: the candidate whose vector
agrees best with them. Furniture (headers, page numbers) is told by its form, and taken out before words are
joined across lines and text is reflowed.

The lexicon never goes to the driver. Workers get its most frequent words and a bitmap of it, both of bounded size.
What the bitmap lacks is unknown; what it holds but is not among the frequent words is compared with the lexicon by an
exact join, so the bitmap's size decides how many words are shuffled, not which are found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import cut_lineage

#: Least and most bits of the lexicon's bitmap (1 and 128 MB) and bits for each word between them.
BITMAP_BITS, MOST_BITS, BITS_A_WORD = 1 << 23, 1 << 30, 64
#: The most frequent words that workers get as such; others that the bitmap holds are verified by a join.
SURE_WORDS = 50_000
#: Buckets of neighbours, places to either side that count as neighbours.
BUCKETS, WINDOW = 256, 2
#: Dimensions of the vectors, how many neighbours the prior of a word's counts weighs, and the most that one neighbour speaks against a word.
RANK, PRIOR, LEAST = 64, 8.0, -2.0
#: A correction must occur so often in clean text, and agree with the neighbours at least so well (mean log ratio).
MIN_COUNT, MIN_AGREEMENT = 3, -1.5

#: What is read for what. Left is what the scan has, right what stood there.
GLYPHS = (
    "c>e e>c e>o o>e c>o o>c c>a a>c a>o o>a a>e @>a 0>o 0>O O>0 o>0 l>1 1>l 1>i i>1 1>I I>l l>I i>l l>i !>l !>i |>l |>I f>t t>f l>t t>l r>t b>h h>b n>h h>n "
    "5>s s>5 5>S S>5 $>s 8>B B>8 8>g 9>g g>9 g>q q>g 2>z z>2 6>b b>6 6>G u>v v>u y>v v>y n>u u>n r>n n>r i>j j>i i>r x>k k>x D>O D>0 Q>O G>C C>G E>F F>E P>F R>K T>I "
    "rn>m m>rn cl>d d>cl vv>w w>vv ii>u u>ii li>h h>li ri>n n>ri in>m m>in nn>m ni>m lc>k k>lc tl>d ﬁ>fi ﬂ>fl ﬀ>ff fi>h ß>B B>ß é>e è>e ä>a ö>o ü>u ñ>n"
)
_EDITS = [tuple(e.split(">")) for e in GLYPHS.split()]
_HYPHENS = "-‐­¬"
_SURE_HYPHENS = "­¬"
_TOKEN = re.compile(r"[^\W_]+(?:['’@$|!-]?[^\W_]+|[@$|!](?=[a-z]))*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CJK_RUN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]+")
_PAGE = re.compile(
    r"[-–—·•|~\[(]?\s*(?:(?:page|pg\.?|p\.|seite|s\.|pág\.?|página|стр\.?|с\.|第)\s*)?(?:\d{1,4}|[ivxlc]{1,8})\s*(?:页|頁|ページ)?(?:\s*(?:/|of|von|de|sur|из)\s*\d{1,4})?\s*[-–—·•|~\])]?", re.IGNORECASE
)
_NUMBER_SIDE = re.compile(r"^(?:\d{1,4}|[ivxlc]{2,8})\s*(?:[·|—–-]\s*|\s{2,}|\s(?=\S))|\s*(?:\s{2,}|\s[·|—–-]\s|\s)\d{1,4}$")
_SMALL = frozenset("of the and in for on a an to with by at from as or und der die das des de la le les et en y los las el del du".split())
_PUNCT = re.compile(r"[.,;:!?。，、；：！？“”\"„«»()（）「」]")
#: How Chinese and Japanese running titles end or begin.
_CJK_TITLE = re.compile(r"第.{1,5}[届回卷期].*|.*(?:研究|论文集|文集|学报|期刊|会议|大会|紀要|論文誌)")


def _title_like(core: str, short: bool = False) -> bool:
    """short: the line is much shorter than its neighbours, so one capital may have been misread."""
    core = core.strip(" ·|—–-")
    if not core or _PUNCT.search(core):
        return False
    if len(_CJK.findall(core)) > 0.5 * len(core):
        return 4 <= len(core) <= 18 and _CJK_TITLE.fullmatch(core) is not None
    words = [w for w in core.split() if w.lower() not in _SMALL]
    if len(words) < 2 or len(core) > 90 or core.startswith(("#", "|", "$", "!", "-")):
        return False
    capital = sum(w[0].isupper() for w in words)
    return (capital >= 0.75 * len(words) and capital >= 2 or short and capital >= max(1, len(words) - 1)) and not any(w.isdecimal() for w in words)


def furniture(lines: list[str]) -> list[str | None]:
    """header, page_number or None for every line. Text with one word a line has no furniture."""
    full = [x.strip() for x in lines if x.strip()]
    if len(full) < 2 and not (full and _CJK_TITLE.fullmatch(full[0]) and not _PUNCT.search(full[0])):
        return [None] * len(lines)
    cjk = sum(len(_CJK.findall(x)) for x in full) > 0.3 * sum(map(len, full))
    long = [x for x in full if not _PAGE.fullmatch(x)]
    if long and not cjk and median(len(x.split()) for x in long) < 2 and len(long) > 2:
        return [None] * len(lines)
    out: list[str | None] = []
    usual = median(map(len, long)) if long else 0
    for n, x in enumerate(lines):
        s = x.strip()
        kind = None
        short = len(s) < 0.8 * usual and n + 1 < len(lines)
        if s and _PAGE.fullmatch(s) and not (s.isalpha() and s.lower() not in _ROMAN):
            kind = "page_number"
        elif s and (_title_like(s, short) or _title_like(_NUMBER_SIDE.sub("", s), short)):
            kind = "header"
        out.append(kind)
    return out


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


_ROMAN = frozenset(_roman(n) for n in range(1, 200))


def glyph_variants(word: str) -> set[str]:
    """What a word may have been before one misrecognition (or two of the same glyph, or of different ones in long words)."""
    once: set[str] = set()
    for seen, meant in _EDITS:
        at = word.find(seen)
        while at >= 0:
            once.add(word[:at] + meant + word[at + len(seen) :])
            at = word.find(seen, at + 1)
        if word.count(seen) > 1:
            once.add(word.replace(seen, meant))
    if not word.isalpha():  # digits or signs inside: several may be wrong
        fixed = word
        for seen, meant in _EDITS:
            if len(seen) == 1 and not seen.isalpha() and meant.isalpha() and meant.islower():
                fixed = fixed.replace(seen, meant)
        once.add(fixed)
    once.discard(word)
    return once


# ---- the lexicon


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def _words(text: str) -> list[str]:
    """Words as the lexicon has them: lower case, digits as 0; compounds whole."""
    return [_key(w) for w in _TOKEN.findall(text)]


def _key(word: str) -> str:
    return re.sub(r"\d", "0", word.lower()) if not word.isalpha() else word.lower()


def _flat(text: str) -> str:
    """Scripts without spaces: one string without white space, digits as 0."""
    return re.sub(r"\d+", "0", re.sub(r"\s+", "", text))


def _joined(text: str) -> str:
    """Clean text may be wrapped too: words broken at its line ends are joined (the hyphen is kept for compounds)."""
    return re.sub(rf"([^\W\d_])([{_HYPHENS}])[ \t]*\n[ \t]*(?=[^\W\d_])", r"\1\2", text)


def lexicon(clean: DataFrame, text: str) -> DataFrame:
    """(kind, word, bucket, n): kind w: words and pairs of characters; t: triples, word without its middle and the middle; s: skip-gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            triples: Counter[tuple[str, str]] = Counter()
            near: Counter[tuple[str, int]] = Counter()
            buckets: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                ws = _words(_joined(t))
                words.update(ws)
                words.update(p for w in ws if "-" in w for p in w.split("-"))
                for w in ws:
                    if w not in buckets:
                        buckets[w] = _hash(w) % BUCKETS
                bs = [buckets[w] for w in ws]
                for d in range(1, WINDOW + 1):
                    near.update(zip(ws, bs[d:]))
                    near.update(zip(ws[d:], bs))
                if _CJK.search(t):
                    u = _flat(t)
                    words.update(map("".join, zip(u, u[1:])))
                    triples.update((a + c, b) for a, b, c in zip(u, u[1:], u[2:]) if b > "⿿")
            rows = [("w", w, "", 0, n) for w, n in words.items()] + [("t", w, m, 0, n) for (w, m), n in triples.items()] + [("s", w, "", b, n) for (w, b), n in near.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 5, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["kind", "word", "middle", "bucket", "n"])

    raw = clean.select(F.col(text).alias("t")).mapInArrow(run, "kind string, word string, middle string, bucket int, n bigint")
    return raw.groupBy("kind", "word", "middle", "bucket").agg(F.sum("n").alias("n"))


def _bits(h: np.ndarray | int, bits: int):
    """Two slots of a 32-bit hash."""
    return h % (bits - 9), (h * 40503 + 12345) % (bits - 15)


def word_bitmap(words: DataFrame, bits: int | None = None) -> np.ndarray:
    """Of the words' two slots each, packed. It grows with the lexicon up to MOST_BITS, which bounds what the driver and the workers get."""
    if bits is None:
        bits = min(MOST_BITS, max(BITMAP_BITS, 1 << (BITS_A_WORD * words.count()).bit_length()))
    h = F.crc32(F.encode("word", "utf-8"))
    slots = words.select(F.explode(F.array(h % F.lit(bits - 9), (h * F.lit(40503) + F.lit(12345)) % F.lit(bits - 15))).alias("slot"))
    parts = slots.groupBy(F.shiftright("slot", 15).alias("part")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for part, m in parts:
        out[part * 4096 : part * 4096 + 4096] = np.frombuffer(m, np.uint8)
    return out


class Known:
    """Membership in the lexicon by its bitmap, remembered by word. False means unknown for sure."""

    def __init__(self, packed: np.ndarray) -> None:
        self._map, self._bits, self._seen = packed, len(packed) * 8, {}

    def _has(self, slot: int) -> bool:
        return bool(self._map[slot >> 3] >> (slot & 7) & 1)

    def __call__(self, word: str) -> bool:
        if (known := self._seen.get(word)) is None:
            if len(self._seen) > 300_000:
                self._seen.clear()
            a, b = _bits(_hash(word), self._bits)
            self._seen[word] = known = self._has(a) and self._has(b)
        return known


# ---- one text


def line_words(lines: list[str], kinds: list[str | None]) -> Iterator[tuple[int, int, int, int, str, int]]:
    """(line, offset, line of its end, offset there, word, length of its part on the first line) of the text lines, words joined across line ends."""
    carry: tuple[int, int, str] | None = None
    for i, x in enumerate(lines):
        if kinds[i] or not x.strip():
            continue
        found = [(m.start(), m[0]) for m in _TOKEN.finditer(x)]
        if carry and found:
            at, first = found.pop(0)
            yield carry[0], carry[1], i, at, carry[2] + first, len(carry[2])
            carry = None
        s = x.rstrip()
        if found and s[-1:] and s[-1] in _HYPHENS and found[-1][0] + len(found[-1][1]) == len(s) - 1:
            carry = (i, *found.pop())
        for at, w in found:
            yield i, at, i, at, w, len(w)
    if carry:
        yield carry[0], carry[1], carry[0], carry[1], carry[2], len(carry[2])


def is_break(left: str, right: str, hyphen: str, known) -> bool:
    """Whether a word was only broken for the line end, rather than a compound that has its own hyphen."""
    if hyphen in _SURE_HYPHENS:
        return True
    a, b = _key(left), _key(right)
    whole, compound = known(a + b), known(f"{a}-{b}")
    if whole != compound:
        return whole
    # neither form is known (a misrecognised character), or both are: two words of their own make a compound
    return not (known(a.split("-")[-1]) and known(b.split("-")[0]) and len(a) > 2 and len(b) > 2)


def examine(text: str, known, sure=frozenset()) -> tuple[list[tuple[int, str]], list[tuple]]:
    """(findings by line without char, suspects): suspects as in SUSPECT from line to middle.

    Words that are known but not sure are suspects too, to be verified.
    """
    lines = text.split("\n")
    kinds = furniture(lines)
    findings = [(i, k) for i, k in enumerate(kinds) if k]
    body = [i for i, x in enumerate(lines) if x.strip() and not kinds[i]]
    broken: set[int] = set()
    for i, j in zip(body, body[1:]):
        s = lines[i].rstrip()
        if s and s[-1] in _HYPHENS and len(s) > 1 and s[-2].isalpha():
            left, right = _TOKEN.findall(s[:-1]), _TOKEN.findall(lines[j])
            if left and right and s[:-1].endswith(left[-1]) and lines[j].lstrip()[:1].islower() and is_break(left[-1], right[0], s[-1], known):
                findings.append((i, "hyphen"))
                broken.add(i)
    suspects: list[tuple] = []
    words = list(line_words(lines, kinds))
    keys = [_key(w[4]) for w in words]
    for n, ((i, at, j, there, word, cut), key) in enumerate(zip(words, keys)):
        if key in sure or len(word) < 2 or not (any(map(str.isalpha, word))) or _CJK.search(word):
            continue
        if i != j and i not in broken:  # a compound with its own hyphen at the line end
            parts = [(i, at, i, at, word[:cut], cut), (j, there, j, there, word[cut:], len(word) - cut)]
        elif "-" in word and not known(key):
            parts, p = [], 0
            for x in word.split("-"):
                q = p + len(x)
                if q <= cut or i == j:
                    parts.append((i, at + p, i, at + p, x, len(x)))
                elif p >= cut:
                    parts.append((j, there + p - cut, j, there + p - cut, x, len(x)))
                else:
                    parts.append((i, at + p, j, there, x, cut - p))
                p = q + 1
        else:
            parts = [(i, at, j, there, word, cut)]
        near = None
        for *place, p, c in parts:
            k = _key(p)
            if len(p) > 1 and k not in sure and any(map(str.isalpha, p)) and (p != p.upper() or len(p) > 5):
                if near is None:
                    near = sorted(_hash(x) % BUCKETS for d in (-2, -1, 1, 2) if 0 <= n + d < len(keys) for x in (keys[n + d],) if known(x))
                suspects.append((*place, p, c, p.lower(), near, ""))
    if any(_CJK.search(lines[i]) for i in body):
        flat: list[tuple[str, int, int]] = []
        for i in body:
            for at, c in enumerate(lines[i]):
                if c.isspace():
                    continue
                if c.isdecimal():  # digits as 0, as in the lexicon
                    if flat and flat[-1][0] == "0":
                        continue
                    c = "0"
                flat.append((c, i, at))
        for (a, _, _), (b, i, at), (c, _, _) in zip(flat, flat[1:], flat[2:]):
            if b > "⿿" and _CJK.match(b) and not known(a + b) and not known(b + c):
                suspects.append((i, at, i, at, b, 1, a + c, [], b))
    return findings, suspects


#: An occurrence: its text (record, hash), where it starts and, across a line end, goes on, its word, the length of the part before
#: the line end, what it is looked up by, its neighbours' buckets, the Han character; or a finding of the given kind.
SUSPECT = "rec string, hash bigint, line int, at int, end_line int, end_at int, word string, cut int, key string, near array<int>, middle string, kind string"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}


def _scan(texts: DataFrame, key: Column, text: str, bitmap: np.ndarray, sure: list[str]) -> DataFrame:
    """SUSPECT rows of the texts; findings that need no correction have kind set."""
    sent = texts.sparkSession.sparkContext.broadcast((bitmap, sure))  # both of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, certain = Known(sent.value[0]), frozenset(sent.value[1])
        names, types = zip(*((n, _ARROW[t]) for n, t in (x.split() for x in SUSPECT.split(", "))))
        for batch in batches:
            rows = []
            for rec, t, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                findings, suspects = examine(t, known, certain)
                rows += [(rec, h, i + 1, 0, i + 1, 0, None, 0, None, [], None, kind) for i, kind in findings]
                rows += [(rec, h, i + 1, at, j + 1, there, w, cut, k, near, middle, None) for i, at, j, there, w, cut, k, near, middle in suspects]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * len(types), types)], names=list(names))

    return texts.select(key.alias("rec"), F.col(text).alias("t")).filter("t is not null and rec is not null").withColumn("hash", F.xxhash64("t")).mapInArrow(run, SUSPECT)


# ---- vectors and corrections


def _counts(grams: DataFrame) -> DataFrame:
    """(word, near): every word's neighbours as (bucket, n), at most BUCKETS of them."""
    return grams.groupBy("word").agg(F.collect_list(F.struct("bucket", "n")).alias("near"))


def _information(near: pa.Array, share: np.ndarray) -> np.ndarray:
    """One row a word: log of how much likelier each bucket is beside the word than anywhere, PRIOR neighbours drawn towards none."""
    row = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy(zero_copy_only=False))
    flat = near.flatten()
    counts = np.zeros((len(near), BUCKETS))
    counts[row, flat.field("bucket").to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
    return np.maximum(np.log((counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR) / share), LEAST)


def axes(grams: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(share of each bucket, the leading axes of the words' information, BUCKETS x rank).

    The factorisation needs the words' second moments only: a matrix of BUCKETS x BUCKETS, summed up by task and
    then by row and column, whatever the number of words.
    """
    share = np.full(BUCKETS, 1e-9)
    for b, n in grams.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        share[b] += n
    share /= share.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, BUCKETS))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                x = _information(batch.column("near").slice(start, 4096), share)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BUCKETS), BUCKETS), pa.int32()), pa.array(np.tile(np.arange(BUCKETS), BUCKETS), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    moments = np.zeros((BUCKETS, BUCKETS))
    for i, j, v in _counts(grams).select("near").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # BUCKETS ** 2 rows
        moments[i, j] = v
    return share, np.linalg.eigh(moments)[1][:, ::-1][:, :rank].copy()


def word_vectors(grams: DataFrame, share: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(word, vector): how well each bucket agrees with the word, as its learned vector (its information along the axes) says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _information(batch.column("near"), share) @ basis @ basis.T
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float32)), BUCKETS).cast(pa.list_(pa.float32()))], names=["word", "vector"])

    return _counts(grams).mapInArrow(run, "word string, vector array<float>")


def corrections(suspects: DataFrame, lex: DataFrame) -> DataFrame:
    """(key, near, middle, candidate): for each suspect word and context the frequent word that glyph edits make of it and that agrees best.

    Words that the lexicon has are none. Without known neighbours the frequency decides. Contexts are counted once
    however often they occur, so a word that a third of all suspects share is spread over its contexts. The joins
    are hinted to be merge joins: sides that shrink in the shuffle but are large in memory are not broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, _key(v)) for k in batch.column(0).to_pylist() for v in sorted(glyph_variants(k))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["key", "candidate"])

    words = lex.filter("kind = 'w'").select("word", "n")
    contexts = suspects.filter("middle = ''").groupBy("key", "near").agg(F.lit(1))
    asked = contexts.select("key").distinct().withColumn("word", F.regexp_replace("key", "\\p{Nd}", "0"))
    unknown = asked.join(words.hint("merge"), "word", "left_anti").select("key")
    linked = unknown.mapInArrow(run, "key string, candidate string").distinct().join(words.filter(F.col("n") >= MIN_COUNT).withColumnRenamed("word", "candidate").hint("merge"), "candidate")
    linked = cut_lineage(linked)
    frequent = words.filter(F.col("n") >= MIN_COUNT).select("word")
    grams = lex.filter("kind = 's'").select("word", "bucket", "n").join(frequent.hint("merge"), "word", "left_semi")
    wanted = grams.join(linked.select(F.col("candidate").alias("word")).distinct().hint("merge"), "word", "left_semi")
    vectors = word_vectors(wanted, *axes(grams)).withColumnRenamed("word", "candidate")
    # candidates of one key: at most as many as glyph edits of one word
    choices = linked.join(vectors.hint("merge"), "candidate", "left").groupBy("key").agg(F.collect_list(F.struct("candidate", "n", "vector")).alias("choices"))

    def judged(c: Column) -> Column:
        together = F.aggregate("near", F.lit(0.0), lambda acc, b: acc + F.coalesce(F.get(c["vector"], b), F.lit(0.0)))
        agreement = F.when(F.size("near") > 0, together / F.size("near")).otherwise(F.lit(0.0))
        return F.when(agreement >= MIN_AGREEMENT, F.struct((agreement + F.log(c["n"]) / 4).alias("score"), c["candidate"].alias("candidate")))

    best = contexts.join(choices.hint("merge"), "key").withColumn("b", F.array_max(F.transform("choices", judged))).filter("b is not null")
    han = suspects.filter("middle <> ''").select("key", "middle").distinct()
    triples = lex.filter("kind = 't'").filter(F.col("n") >= MIN_COUNT).select(F.col("word").alias("key"), F.col("middle").alias("meant"), "n")
    fixed = han.join(triples.hint("merge"), "key").filter("middle <> meant").groupBy("key", "middle").agg(F.max(F.struct("n", "meant")).alias("b"))
    none = F.array().cast("array<int>")
    return best.select("key", "near", F.lit("").alias("middle"), "b.candidate").unionByName(fixed.select("key", none.alias("near"), "middle", F.col("b.meant").alias("candidate")))


def _prepare(texts: DataFrame, key: Column, text: str, clean: DataFrame, clean_text: str) -> tuple[DataFrame, DataFrame]:
    """(SUSPECT rows, those that have a correction with their candidate), the former materialised."""
    lex = cut_lineage(lexicon(clean, clean_text))
    words = lex.filter("kind = 'w'")
    sure = [r.word for r in words.orderBy(F.desc("n"), "word").limit(SURE_WORDS).select("word").collect()]
    rows = cut_lineage(_scan(texts, key, text, word_bitmap(words), sure))
    suspects = rows.filter("kind is null")
    return rows, suspects.join(corrections(suspects, lex).hint("merge"), ["key", "near", "middle"])


def findings(texts: DataFrame, key: Column, text: str, clean: DataFrame, clean_text: str) -> DataFrame:
    """(rec, line_no, kind) of the noisy lines: hyphen, char, header, page_number.

    key: a string column expression; rows with a null key or text have none. clean: text without scan noise
    to learn from. Rows delivered twice give their findings once; differing texts of one key give those of each.
    Other columns are ignored.
    """
    rows, wrong = _prepare(texts, key, text, clean, clean_text)
    plain = rows.filter("kind is not null").select("rec", F.col("line").alias("line_no"), "kind")
    # a word across a line end: the noise is where the correction differs
    same_start = F.expr("substring(lower(word), 1, cut) = substring(candidate, 1, cut)")
    char = wrong.select("rec", F.when((F.col("line") == F.col("end_line")) | ~same_start, F.col("line")).otherwise(F.col("end_line")).alias("line_no"), F.lit("char").alias("kind"))
    return plain.unionByName(char).distinct()


def _own_digits(word: str, candidate: str) -> str:
    """A candidate has 0 for every digit; the variant of the scan's word that it stands for has the scan's own."""
    if "0" not in candidate:
        return candidate
    digits = re.sub(r"\D", "", word)
    same = sorted((re.sub(r"\D", "", v) != digits, v) for v in glyph_variants(word.lower()) if _key(v) == candidate)
    return same[0][1] if same else candidate


def in_case_of(word: str, right: str) -> str:
    """The correction with the scan's own characters wherever both agree but for case; capitals where the scan has them."""
    low, n, m = word.lower(), len(word), len(right)
    if len(low) != n:
        return right
    p = 0
    while p < min(n, m) and low[p] == right[p]:
        p += 1
    q = 0
    while q < min(n, m) - p and low[n - 1 - q] == right[m - 1 - q]:
        q += 1
    middle = right[p : m - q]
    letters = [c for c in word if c.isalpha()]
    if sum(map(str.isupper, letters)) > len(letters) / 2 and len(letters) > 1:
        middle = middle.upper()
    elif p == 0 and word[0].isupper():
        middle = middle[:1].upper() + middle[1:]
    return word[:p] + middle + word[n - q :]


def reflow(text: str, edits: dict[int, list[tuple[int, int, str]]], breaks: set[int], gone: set[int]) -> str:
    """One text as continuous paragraphs: furniture out, broken words joined, lines joined.

    edits: (start, end, text instead) by line; they do not overlap.
    """
    out: list[str] = []
    join = ""
    blank = False
    for i, line in enumerate(text.split("\n"), 1):
        if i in gone:
            continue
        for start, end, instead in sorted(edits.get(i, ()), reverse=True):
            line = line[:start] + instead + line[end:]
        s = line.strip()
        if not s:
            blank = blank or not out or bool(re.search(r"[.!?。！？…:：”’」)]$", out[-1]))
            continue
        if out and not (blank and join == " "):
            if s[0] == "|" == out[-1][-1]:  # rows of a table stay rows
                out[-1] += "\n" + s
            elif join == "" or (_CJK.match(s[0]) and _CJK.search(out[-1][-1:])):
                out[-1] += s
            else:
                out[-1] += join + s
        else:
            out.append(s)
        blank, join = False, " "
        if i in breaks:
            out[-1], join = out[-1][:-1], ""
        elif out[-1][-1:] in tuple(_HYPHENS):
            join = ""
    return "\n\n".join(re.sub(r"[ \t ]{2,}", " ", p) for p in out)


def _edits(words: list[dict]) -> dict[int, list[tuple[int, int, str]]]:
    """By line. A word across a line end stays parted, at any place but its end: the parts are joined as the text is reflowed."""
    out: dict[int, list[tuple[int, int, str]]] = {}
    for x in words:
        word = x["word"]
        right = in_case_of(word, _own_digits(word, x["candidate"]))
        if x["line"] == x["end_line"]:
            out.setdefault(x["line"], []).append((x["at"], x["at"] + len(word), right))
        else:
            cut = min(x["cut"], len(right) - 1)
            out.setdefault(x["line"], []).append((x["at"], x["at"] + x["cut"], right[:cut]))
            out.setdefault(x["end_line"], []).append((x["end_at"], x["end_at"] + len(word) - x["cut"], right[cut:]))
    return out


def repaired(texts: DataFrame, key: Column, text: str, clean: DataFrame, clean_text: str) -> DataFrame:
    """(rec, repaired): every distinct text of every key as continuous readable paragraphs; null for null texts."""
    rows, wrong = _prepare(texts, key, text, clean, clean_text)
    plain = rows.filter("kind is not null").groupBy("rec", "hash").agg(F.collect_set(F.struct("line", "kind")).alias("furniture"))
    fixes = wrong.groupBy("rec", "hash").agg(F.collect_set(F.struct("line", "at", "end_line", "end_at", "word", "cut", "candidate")).alias("words"))
    source = texts.select(key.alias("rec"), F.col(text).alias("t")).distinct().withColumn("hash", F.xxhash64("t")).join(plain, ["rec", "hash"], "left").join(fixes, ["rec", "hash"], "left")
    schema = T.StructType([T.StructField("rec", T.StringType()), T.StructField("repaired", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, f, w in zip(*(batch.column(n).to_pylist() for n in ("t", "furniture", "words"))):
                marks = {kind: {x["line"] for x in f or [] if (x["kind"] == "hyphen") == kind} for kind in (True, False)}
                out.append(None if t is None else reflow(t, _edits(w or []), marks[True], marks[False]))
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(out, pa.string())], names=["rec", "repaired"])

    return source.mapInArrow(run, schema)
