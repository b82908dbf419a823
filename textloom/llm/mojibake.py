"""Text that was decoded with the wrong character encoding.

Words here are windows of three characters with a non-ASCII one in the middle: that unit exists in
scripts with and without spaces, and 21 bits a character make it one 63-bit integer. A window counts once
for each distinct paragraph that holds it, so neither copies nor repetition make a garbled form look
frequent; only where these counts are alike, those with copies decide, with bounded weight. Every window
that can be frequent enough is garbled under all encoding chains; a garbled form that itself occurs in the
corpus, clearly more rarely than its original, is a known garbled form. The documents' own windows are then
hash-joined with the known garbled forms.

Passes over the text are vectorised: one array operation a batch, no Python step a character. Before the
count the distinct paragraphs with non-ASCII characters are shuffled once, after it only windows with their
counts, pre-summed a batch. A bitmap of bounded size keeps windows that cannot match out of the joins; the
joins stay exact.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import cut_lineage

#: A garbled form must be RATIO times as rare as its original. It occurs at least once, so originals rarer than RATIO can have none.
RATIO = 1.2
#: The most that counts with copies are taken for, where those of distinct paragraphs are alike.
MOST_BY_COPIES = 2.0
#: Clean windows may be garbled forms of each other by chance, the likelier the longer the text. A paragraph counts if the binary
#: logarithms of its distinct forms' rarity (original : form) add up to EVIDENCE for each of its distinct windows.
EVIDENCE = 0.2
#: Least and most bits of the bitmaps that are sent to all workers (1 and 32 MB) and bits for each window between them.
#: They only keep windows out of joins, which are exact: beyond the bound more windows are shuffled, none is lost.
BITMAP_BITS, MOST_BITS, BITS_A_WINDOW = 1 << 23, 1 << 28, 16
SEPARATOR = "\n\n"

#: The encodings that texts are written in (by script) and wrongly read in.
WRITTEN = {
    "latin": ("utf-8", "cp1252", "mac_roman", "cp850"),
    "cyrillic": ("utf-8", "cp1251", "koi8-r", "cp866"),
    "han": ("utf-8", "gbk", "big5", "cp932", "euc_jp"),
    "kana": ("utf-8", "cp932", "euc_jp"),
}
READ_SINGLE = ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850")
READ_MULTI = ("gb18030", "big5", "cp932", "euc_jp", "utf-8")


def _byte_table(encoding: str) -> str:
    """What each byte reads as; undefined bytes read as the control characters of the same number."""
    return "".join((bytes([b]).decode(encoding, "ignore") or chr(b)) for b in range(256))


_TABLES = {e: _byte_table(e) for e in {*READ_SINGLE, *(w for ws in WRITTEN.values() for w in ws if w not in ("utf-8", "gbk", "big5", "cp932", "euc_jp"))}}
_READ = {e: dict(enumerate(t)) for e, t in _TABLES.items()}
_WRITE = {e: {ord(c): b for b, c in reversed(list(enumerate(t)))} for e, t in _TABLES.items()}


def encode(text: str, encoding: str) -> bytes | None:
    """Strict; None if the encoding lacks a character. Single-byte encodings use the full byte table."""
    if encoding in _WRITE:
        table = _WRITE[encoding]
        try:
            return bytes([table[ord(c)] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def read_wrongly(data: bytes, encoding: str) -> str:
    if encoding in _READ:
        return data.decode("latin-1").translate(_READ[encoding])
    return data.decode(encoding, "replace")


def script_of(text: str) -> str:
    kinds = {"kana" if 0x3040 <= c < 0x3100 else "han" if 0x3000 <= c < 0xA000 or 0xFF00 <= c < 0xFFF0 else "cyrillic" if 0x400 <= c < 0x500 else "latin" for c in map(ord, text) if c > 0x7F}
    return next((k for k in ("kana", "han", "cyrillic") if k in kinds), "latin")


# ---- windows as integers


def codes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, windows) of all non-ASCII characters of a text; beyond its ends are spaces."""
    u = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    at = np.flatnonzero(u[1:-1] > 0x7F)
    return at, (u[at] << 42) | (u[at + 1] << 21) | u[at + 2]


def window_text(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _wordlike(codes: np.ndarray) -> np.ndarray:
    """Windows with a letter, digit or another non-ASCII character beside the middle one: a lone sign among spaces says nothing."""

    def solid(c: np.ndarray) -> np.ndarray:
        return (c > 0x7F) | ((c >= 0x30) & (c <= 0x39)) | (((c | 32) >= 0x61) & ((c | 32) <= 0x7A))

    return solid(codes >> 42) | solid(codes & 0x1FFFFF)


def _lost(codes: np.ndarray) -> np.ndarray:
    """Windows around a replacement character that are not wordlike: a lost dash, or junk."""
    return ((codes >> 21 & 0x1FFFFF) == 0xFFFD) & ~_wordlike(codes)


def _in_bitmap(packed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """False: the window is in none of the rows that the bitmap was made of."""
    slots = codes % (len(packed) * 8 - 9)
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def garbled_windows(codes: np.ndarray, keep) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(garbled windows, indexes of their originals, chain) for every chain. keep(codes) -> mask of those wanted.

    All originals of a script pass through a chain in one call, as lines of one text. Multi-byte readers
    may also start inside a character, so they read from either offset.
    """
    by_script: dict[str, list[int]] = defaultdict(list)
    words = [window_text(int(c)) for c in codes]
    for i, w in enumerate(words):
        if "\n" not in w and "\r" not in w and (any(map(str.isalpha, w)) or unicodedata.category(w[1]) in ("Pd", "Pi", "Pf")):
            by_script[script_of(w)].append(i)

    def lines_of(items: list[bytes], step) -> list[str]:
        """Each item's text by one call for all; one by one where a step makes or takes line ends, so that no chain is left out."""
        lines = step(b"\n".join(items)).split("\n")
        return lines if len(lines) == len(items) else [step(x).replace("\n", " ") for x in items]

    def emit(lines: list[str], index: np.ndarray, chain: str):
        text = "\n".join(lines)
        at, found = codes_of(text)
        u = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        line = np.cumsum(u == 10)[at] if len(at) else at
        inside = ((found >> 42) != 10) & ((found & 0x1FFFFF) != 10) & (at > 0) & (at < len(u) - 1)
        found, line = found[inside], line[inside]
        own = index[line]
        mask = keep(found) & (found != codes[own]) & (_wordlike(found) | _lost(found))
        if mask.any():
            yield found[mask], own[mask], chain

    for script, members in by_script.items():
        for written in WRITTEN[script]:
            data = [(i, b) for i in members if (b := encode(words[i], written)) is not None]
            if not data:
                continue
            index = np.array([i for i, _ in data])
            for read in (*READ_SINGLE, *READ_MULTI):
                if read == written or {read, written} == {"gb18030", "gbk"} or (written, read) == ("cp1252", "latin-1"):
                    continue
                for offset in (0,) if read in READ_SINGLE else (0, 1):
                    lines = lines_of([b[offset:] for _, b in data], lambda x, read=read: read_wrongly(x, read))
                    chain = f"{written}>{read}"
                    if read in READ_MULTI:  # the last character may have been cut by the window's end
                        lines = [s[:-1] if s.endswith("�") and not words[i].endswith("�") else s for s, i in zip(lines, index)]
                    yield from emit(lines, index, chain)
                    if written == "utf-8" and read in ("cp1252", "latin-1"):
                        yield from emit(lines_of([s.encode() for s in lines], lambda x, read=read: read_wrongly(x, read)), index, f"{chain} twice")
                    if (written, read) == ("gbk", "utf-8"):  # the replacement characters were read wrongly once more
                        for again in (0, 1, 2):
                            yield from emit(lines_of([s.encode()[again:] for s in lines], lambda x: read_wrongly(x, "gbk")), index, "gbk>utf-8>gbk")
            if written == "utf-8":
                for read in ("gbk", "cp932", "cp1252"):  # read wrongly, saved with losses, read rightly
                    for offset in (0, 1, 2):

                        def lossy(x: bytes, read: str = read) -> str:
                            return x.decode(read, "replace").encode(read, "replace").decode("utf-8", "replace")

                        yield from emit(lines_of([b[offset:] for _, b in data], lossy), index, f"utf-8>{read}>?")


# ---- passes over the text


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 2000):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _joined(texts: list[str]) -> str:
    """The texts with a NUL after each but the last. A text's own NULs become another control character, one for one, so NULs are ends of texts and nothing else."""
    return "\x00".join([t.replace("\x00", "\x01") if "\x00" in t else t for t in texts])


def count_windows(texts: DataFrame, text: str) -> DataFrame:
    """(code, n, copies): in how many distinct paragraphs of the texts each window occurs, and in how many with their copies."""

    def run(batches):
        for batch in _batches(batches):
            joined, held = _joined(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            at, codes = codes_of(joined)
            ends = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32) == 0)
            para = np.searchsorted(ends, at)
            order = np.lexsort((para, codes))
            codes, para = codes[order], para[order]
            once = np.ones(len(codes), bool)
            once[1:] = (codes[1:] != codes[:-1]) | (para[1:] != para[:-1])
            found, first = np.unique(codes[once], return_index=True)
            n = np.diff(np.append(first, once.sum()))
            copies = np.add.reduceat(held[para[once]], first) if len(found) else n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (found, n, copies)], names=["code", "n", "copies"])

    paragraphs = texts.select(F.explode(F.split(F.col(text).cast("string"), SEPARATOR)).alias("t")).filter("char_length(t) <> octet_length(t)")
    # copies are collapsed map-side first, so a paragraph held very often is no hot group
    distinct = paragraphs.groupBy("t").agg(F.count("*").alias("copies"))
    return distinct.mapInArrow(run, "code bigint, n bigint, copies bigint").groupBy("code").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))


def bitmap(codes: DataFrame, bits: int | None = None) -> np.ndarray:
    """A packed bitmap of the slots of the codes. It grows with their number up to MOST_BITS, which bounds what reaches the driver and the workers."""
    if bits is None:
        bits = min(MOST_BITS, max(BITMAP_BITS, 1 << (BITS_A_WINDOW * codes.count()).bit_length()))
    # groups of 2 ** 15 slots: Spark's own fixed size for one bitmap
    parts = codes.groupBy(F.expr(f"shiftright(code % {bits - 9}L, 15)").alias("part")).agg(F.expr(f"bitmap_construct_agg((code % {bits - 9}L) % 32768)").alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for part, m in parts:
        out[part * 4096 : part * 4096 + 4096] = np.frombuffer(m, np.uint8)
    return out


def known_garbled(texts: DataFrame, text: str = "text", ratio: float = RATIO, bits: int | None = None) -> DataFrame:
    """(code, original, ratio, chain): the garbled forms that occur in the texts, materialised."""
    windows = cut_lineage(count_windows(texts, text))
    spark = texts.sparkSession
    seen = spark.sparkContext.broadcast(bitmap(windows, bits))

    def run(batches):
        there = seen.value
        for batch in _batches(batches, 20_000):
            codes, n, copies = (batch.column(i).to_numpy() for i in range(3))
            for found, own, chain in garbled_windows(codes, lambda c: _in_bitmap(there, c)):
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (found, n[own], copies[own], codes[own])), pa.array([chain] * len(own))], names=["code", "n_original", "copies_original", "original", "chain"])

    # a row becomes dozens of encodings: the number of tasks must not shrink with the rows' size
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forms = windows.filter(F.col("copies") >= ratio).repartition(tasks, "code").mapInArrow(run, "code bigint, n_original bigint, copies_original bigint, original bigint, chain string")
    best = forms.groupBy("code").agg(F.max(F.struct("n_original", "copies_original", "original", "chain")).alias("b"))
    by_text, by_copies = F.col("b.n_original") / F.col("n"), F.col("b.copies_original") / F.col("copies")
    rarity = F.when(by_text >= ratio, by_text).when((by_text >= 1) & (by_copies >= ratio), F.least(by_copies, F.lit(MOST_BY_COPIES)))
    return cut_lineage(best.join(windows, "code").select("code", "b.original", rarity.alias("ratio"), "b.chain").filter("ratio is not null"))


def paragraph_hits(texts: DataFrame, garbled: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """(key, para_no, n_windows, code, original, ratio, chain): the known garbled forms in each paragraph (texts are split at each blank line) and how many distinct windows it has."""
    source = texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).filter("_text is not null")
    sent = source.sparkSession.sparkContext.broadcast(bitmap(garbled, bits))
    key_type = source.schema["_key"].dataType

    def run(batches):
        there = sent.value
        for batch in _batches(batches):
            joined = _joined(batch.column(1).to_pylist())
            at, codes = codes_of(joined)
            mask = _in_bitmap(there, codes)
            every, at, codes_every, codes = at, at[mask], codes, codes[mask]
            u = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            letters = np.concatenate([[0], np.cumsum((((u | 32) >= 0x61) & ((u | 32) <= 0x7A)) | ((u >= 0xC0) & (u < 0x2000)) | ((u > 0x2FFF) & (u < 0xE000)))])
            doc_ends = np.flatnonzero(u == 0)
            breaks = np.array([m.start() for m in re.finditer(SEPARATOR, joined)], np.int64)
            doc = np.searchsorted(doc_ends, at)
            starts = np.concatenate([[-1], doc_ends])[doc]
            para = np.searchsorted(breaks, at) - np.searchsorted(breaks, starts) + 1
            # windows of the paragraph around each hit: those between the ends around it
            ends = np.sort(np.concatenate([doc_ends, breaks, [-1, len(u)]]))
            here = np.searchsorted(ends, at)
            first, last = np.maximum(ends[here - 1], 0), ends[here]
            sound = ~_lost(codes) | (2 * (letters[last] - letters[first]) >= last - first)  # a lost sign in junk is no case
            # the first of each window in its paragraph: the bar counts distinct windows, as the evidence does
            at_para = np.searchsorted(ends, every)
            order = np.lexsort((codes_every, at_para))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(codes_every[order]) != 0) | (np.diff(at_para[order]) != 0)
            n = np.bincount(at_para[order][new], minlength=len(ends))[here]
            rows = np.unique(np.stack([doc, para, codes, n], 1)[sound], axis=0) if len(at) else np.empty((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2]), pa.array(rows[:, 3].astype(np.int32))], names=["_key", "para_no", "code", "n_windows"]
            )

    schema = T.StructType([T.StructField("_key", key_type), T.StructField("para_no", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("n_windows", T.IntegerType())])
    return source.mapInArrow(run, schema).join(garbled, "code").withColumnRenamed("_key", key)


def _evident() -> Column:
    """Over the distinct hits of one paragraph."""
    return F.sum(F.log2("ratio")) >= F.max("n_windows") * EVIDENCE


def garbled_paragraphs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, para_no) of the paragraphs that hold a known garbled form.

    Null and empty texts have none. Rows with the same key and text count once; other columns are
    ignored. NUL characters in a text are read as control characters that end nothing.
    """
    hits = paragraph_hits(texts, known_garbled(texts, text), key, text).select(key, "para_no", "code", "n_windows", "ratio").distinct()
    return hits.groupBy(key, "para_no").agg(_evident().alias("evident")).filter("evident").select(key, "para_no")


# ---- restoring


def undo(text: str, chain: str) -> str | None:
    """The text before it went through a chain; None if the chain lost something."""
    steps = chain.split(" ")
    written, *read = steps[0].split(">")
    if len(read) != 1:
        return None
    for _ in range(len(steps)):  # "a>b twice" has two steps
        data = encode(text, read[0])
        if data is None:
            return None
        try:
            text = data.decode("latin-1").translate(_READ[written]) if written in _READ else data.decode(written)
        except UnicodeDecodeError:
            return None
    return text


_SPAN = re.compile(r"\S*[^\x00-\x7f]\S*")


def restore(paragraph: str, chains: list[str], originals: list[str]) -> str | None:
    """Undo the best chain for the whole paragraph, or for its words that hold garbled forms; None if neither brings back the originals."""
    best, score = None, 0
    for chain in chains:
        whole = undo(paragraph, chain)
        mixed = _SPAN.sub(lambda m: undo(m[0], chain) or m[0], paragraph)
        for candidate in (whole, mixed):
            if candidate is not None and candidate != paragraph:
                hit = sum(o.strip() in candidate for o in originals)
                if hit > score:
                    best, score = candidate, hit
    return best


def repaired_paragraphs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, para_no, chain, restored): the affected paragraphs with their original text, null where it cannot be restored."""
    hits = paragraph_hits(texts, known_garbled(texts, text), key, text)
    per = hits.groupBy(key, "para_no").agg(F.collect_set("chain").alias("chains"), F.collect_set("original").alias("originals"), F.expr("mode(chain, true)").alias("chain"), _evident().alias("evident")).filter("evident")
    paragraphs = texts.select(F.col(key), F.posexplode(F.split(text, SEPARATOR)).alias("p", "paragraph")).withColumn("para_no", F.col("p") + 1)
    source = per.join(paragraphs, [key, "para_no"])

    def run(batches):
        for batch in batches:
            d = batch.to_pydict()
            out = [restore(p, cs, [window_text(o) for o in os]) for p, cs, os in zip(d["paragraph"], d["chains"], d["originals"])]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("para_no"), batch.column("chain"), pa.array(out, pa.string())], names=["_key", "para_no", "chain", "restored"])

    schema = T.StructType([T.StructField("_key", texts.schema[key].dataType), T.StructField("para_no", T.IntegerType()), T.StructField("chain", T.StringType()), T.StructField("restored", T.StringType())])
    return source.select(F.col(key).alias("_key"), "para_no", "chain", "chains", "originals", "paragraph").mapInArrow(run, schema).withColumnRenamed("_key", key)
