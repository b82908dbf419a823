"""Markdown documents as typed blocks, and image sizes from file headers."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)$")
_RULE = re.compile(r"\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?$")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,3}[.)])\s+(.*)")
_CAPTION = re.compile(r"(?:\*\*)?(?:Figure|Fig\.|Table|Tab\.|图|表)\s*\d+")
_TABLE_CAPTION = re.compile(r"(?:\*\*)?(?:Table|Tab\.|表)")


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def _html(rows: list[list[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def markdown_blocks(text: str) -> list[tuple[str, str | None, int | None, str | None, str | None]]:
    """(kind, text, level, caption, path) in order: heading (levels over 3 as 3), prose, code, equation, table (as HTML), figure, list.

    A caption line stands for the figure or table next to it: the one just before, else the next of its kind; it
    outweighs an image's own alternative text. A caption without either is prose. Front matter between lines of --- is prose, line by line.
    """
    out: list[list] = []
    lines = text.replace("\r\n", "\n").split("\n")
    i, waiting = 0, None
    if lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        end = next(k for k, x in enumerate(lines[1:], 1) if x.strip() == "---")
        out += [["prose", x.strip(), None, None, None] for x in lines[1:end] if x.strip()]
        i = end + 1

    def float_block(kind: str, body: str | None, path: str | None, own: str | None) -> None:
        nonlocal waiting
        if waiting and waiting[0] == kind:
            own, waiting = waiting[1], None
        out.append([kind, body, None, own, path])

    while i < len(lines):
        line = lines[i].strip()
        if not line:
            i += 1
        elif fence := _FENCE.match(lines[i]):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(fence[1])), len(lines))
            out.append(["code", "\n".join(lines[i + 1 : end]), None, None, None])
            i = end + 1
        elif heading := _HEADING.match(line):
            out.append(["heading", heading[2], min(len(heading[1]), 3), None, None])
            i += 1
        elif line.startswith("$$"):
            end = i if line.endswith("$$") and len(line) > 3 else next((k for k in range(i + 1, len(lines)) if lines[k].strip().endswith("$$")), len(lines) - 1)
            out.append(["equation", "\n".join(x.strip() for x in lines[i : end + 1]).strip("$").strip(), None, None, None])
            i = end + 1
        elif image := _IMAGE.match(line):
            float_block("figure", None, image[2], image[1] or None)
            i += 1
        elif "|" in line and i + 1 < len(lines) and _RULE.match(lines[i + 1].strip()):
            end = next((k for k in range(i + 2, len(lines)) if "|" not in lines[k]), len(lines))
            float_block("table", _html([_cells(line)] + [_cells(x) for x in lines[i + 2 : end]]), None, None)
            i = end
        elif _ITEM.match(lines[i]):
            end = next((k for k in range(i + 1, len(lines)) if not _ITEM.match(lines[k])), len(lines))
            out.append(["list", "\n".join(_ITEM.match(x)[1] for x in lines[i:end]), None, None, None])
            i = end
        else:
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or _FENCE.match(lines[k]) or _HEADING.match(lines[k].strip()) or _IMAGE.match(lines[k].strip())), len(lines))
            paragraph = " ".join(x.strip() for x in lines[i:end])
            kind = "table" if _TABLE_CAPTION.match(paragraph) else "figure"
            if not _CAPTION.match(paragraph):
                out.append(["prose", paragraph, None, None, None])
            elif out and out[-1][0] == kind and out[-1][3] is None:
                out[-1][3] = paragraph
            else:
                if waiting:
                    out.append(["prose", waiting[1], None, None, None])
                waiting = (kind, paragraph)
            i = end
    if waiting:
        out.append(["prose", waiting[1], None, None, None])
    return [tuple(x) for x in out]


def read_markdown(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_index, kind, text, level, caption, path) of every text; null and blank texts have no block. Other columns are ignored."""
    source = texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).filter("_text is not null")
    names = ("kind", "text", "level", "caption", "path")
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    schema = T.StructType([T.StructField("_key", source.schema["_key"].dataType), T.StructField("block_index", T.IntegerType()), *(T.StructField(n, T.IntegerType() if n == "level" else T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *b) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, b in enumerate(markdown_blocks(t))]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), *(pa.array(c, t) for c, t in zip(columns[2:], types))], names=["_key", "block_index", *names])

    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF or JPEG; None for anything else or a cut header. Nothing is decoded."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24 and data[12:16] == b"IHDR":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame, not tables
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def image_resolution(images: DataFrame, group: str, content: str, least: int = 800) -> DataFrame:
    """(group, images, readable, wide, share): images with a header that can be read, those at least ``least`` pixels wide, and their share (null without a readable one)."""
    source = images.select(F.col(group).alias("_g"), F.substring(content, 1, 1 << 16).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s and s[0] for s in sizes], pa.int32())], names=["_g", "width"])

    schema = T.StructType([T.StructField("_g", source.schema["_g"].dataType), T.StructField("width", T.IntegerType())])
    a = source.mapInArrow(run, schema).groupBy(F.col("_g").alias(group)).agg(F.count("*").alias("images"), F.count("width").alias("readable"), F.count_if(F.col("width") >= least).alias("wide"))
    return a.withColumn("share", F.round(F.try_divide(F.col("wide").cast("double"), F.col("readable").cast("double")), 6))
