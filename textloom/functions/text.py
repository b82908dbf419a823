"""Column functions on text that Spark does not ship."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's str.strip() takes as white space, as a Java character class.
SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


@functools.cache
def _unsettled_class() -> str:
    """Java class of the characters whose presence may make a string differ from its NFC form."""
    spans: list[list[int]] = []
    for cp in range(0x300, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or 0x1160 <= cp <= 0x11FF or not unicodedata.is_normalized("NFC", ch) or unicodedata.category(ch) == "Mc":
            if spans and cp - spans[-1][1] <= 64:  # a superset is fine and keeps the class short
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(text: Column) -> Column:
    """NFC form. Only strings that may change leave the JVM: all others are sent as null."""
    return F.coalesce(_nfc(F.when(text.rlike(_unsettled_class()), text)), text)


#: Entries that one fold adds up; longer arrays fold over such blocks and then over the blocks.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _totals(lengths: Column) -> Column:
    """array of the sums before each entry and, last, of all."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def running_starts(lengths: Column) -> Column:
    """The sum of the entries before each entry of an int array, in about linear time (a further entry may follow)."""

    def blocks(ls: Column) -> Column:
        n = F.ceil(F.size(ls) / F.lit(BLOCK)).cast("int")
        own = F.transform(F.sequence(F.lit(0), n - 1), lambda b: _totals(F.slice(ls, b * BLOCK + 1, BLOCK)))

        def placed(parts: Column) -> Column:
            bases = _totals(F.transform(parts, lambda p: F.element_at(p, -1)))
            return let(bases, lambda base: F.flatten(F.transform(parts, lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda at: at + F.get(base, b)))))

        return let(own, placed)

    return F.when(F.size(lengths) <= BLOCK, _totals(lengths)).otherwise(blocks(lengths))


def over_pieces(text: Column, pieces: Column, body: Callable[[Column, Column, Callable[[Column, Column], Column]], Column]) -> Column:
    """body(piece, start, cut) of every piece of a text, without nulls; cut(offset, n) are n characters of the text from an offset in the piece.

    They are cut from the text of a block of pieces, not each from the whole text: about linear time for any number of pieces.
    """

    def all_of(at: Column) -> Column:
        def of_block(b: Column) -> Column:
            base = F.get(at, b * BLOCK)
            block = F.substring(text, base + 1, F.coalesce(F.get(at, (b + 1) * BLOCK), F.length(text)) - base)

            def one(t: Column) -> Column:
                def made(p: Column, i: Column) -> Column:
                    start = F.get(at, b * BLOCK + i)
                    return body(p, start, lambda offset, n: F.substring(t, start - base + offset + 1, n))

                return F.transform(F.slice(pieces, b * BLOCK + 1, BLOCK), made)

            return let(block, one)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / F.lit(BLOCK)).cast("int") - 1), of_block))

    return let(running_starts(F.transform(pieces, F.length)), lambda at: F.array_compact(all_of(at)))


def blank_out(text: Column, pattern: str, rest: str) -> Column:
    """The text with every match of ``pattern`` as spaces, one for one. ``rest``: what may lie between matches, as alternatives."""
    pieces = F.regexp_extract_all(text, F.lit(f"{pattern}|{rest}"), 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^(?:{pattern})$"), F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")
