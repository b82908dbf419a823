"""Extension points: what a language needs for the metrics, metric providers and language detectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexical as L
from textloom.operators import prose as P


@dataclass(frozen=True)
class Adapter:
    """Column builders of one language: sentences of a text, units of a sentence, hits of phrases in a sentence."""

    sentences: Callable[[Column], Column]
    units: Callable[[Column], Column]
    hits: Callable[[Column, list[str]], Column]


_ADAPTERS: dict[str, Adapter] = {}


def register(language: str, adapter: Adapter) -> None:
    """A later adapter of a language takes the place of an earlier one."""
    _ADAPTERS[language] = adapter


def languages() -> list[str]:
    return sorted(_ADAPTERS)


register("en", Adapter(P.sentences, lambda s: F.regexp_count(s, F.lit(L.TOKEN)), lambda s, entries: P.phrase_count(P.spaced_tokens(s), entries)))
register("zh", Adapter(P.sentences, L.cjk_units, lambda s, entries: P.phrase_count(s, entries, spaced=False)))


def measure(df: DataFrame, key: str, text: str, providers: dict[str, Callable[[Adapter, Column], Column]], detect: Callable[[Column], Column] = L.detect_language) -> DataFrame:
    """(key, language, metric, value) of every text and provider; value is null where the language has no adapter: all metrics are always there.

    A provider makes a column of a text's column and its language's adapter. detect: the language of a text, as a column.
    """
    d = df.select(F.col(key), F.col(text).cast("string").alias("_t")).withColumn("language", detect(F.col("_t")))

    def value(provider: Callable[[Adapter, Column], Column]) -> Column:
        out = F.lit(None).cast("double")
        for language in languages():
            out = F.when(F.col("language") == language, provider(_ADAPTERS[language], F.col("_t")).cast("double")).otherwise(out)
        return out

    rows = F.array(*[F.struct(F.lit(m).alias("metric"), value(p).alias("value")) for m, p in providers.items()])
    return d.select(key, "language", F.inline(rows))
