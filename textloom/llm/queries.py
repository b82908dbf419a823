"""Queries of the training-text operators, by name, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, mojibake, packing, quality, scans, sentences, tokens
from textloom.session import table


#: The sections of a paper's body.
BODY = ("introduction", "related_work", "method", "experiments", "results", "discussion", "conclusion")


def _prose(spark: SparkSession, sf_dir: str, scanned: bool, body: bool = False) -> DataFrame:
    blocks = table(spark, sf_dir, "content_blocks").filter((F.col("kind") == "prose") & F.col("text_level").isNull() & (F.col("scanned") == scanned))
    return blocks.filter(F.col("section").isin(*BODY)) if body else blocks


def _scans(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    """Both sources in one pass: the source's name leads the key."""
    blocks = _prose(spark, sf_dir, True).select(F.concat(F.lit("content_blocks "), F.col("block_id").cast("string")).alias("rec"), F.col("text_plain").alias("text"))
    marker = table(spark, sf_dir, "marker_blocks").select(F.concat(F.lit("marker_blocks "), "stem", F.lit("#"), F.col("block_no").cast("string")).alias("rec"), F.col("raw").alias("text"))
    found = operator(blocks.unionByName(marker), F.col("rec"), "text", _prose(spark, sf_dir, False), "text_plain")
    return found.withColumns({"src": F.substring_index("rec", " ", 1), "rec_key": F.expr("substring(rec, instr(rec, ' ') + 1)")}).drop("rec")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir, scans.findings).select("src", "rec_key", "line_no", "kind")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir, scans.repaired).select("src", "rec_key", "repaired")


def _sentences(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    def of(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
        found = sentences.split_sentences(df, key, text, with_text)
        return found.select(F.lit(src).alias("src"), F.col(key).cast("string").alias("rec_key"), *found.columns[1:])

    cases = of(table(spark, sf_dir, "clause_spec_cases"), "clause_spec_cases", "id", "text")
    spans = of(table(spark, sf_dir, "clause_spans"), "clause_spans", "clause_id", "text")
    return cases.unionByName(spans).unionByName(of(_prose(spark, sf_dir, False, body=True), "content_blocks", "block_id", "text_plain"))


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir, True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir, False)


def _languages(spark: SparkSession, sf_dir: str, wrong_only: bool) -> DataFrame:
    documents, cases = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_spec_cases").select("id", "text", F.col("expected.language").alias("language"))
    identifier = langid.fit(langid.sample_rows(documents, "doc_id", "text", "lang"))
    d = langid.identify(documents, "doc_id", "text", "lang", identifier, shaped=True, wrong_only=wrong_only).withColumn("src", F.lit("documents")).withColumnRenamed("doc_id", "key")
    c = langid.identify(cases, "id", "text", "language", identifier, wrong_only=wrong_only).withColumn("src", F.lit("lang_spec_cases")).withColumnRenamed("id", "key")
    return d.withColumn("key", F.col("key").cast("string")).unionByName(c).withColumnRenamed("key", "rec_key")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, wrong_only=True).select("src", "rec_key", "seg_no", "lang").distinct()


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prose text's language and every mixed text's segments, with confidence."""
    return _languages(spark, sf_dir, wrong_only=False)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows delivered twice under one key are one case."""
    blocks = quality.shapes(_prose(spark, sf_dir, False).filter("text_plain is not null"), "block_id", "text_plain")
    documents = quality.shapes(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")
    both = blocks.select(F.lit("content_blocks").alias("src"), F.col("block_id").cast("string").alias("rec_key"), "shape").unionByName(
        documents.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_key"), "shape")
    )
    return both.filter("shape <> 'prose'").distinct()


def p6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of both tables, with raw_chars and digits set right: a table's raw_chars counts its HTML."""
    blocks = table(spark, sf_dir, "content_blocks")
    raw = blocks.select("block_id", F.when(F.col("kind") == "tables", F.col("table_body")).otherwise(F.col("text_plain")).alias("raw"), "ingested_at")
    latest = raw.groupBy("block_id").agg(F.max_by("raw", "ingested_at").alias("raw"))
    b = quality.statistics(latest, "block_id", "raw").withColumnRenamed("block_id", "key").withColumn("src", F.lit("content_blocks"))
    d = quality.statistics(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "key").withColumn("src", F.lit("documents"))
    return b.unionByName(d).withColumn("rec_key", F.col("key").cast("string")).withColumn("raw_chars", F.col("n_chars")).drop("key")


#: Counts that SQL without look-around can give as well.
PLAIN_COUNTS = ("n_chars", "n_words", "n_lines", "digits", "mean_word_length", "symbol_ratio")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting statistics of every document, null and blank ones too."""
    made = quality.counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[made[n].alias(n) for n in PLAIN_COUNTS])


P6_COUNTS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, length(t) AS n_chars, len(regexp_extract_all(t, '\\S+')) AS n_words, len(regexp_extract_all(t, '(?m)^.*\\S.*$')) AS n_lines,
  len(regexp_extract_all(t, '\\p{Nd}')) AS digits, len(regexp_extract_all(t, '\\S')) AS solid, len(regexp_extract_all(t, '[^\\p{L}\\p{N}\\s]')) AS signs FROM d)
SELECT doc_id, CAST(n_chars AS INT) AS n_chars, CAST(n_words AS INT) AS n_words, CAST(n_lines AS INT) AS n_lines, CAST(digits AS INT) AS digits, round(solid::DOUBLE / nullif(n_words, 0), 6) AS mean_word_length, round(signs::DOUBLE / nullif(solid, 0), 6) AS symbol_ratio FROM c
"""


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_budget"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_pack(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_paragraphs(table(spark, sf_dir, "documents"))


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired_paragraphs(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_sentences": p3_sentences, "p5_found": p5_found, "p5_languages": p5_languages, "p6_found": p6_found, "p6_stats": p6_stats, "p6_counts": p6_counts, "p7_ids": p7_ids, "p8_pack": p8_pack, "p8_report": p8_report, "p9_found": p9_found, "p9_repaired": p9_repaired}
ORACLE_SQL: dict[str, str] = {"p6_counts": P6_COUNTS_SQL}
