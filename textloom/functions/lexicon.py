"""Lexicons of the phrase metrics: read from JSON files, checked, or the small built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a lexicon may have for its phrases to become one pattern.
MOST_ENTRIES = 5000

#: Own small lists, (language, name, group): entries.
BUILT_IN = {
    ("en", "hedge", ""): "may;might;could;approximately;presumably;slightly;rarely;suggested;to some extent;it is likely that;in most cases;at least",
    ("en", "booster", ""): "clearly;significantly;considerably;consistently;always;substantial;of course;in fact",
    ("en", "connectors", "contrastive"): "although;however;whereas;but;in contrast;on the other hand;even though",
    ("en", "connectors", "causal"): "because;because of;due to;as a result of;given that;owing to",
    ("en", "connectors", "result"): "therefore;thus;hence;as a result;as a consequence;consequently",
    ("en", "academic_words", ""): "analysis;hypothesis;framework;parameter;evaluation;criterion;inference;calibration;measure;measurement;significant;method",
    ("zh", "hedge", ""): "可能;大致;基本;通常;大约;似乎;一定程度上",
    ("zh", "booster", ""): "显著;明显;必然;充分;确实;非常",
    ("zh", "connectors", "contrastive"): "然而;但是;但;尽管;相反",
    ("zh", "connectors", "causal"): "因为;由于;由此",
    ("zh", "connectors", "result"): "因此;由此可见;从而;所以",
    ("zh", "connectors", "temporal"): "随后;首先;其次;最后",
    ("zh", "connectors", "condition"): "若;如果;只要;除非",
    ("zh", "academic_words", ""): "方法;分析;假设;参数;模型;实验;指标",
}
Lexicon = dict[tuple[str, str, str], list[str]]


def built_in() -> Lexicon:
    return {k: v.split(";") for k, v in BUILT_IN.items()}


def read_lexicons(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(language, name, grp, entry, version) of the JSON files in a folder for each language.

    A file has ``name``, ``version`` and either ``entries`` (a list; grp is '') or ``groups`` (lists by name). Entries
    are trimmed; blank ones and repeated ones of one group are left out. Files that are no JSON object are an error.
    """
    schema = "name string, version string, entries array<string>, groups map<string, array<string>>, _bad string"
    out = None
    for language, folder in sorted(folders.items()):
        raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
        groups = F.when(F.col("groups").isNotNull(), F.col("groups")).otherwise(F.create_map(F.lit(""), F.col("entries")))
        ok = raw.withColumn("name", F.when(F.col("_bad").isNotNull() | F.col("name").isNull(), F.raise_error(F.lit("a lexicon file is no JSON object with a name"))).otherwise(F.col("name")))
        one = ok.select(F.lit(language).alias("language"), "name", "version", F.explode(groups).alias("grp", "es")).select("language", "name", "grp", F.explode("es").alias("entry"), "version").withColumn("entry", F.trim("entry"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no lexicon folder is given")
    return out.filter("entry <> ''").dropDuplicates(["language", "name", "grp", "entry"])


def as_lists(lexicons: DataFrame) -> Lexicon:
    """The entries by (language, name, group). A lexicon with more than MOST_ENTRIES in all is an error: it is a table to join, not a pattern."""
    rows = lexicons.select("language", "name", "grp", "entry").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")
    out: Lexicon = {}
    for r in sorted(rows):
        out.setdefault((r.language, r.name, r.grp), []).append(r.entry)
    return out


def problems(lexicons: DataFrame) -> DataFrame:
    """(language, name, problem, entry): entries in two groups of one lexicon, single Chinese characters, entries without a letter, versions that differ within a language."""
    by = lexicons.groupBy("language", "name", "entry").agg(F.countDistinct("grp").alias("n"))
    twice = by.filter("n > 1").select("language", "name", F.lit("in_two_groups").alias("problem"), "entry")
    lone = lexicons.filter("language = 'zh' AND char_length(entry) < 2").select("language", "name", F.lit("single_character").alias("problem"), "entry")
    mute = lexicons.filter(~F.col("entry").rlike("\\p{L}")).select("language", "name", F.lit("no_letter").alias("problem"), "entry")
    versions = lexicons.groupBy("language").agg(F.countDistinct("version").alias("n")).filter("n > 1").select("language", F.lit(None).cast("string").alias("name"), F.lit("versions_differ").alias("problem"), F.lit(None).cast("string").alias("entry"))
    return twice.unionByName(lone).unionByName(mute).unionByName(versions).distinct()
