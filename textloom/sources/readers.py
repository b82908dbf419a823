"""Readers of corpus inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.ArrayType(
    T.StructType(
        [
            *(T.StructField(n, T.StringType()) for n in ("type", "text", "img_path", "table_body", "sub_type")),
            *(T.StructField(n, T.IntegerType()) for n in ("text_level", "page_idx")),
            *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("image_caption", "table_caption", "list_items")),
            T.StructField("bbox", T.ArrayType(T.IntegerType())),
        ]
    )
)


def block_lists(spark: SparkSession, path: str) -> DataFrame:
    """(paper, block_index, block...) of all ``*_content_list.json`` below a folder. Files that hold no list give one row with a null block_index."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_content_list.json").text(path, wholetext=True)
    parsed = files.select(F.regexp_extract(F.input_file_name(), "([^/]+)_content_list[.]json$", 1).alias("paper"), F.from_json("value", BLOCK).alias("blocks"))
    return parsed.select("paper", F.posexplode_outer("blocks").alias("block_index", "b")).select("paper", "block_index", "b.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def label_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated annotation sheets with a header; short rows are padded with nulls."""
    names = ("item_id", "stratum", "matched_entries", "sentence", "annotator_a", "annotator_b")
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("sep", "\t").option("header", True).csv(path)


def plain_text_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_index, text_plain): groups of lines between blank lines; blank and null texts have none."""
    parts = F.filter(F.transform(F.split(F.col(text), "\\n[ \\t]*\\n"), lambda p: F.trim(p)), lambda p: p != "")
    return texts.select(F.col(key), F.posexplode(parts).alias("block_index", "text_plain"))


def bounded_jdbc(spark: SparkSession, url: str, sql: str, rows: int, **options: str) -> DataFrame:
    """A read-only query of a database, bounded there."""
    return spark.read.format("jdbc").options(url=url, query=f"SELECT * FROM ({sql}) q LIMIT {rows}", **options).load()
