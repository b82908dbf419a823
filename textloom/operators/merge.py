"""Merging of ranked results of several sources, agreement between sources, counters by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What every later copy of a result adds to its score, times its source's weight.
BONUS = 0.15


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host without www., no trailing slash, query or fragment; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "/+$", "")
    head = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.lit(1 << 30))
    return F.when(head == "", F.lower(bare)).otherwise(F.concat(F.regexp_replace(head, "://www[.]", "://"), rest))


def dedup_key(doi: Column, arxiv_id: Column, url: Column, title: Column, source: Column) -> Column:
    """The key under which a result is one: its DOI, else its arXiv id, else its normalised URL, else title and source. Blank counts as missing."""
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return (
        F.when(given(doi), F.concat(F.lit("doi:"), F.replace(F.lower(F.trim(doi)), F.lit("https://doi.org/"), F.lit(""))))
        .when(given(arxiv_id), F.concat(F.lit("arxiv:"), F.lower(F.trim(arxiv_id))))
        .when(given(url), normalize_url(url))
        .otherwise(F.concat(F.lit("title:"), F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(source, F.lit(""))))
    )


def dedup_and_rank(results: DataFrame, weights: DataFrame, top: int) -> DataFrame:
    """Results of all sources merged by key; score = weighted score of the first + BONUS x weight of each later one.

    results: key, source, pos, score; weights: source, weight, source_order (a small table of settings: its
    sources are counted in the plan). First means the lowest (source_order, pos, score). Sources without a
    weight count 1 and come last. Ordered by score, then key. The first rows are found map-side: no group is
    collected, whatever the number of copies. Rows without a key are left out.
    """
    w = results.filter("key is not null").join(weights, "source", "left").withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "source_order": F.coalesce("source_order", F.lit(1 << 30))})
    first = F.min(F.struct("source_order", "pos", "score", "weight", "source"))
    merged = w.groupBy("key").agg(first.alias("f"), F.sum("weight").alias("all_weight"), F.count("*").alias("copies"))
    score = F.round(F.coalesce(F.col("f.score"), F.lit(0.0)) * F.col("f.weight") + BONUS * (F.col("all_weight") - F.col("f.weight")), 6)
    return merged.select("key", F.col("f.source").alias("source"), score.alias("score"), (F.col("copies") - 1).alias("also_from")).orderBy(F.desc("score"), "key").limit(top)


def agreement(df: DataFrame, item: str, member: str) -> DataFrame:
    """Jaccard of the member sets of every two items that share a member: item_a, item_b, shared, jaccard.

    Pairs come from shared members after distinct; meant for few items (sources, hosts), many members.
    """
    sets = df.select(F.col(item).alias("i"), F.col(member).alias("m")).filter("i is not null and m is not null").distinct()
    # items of one member meet: pairs are counted from the member's sorted item list, bounded by the number of items
    lists = sets.groupBy("m").agg(F.sort_array(F.collect_set("i")).alias("is"))
    pairs = lists.select(F.posexplode("is").alias("p", "a"), "is").select("a", F.explode(F.slice("is", F.col("p") + 2, F.size("is"))).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    size = sets.groupBy("i").agg(F.count("*").alias("n"))
    joined = shared.join(size.withColumnsRenamed({"i": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"i": "b", "n": "nb"}), "b")
    return joined.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def quota(df: DataFrame, source: str, ts: str, limit: int, period: str = "yyyy-MM") -> DataFrame:
    """Uses of each source by period, what remains of the limit, and whether it is used up."""
    used = df.groupBy(F.col(source).alias("source"), F.date_format(ts, period).alias("period")).agg(F.count("*").alias("used"))
    return used.withColumns({"remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("used")), "exhausted": F.col("used") >= limit})


def islands(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: group..., first, last, size, and the gap before (null for the first run). Repeats count once."""
    distinct = df.select(*group, F.col(number).alias("v")).filter("v is not null").distinct()
    order = Window.partitionBy(*group).orderBy("v")
    runs = distinct.withColumn("island", F.col("v") - F.row_number().over(order)).groupBy(*group, "island").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("size"))
    return runs.withColumn("gap_before", F.col("first") - F.lag("last").over(Window.partitionBy(*group).orderBy("first")) - 1).drop("island")
