"""Operators on typed blocks of documents: sections, streams, captions, tables, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks of one document that one window sees at most, as a power of two.
BUCKET_BITS = 12


def latest_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, the one with the greatest version (ties: the greatest row). Maps in the row are not supported."""
    rest = [c for c in df.columns if c not in (key, version)]
    best = df.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in (version, *rest)])


def forward_fill(df: DataFrame, group: str, order: str, value: str, out: str, tie: str, bits: int = BUCKET_BITS) -> DataFrame:
    """out = the last non-null value at or before each row of its group.

    Windows run inside buckets of 2 ** bits order values; what a bucket inherits comes from one row a bucket,
    so a group of any size is split over tasks. Rows with a null group form one group; null order sorts first.
    """
    bucketed = df.withColumn("_b", F.shiftright(F.coalesce(F.col(order), F.lit(-1)).cast("bigint"), bits))
    inside = Window.partitionBy(group, "_b").orderBy(F.col(order).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0)
    filled = bucketed.withColumn("_v", F.last(value, ignorenulls=True).over(inside))
    ends = bucketed.filter(F.col(value).isNotNull()).groupBy(group, "_b").agg(F.max_by(value, F.struct(F.coalesce(F.col(order), F.lit(-1)), tie)).alias("_e"))
    buckets = bucketed.groupBy(group, "_b").agg(F.lit(1).alias("_one"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col("x." + group).eqNullSafe(F.col("y." + group))) & (F.col("x._b") == F.col("y._b"))
    carried = (
        buckets.alias("x").join(ends.alias("y"), same, "left").select(F.col("x." + group).alias(group), F.col("x._b").alias("_b"), "_e").withColumn("_c", F.last("_e", ignorenulls=True).over(before))
    )
    joined = filled.alias("f").join(carried.alias("c"), F.col("f." + group).eqNullSafe(F.col("c." + group)) & (F.col("f._b") == F.col("c._b")), "left")
    return joined.select(*[F.col("f." + c) for c in df.columns], F.coalesce("f._v", "c._c").alias(out))


def table_cells(html: Column) -> Column:
    """Texts of all cells of an HTML table."""
    cells = F.regexp_extract_all(html, F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))


def numeric_cell(cell: Column) -> Column:
    """A number with an optional unit of up to six letters, or a numeric range; full-width digits fold first."""
    folded = F.regexp_replace(F.translate(cell, "０１２３４５６７８９", "0123456789"), "[,\\s]", "")
    return folded.rlike("^[-+±~]?[0-9]+([.][0-9]+)?([-~–][0-9]+([.][0-9]+)?)?[A-Za-z%]{0,6}$")


def overlapping_boxes(df: DataFrame, groups: list[str], key: str, box: str, cell: int = 128) -> DataFrame:
    """Pairs (a < b) of boxes [x0, y0, x1, y1] of one group that overlap with positive area, once each.

    Boxes meet in the cells of a grid instead of all with all; a pair is reported in the first cell both
    have. Empty, inverted and null boxes overlap nothing.
    """
    x0, y0, x1, y1 = (F.col(box)[i] for i in range(4))
    valid = df.filter((x1 > x0) & (y1 > y0)).select(*groups, F.col(key).alias("_id"), x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1")).distinct()
    cells = valid.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_x0") / cell), F.floor((F.col("_x1") - 1) / cell)))).withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col("_y0") / cell), F.floor((F.col("_y1") - 1) / cell)))
    )
    a, b = cells.alias("a"), cells.alias("b")
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in (*groups, "_cx", "_cy")]
    met = F.expr("a._id < b._id AND a._x0 < b._x1 AND b._x0 < a._x1 AND a._y0 < b._y1 AND b._y0 < a._y1")
    first = (F.col("a._cx") == F.floor(F.greatest("a._x0", "b._x0") / cell)) & (F.col("a._cy") == F.floor(F.greatest("a._y0", "b._y0") / cell))
    pairs = a.join(b, [*same, met, first])
    area = F.expr("(least(a._x1, b._x1) - greatest(a._x0, b._x0)) * (least(a._y1, b._y1) - greatest(a._y0, b._y0))")
    return pairs.select(*[F.col(f"a.{g}") for g in groups], F.col("a._id").alias("a_id"), F.col("b._id").alias("b_id"), area.cast("bigint").alias("area"))
