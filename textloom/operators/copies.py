"""Differences between two copies of a dataset.

Rows of both copies are brought into key order inside segments, cut into chunks wherever a rolling
hash over the last keys meets a condition, and every chunk gets a fingerprint. Chunks whose
fingerprint the other copy has as well are done with. Only rows of the remaining chunks are read
with their fields and compared one by one.

Why this holds at scale: the first pass moves 40 bytes a row whatever the row's width. In the second, a bitmap
of the keys of unmatched chunks keeps the rows of matching chunks in the scan: their fields are neither computed
nor shuffled, but for keys that share a bit with another (one in nine at most up to MOST_BITS; they are
compared and found equal). A key delivered any number of times is collapsed by map-side aggregation.
Segments hold a bounded number of keys, so no window sees an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that the rolling hash looks at.
ROLL = 3
#: Keys in a hashed segment, about.
SEGMENT_KEYS = 4096
#: Bits of the bitmap of unmatched keys for each row, at least and at most (16 MB), and in one of its parts.
BITS_A_ROW, LEAST_BITS, MOST_BITS, PART_BITS = 8, 1 << 18, 1 << 27, 1 << 15


@dataclass(frozen=True)
class Field:
    """One compared field.

    value: its canonical form (orderable: no maps). differs(l, r): exact verdict, null-safe.
    print: what enters the fingerprint; equal prints must imply that differs() is false.
    """

    name: str
    value: Callable[[DataFrame], Column]
    differs: Callable[[Column, Column], Column] = lambda a, b: ~a.eqNullSafe(b)
    print: Callable[[Column], Column] = lambda c: c


def key_segment(df: DataFrame, keys: list[str], span_bits: int = 12, buckets: int = 4096) -> Column:
    """A coarse part of the key order with a bounded number of keys.

    If the last key is integral: the other keys and the last one's block of 2 ** span_bits values, so
    no segment has more keys than that, however many rows share the other keys. Else a hash bucket.
    """
    if isinstance(df.schema[keys[-1]].dataType, T.IntegralType):
        return F.xxhash64(*keys[:-1], F.shiftright(F.col(keys[-1]).cast("bigint"), span_bits))
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def _hash(*cols: Column) -> Column:
    """xxhash64 skips nulls, so their places are hashed as well."""
    return F.xxhash64(*cols, F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols]))


def _prepared(df: DataFrame, side: int, keys: list[str], fields: list[Field], version: str | None, segment: Callable | None, buckets: int) -> DataFrame:
    values = [f.value(df).alias(f"_f{i}") for i, f in enumerate(fields)]
    seg = segment(df) if segment else key_segment(df, keys, buckets=buckets)
    out = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], seg.alias("_seg"), (F.col(version) if version else F.lit(0)).alias("_v"), *values)
    ks, fs = [F.col(f"_k{i}") for i in range(len(keys))], [f.print(F.col(f"_f{i}")) for i, f in enumerate(fields)]
    return out.withColumns({"_side": F.lit(side), "_kh": _hash(*ks), "_h": _hash(*ks, *fs)})


def _slot(key_hash: Column, bits: int) -> Column:
    return F.pmod(key_hash, F.lit(bits))


def bitmap_parts(key_hashes: DataFrame, bits: int) -> DataFrame:
    """(part, words): a bitmap of the hashes' slots in parts of PART_BITS, each an array of 64-bit words. At most bits / PART_BITS rows."""
    slot = _slot(F.col("_kh"), bits)
    words = key_hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))).alias("b"))
    per = PART_BITS // 64
    entries = words.groupBy((F.col("word") / per).cast("bigint").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word") % per, "b"))).alias("m"))
    return entries.select("part", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(per - 1).cast("bigint")), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("words"))


def in_bitmap(df: DataFrame, parts: DataFrame, key_hash: Column, bits: int) -> DataFrame:
    """The rows whose hash has its bit set. The parts are at most 16 MB (MOST_BITS), which is why they may be broadcast."""
    slot, part, words = (f"_textloom_{n}" for n in ("slot", "part", "words"))
    marked = df.withColumn(slot, _slot(key_hash, bits)).withColumn(part, (F.col(slot) / PART_BITS).cast("bigint"))
    joined = marked.join(F.broadcast(parts.select(F.col("part").alias(part), F.col("words").alias(words))), part)
    word = F.get(words, (F.col(slot) % PART_BITS / 64).cast("int"))
    return joined.filter(F.getbit(word, (F.col(slot) % 64).cast("int")) == 1).drop(slot, part, words)


def unmatched_chunks(rows: DataFrame, n_keys: int, mean_chunk: int) -> DataFrame:
    """Key hashes of the rows in chunks that only one side has. rows: _side, _seg, _k*, _v, _kh, _h."""
    ks = [f"_k{i}" for i in range(n_keys)]
    latest = rows.groupBy("_side", "_seg", *ks, "_kh").agg(F.max(F.struct("_v", "_h")).alias("w"))
    order = Window.partitionBy("_seg", "_side").orderBy(*ks)
    rolling = reduce(lambda a, b: F.xxhash64(a, b), [F.coalesce(F.lag("_kh", i).over(order), F.lit(i)) for i in range(1, ROLL)], F.col("_kh"))
    chunked = (
        latest.select("_side", "_seg", *ks, "_kh", F.col("w._h").alias("_h"))
        .repartition("_seg")
        .withColumn("_cut", (F.pmod(rolling, F.lit(mean_chunk)) == 0).cast("int"))
        .withColumn("_chunk", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    chunks = chunked.groupBy("_seg", "_side", "_chunk").agg(
        F.count("*").alias("n"), F.bit_xor("_h").alias("x"), F.bit_xor(F.xxhash64("_h", F.lit(7))).alias("y"), F.collect_list("_kh").alias("khs")
    )
    # anti-join of either side's fingerprints with the other's, both directions in one aggregation
    alone = chunks.groupBy("_seg", "n", "x", "y").agg(F.min("_side").alias("lo"), F.max("_side").alias("hi"), F.first("khs").alias("khs"))
    return alone.filter("lo = hi").select(F.explode("khs").alias("_kh"))


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[Field],
    version: str | None = None,
    segment: Callable[[DataFrame], Column] | None = None,
    mean_chunk: int = 16,
    buckets: int | None = None,
) -> DataFrame:
    """(keys..., finding): ``left_only``, ``right_only``, or the name of a differing field.

    Of several rows with one key the one with the greatest ``version`` counts (ties: the greatest row
    hash, so the result does not depend on row order). A null key part is a value of its own, equal to
    null. Columns other than keys, fields and version are ignored, whatever their names. Empty inputs
    are fine: all rows of the other side come out.

    mean_chunk: expected rows a chunk; about the inverse of the expected share of changed rows.
    buckets: number of segments for keys whose last part is no integer; by the number of rows if it is not given.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    n_rows = left.count() + right.count()  # of parquet: the footers' figures
    buckets = buckets or max(64, n_rows // SEGMENT_KEYS)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_ROW * n_rows).bit_length()))
    prepared = lambda df, side: _prepared(df, side, keys, fields, version, segment, buckets)
    suspects = unmatched_chunks(prepared(left, 0).unionByName(prepared(right, 1)), len(keys), mean_chunk)
    parts = bitmap_parts(suspects, bits)
    kept = [prepared(in_bitmap(df, parts, _hash(*map(F.col, keys)), bits), side) for side, df in enumerate((left, right))]
    rows = kept[0].unionByName(kept[1])
    payload = F.struct("_v", "_h", *[f"_f{i}" for i in range(len(fields))])
    pairs = rows.groupBy(*names).agg(F.max(F.when(F.col("_side") == 0, payload)).alias("l"), F.max(F.when(F.col("_side") == 1, payload)).alias("r"))
    per_field = [F.when(f.differs(F.col(f"l._f{i}"), F.col(f"r._f{i}")), F.lit(f.name)) for i, f in enumerate(fields)]
    findings = (
        F.when(F.col("r").isNull(), F.array(F.lit("left_only")))
        .when(F.col("l").isNull(), F.array(F.lit("right_only")))
        .otherwise(F.array_compact(F.array(*per_field)))
    )
    return pairs.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.explode(findings).alias("finding"))
