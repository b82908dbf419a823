"""Corpus statistics with explicit quantile and missing-value semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import round6, safe_div

#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom; 1.96 beyond.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054
#: Ranges of values that a group is split into for ranking, and the precision of the cuts between them.
RANGES, ACCURACY = 64, 1000


def ranked(df: DataFrame, group: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """group..., value, times, below: the distinct values of each group with their counts and the number of smaller ones.

    Rows of equal value are counted map-side first, so exact order statistics need one row a distinct value. A group is
    split by ranges of values, cut at approximate quantiles of all: windows see one range of one group, and what
    the ranges below hold comes from one row a range. Only the cuts are approximate; the ranks are exact.
    """
    known = df.filter(F.col(value).isNotNull())
    cuts = known.agg(F.percentile_approx(F.col(value).cast("double"), [i / ranges for i in range(1, ranges)], ACCURACY)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c < F.col(value).cast("double")))
    counts = known.groupBy(*group, value).agg(F.count("*").alias("times")).withColumn("_range", part)
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*group, "_range").agg(F.sum("times").alias("_t")).withColumn("_below", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    at, sums = counts.withColumn("below", F.coalesce(F.sum("times").over(inside), F.lit(0))).alias("a"), totals.alias("s")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*group, "_range")]
    return at.join(sums, same).select(*[F.col(f"a.{c}") for c in (*group, value, "times")], (F.col("a.below") + F.col("s._below")).alias("below"))


def _at(rank: Column) -> Column:
    """The value with a 0-based rank, among ranked() rows."""
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("times")), F.col("_v")))


def order_statistics(df: DataFrame, group: list[str], value: str, p: float = 0.75) -> DataFrame:
    """Five quantiles as five users of a corpus define them.

    nearest: s[round_half_even(p (n-1))]; linear: interpolated; ceil_rank: s[ceil(p n) - 1]; upper_median:
    s[n div 2]; true_median. Exact, never approximated. Nulls are left out; groups of nulls only do not occur.
    """
    r = ranked(df, group, value).withColumn("_v", F.col(value))
    n = r.groupBy(*group).agg(F.sum("times").alias("n"))
    joined = r.join(n, group)
    pos = F.lit(p) * (F.col("n") - 1)
    low = F.floor(pos)
    cols = {
        "nearest": F.bround(pos).cast("bigint"),
        "lo": low,
        "hi": F.ceil(pos),
        "ceil_rank": F.greatest(F.ceil(F.lit(p) * F.col("n")).cast("bigint"), F.lit(1)) - 1,
        "upper_median": F.floor(F.col("n") / 2),
        "m0": F.floor((F.col("n") - 1) / 2),
    }
    a = joined.groupBy(*group, "n").agg(*[_at(c).cast("double").alias(k) for k, c in cols.items()])
    frac = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    return a.select(
        *group, "n", round6(F.col("nearest")).alias("nearest"), round6(F.col("lo") + (F.col("hi") - F.col("lo")) * frac).alias("linear"), round6(F.col("ceil_rank")).alias("ceil_rank"),
        round6(F.col("upper_median")).alias("upper_median"), round6((F.col("m0") + F.col("upper_median")) / 2).alias("true_median"),
    )


def describe(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n_valid, n_missing, mean, sample sd (0 for one value), 95 % interval of the mean by Student's t, warnings."""
    a = df.groupBy(*group).agg(
        F.count(value).alias("n_valid"), F.count(F.when(F.col(value).isNull(), 1)).alias("n_missing"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.when(F.count(value) == 1, F.lit(0.0))).alias("sd"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"),
    )
    t = F.when(F.col("n_valid") > 31, F.lit(1.96)).when(F.col("n_valid") > 1, F.element_at(F.array(*map(F.lit, T95)), (F.least(F.greatest(F.col("n_valid"), F.lit(2)), F.lit(31)) - 1).cast("int")))
    half = t * F.col("sd") / F.sqrt("n_valid")
    warn = F.array_compact(F.array(F.when(F.col("n_valid") < 3, "N_VALID_LT_3"), F.when(F.col("n_missing") > 0.3 * (F.col("n_valid") + F.col("n_missing")), "HIGH_MISSING")))
    return a.select(
        *group, "n_valid", "n_missing", round6(F.col("mean")).alias("mean"), round6(F.col("sd")).alias("sd"), round6(F.col("min")).alias("min"), round6(F.col("max")).alias("max"),
        round6(F.col("mean") - half).alias("ci_low"), round6(F.col("mean") + half).alias("ci_high"), F.array_join(warn, ",").alias("warnings"),
    )


def wilson(hits: Column, trials: Column) -> tuple[Column, Column]:
    """Wilson's 95 % interval, clamped to [0, 1]; null without trials."""
    n, p = trials.cast("double"), safe_div(hits, trials)
    z2 = Z95 * Z95
    centre, spread = (p + z2 / (2 * n)) / (1 + z2 / n), F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * Z95 / (1 + z2 / n)
    return F.when(trials > 0, round6(F.greatest(F.lit(0.0), centre - spread))), F.when(trials > 0, round6(F.least(F.lit(1.0), centre + spread)))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two annotations: n, po, pe, kappa. Rows lacking either are left out; no rows give nulls."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    n = pairs.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    po, pe = safe_div(F.col("same"), F.col("total")), safe_div(F.coalesce("both", F.lit(0)), F.col("total") * F.col("total"))
    value = F.when(pe >= 1, F.when(po >= 1, F.lit(1.0))).otherwise(safe_div(po - pe, 1 - pe))
    one = n.withColumn("both", F.lit(None).cast("bigint")).unionByName(chance.selectExpr("cast(null as bigint) AS total", "cast(null as bigint) AS same", "both")).agg(F.max("total").alias("total"), F.max("same").alias("same"), F.max("both").alias("both"))
    return one.select(F.coalesce("total", F.lit(0)).alias("n"), round6(po).alias("po"), round6(pe).alias("pe"), round6(value).alias("kappa"))


def average_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """value with its average rank in its group (ties share the mean of their ranks): one row a distinct value."""
    return ranked(df, group, value).withColumn("avg_rank", F.col("below") + (F.col("times") + 1) / 2)


def correlations(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks). Null for fewer than 3 pairs or without variation."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rx = average_ranks(pairs, group, "x").select(*group, "x", F.col("avg_rank").alias("rx"))
    ry = average_ranks(pairs, group, "y").select(*group, "y", F.col("avg_rank").alias("ry"))
    joined = pairs.join(rx, [*group, "x"]).join(ry, [*group, "y"])
    # corr() itself divides by zero where there is no variation
    safe = lambda a, b: F.when(F.count("*") >= 3, F.round(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), 6))
    return joined.groupBy(*group).agg(F.count("*").alias("n"), safe("x", "y").alias("pearson"), safe("rx", "ry").alias("spearman"))
