"""Corpus statistics of metrics, target ranges derived from them, and documents held against these.

A table of metric values is long: corpus, doc, metric, value (null: not measurable, which is not zero).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.stats import T95, ranked
from textloom.session import round6, safe_div

#: Fewer valid values than this make a statistic thin; a larger share of missing ones is a warning.
THIN, MISSING = 5, 0.3


def profile(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """For each group: n_valid, n_missing, mean, sample sd (0 for one value), nearest-rank median, p25 and p75, iqr, min, max, 95 % interval of the mean by Student's t, warnings.

    Groups without a valid value have null statistics and say so. Exact: one row a distinct value is ranked.
    """
    v = values.withColumn("_x", F.col(value).cast("double"))
    a = v.groupBy(*by).agg(
        F.count("_x").alias("n_valid"), F.count_if(F.col("_x").isNull()).alias("n_missing"), F.avg("_x").alias("mean"),
        F.coalesce(F.stddev_samp("_x"), F.when(F.count("_x") == 1, F.lit(0.0))).alias("sd"), F.min("_x").alias("min"), F.max("_x").alias("max"),
    )
    r = ranked(v, by, "_x")
    n = r.groupBy(*by).agg(F.sum("times").alias("_n"))
    rank = lambda p: F.bround(p * (F.col("_n") - 1)).cast("bigint")
    at = lambda p: F.max(F.when((F.col("below") <= rank(p)) & (rank(p) < F.col("below") + F.col("times")), F.col("_x")))
    q = r.join(n, by).groupBy(*by).agg(at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"))
    t = F.when(F.col("n_valid") > 31, F.lit(1.96)).otherwise(F.element_at(F.array(*map(F.lit, T95)), (F.least(F.greatest(F.col("n_valid"), F.lit(2)), F.lit(31)) - 1).cast("int")))
    half = F.when(F.col("n_valid") > 1, t * F.col("sd") / F.sqrt("n_valid")).when(F.col("n_valid") == 1, F.lit(0.0))
    iqr = F.col("p75") - F.col("p25")
    total = F.col("n_valid") + F.col("n_missing")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("n_valid") == 0, "NO_VALID_VALUES"), F.when(F.col("n_valid") < THIN, "N_LT_5"), F.when(F.col("n_valid") < 3, "N_VALID_LT_3"), F.when(iqr == 0, "IQR_ZERO"),
            F.when((F.col("n_valid") > 0) & (F.col("n_missing") > MISSING * total), "HIGH_MISSING"),
        )
    )
    return a.join(q, by, "left").select(
        *by, "n_valid", "n_missing", *[round6(F.col(c)).alias(c) for c in ("mean", "sd", "median", "p25", "p75")], round6(iqr).alias("iqr"), round6(F.col("min")).alias("min"), round6(F.col("max")).alias("max"),
        round6(F.col("mean") - half).alias("ci95_low"), round6(F.col("mean") + half).alias("ci95_high"), F.array_join(warnings, ",").alias("warnings"),
    )


def contract(profiles: DataFrame, by: list[str], gate: bool = False, least: int = THIN, derived: dict[str, list[str]] | None = None, metric: str = "metric") -> DataFrame:
    """A clause for each group: low, high (p25 and p75), level, reason, warnings.

    No target (nulls, level warn) where quantiles are missing, equal or inverted. Every clause is a warning unless
    gate is set, and thin samples always are. derived: metrics whose range is the sum of their components'; one
    without a component's range has none.
    """
    p25, p75 = F.col("p25"), F.col("p75")
    reason = F.when(p25.isNull() | p75.isNull(), "stats_null").when(p25 == p75, "iqr_zero").when(p25 > p75, "inverted_quantiles")
    base = profiles.select(*by, "n_valid", F.when(reason.isNull(), p25).alias("low"), F.when(reason.isNull(), p75).alias("high"), reason.alias("reason"))
    if derived:
        parts = profiles.sparkSession.createDataFrame([(m, c, len(cs)) for m, cs in derived.items() for c in cs], "_m string, _c string, _n int")  # a few rows of settings
        rest = [b for b in by if b != metric]
        summed = base.join(F.broadcast(parts), F.col(metric) == F.col("_c")).groupBy(*rest, "_m", "_n").agg(F.sum("low").alias("l"), F.sum("high").alias("h"), F.count("low").alias("k")).filter("k = _n")
        sums = summed.select(*rest, F.col("_m").alias(metric), "l", "h")
        named = F.col(metric).isin(*derived)
        j = base.join(sums, by, "left")
        base = j.select(*by, "n_valid", F.when(named, F.col("l")).otherwise(F.col("low")).alias("low"), F.when(named, F.col("h")).otherwise(F.col("high")).alias("high"), F.when(named & F.col("l").isNull(), "component_without_target").when(named, None).otherwise(F.col("reason")).alias("reason"))
    thin = F.col("n_valid") < least
    level = F.when(F.lit(gate) & F.col("reason").isNull() & ~thin, "gate").otherwise("warn")
    return base.select(*by, "n_valid", round6(F.col("low")).alias("low"), round6(F.col("high")).alias("high"), level.alias("level"), "reason", F.when(thin, "N_LT_5" if least == THIN else "N_LT_MIN").alias("warning"))


def validate(values: DataFrame, clauses: DataFrame, by: list[str], key: str, value: str = "value", tokens: str | None = None, least_tokens: int = 0) -> DataFrame:
    """(key, by..., actual, deviation, status) of every document and clause: pass inside the range, ends included; else fail at a gate and warn elsewhere.

    skipped: no value, no range, or a document of fewer tokens than least_tokens. deviation: distance to the range.
    """
    v = values.select(key, *by, F.col(value).cast("double").alias("actual"), *([F.col(tokens).alias("_t")] if tokens else []))
    short = F.col("_t") < least_tokens if tokens else F.lit(False)
    j = v.join(clauses.select(*by, "low", "high", "level"), by)
    out = F.greatest(F.col("low") - F.col("actual"), F.col("actual") - F.col("high"), F.lit(0.0))
    skipped = F.col("actual").isNull() | F.col("low").isNull() | F.coalesce(short, F.lit(True))
    status = F.when(skipped, "skipped").when(out == 0, "pass").when(F.col("level") == "gate", "fail").otherwise("warn")
    return j.select(key, *by, round6(F.col("actual")).alias("actual"), F.when(~skipped, round6(out)).alias("deviation"), status.alias("status"))


def verdicts(validated: DataFrame, key: str, least_share: float = 0.5) -> DataFrame:
    """(key, n_pass, n_warn, n_fail, n_skipped, exit_code): 2 if too few clauses could be judged, 1 with a failure, else 0. No overall score."""
    count = lambda s: F.count_if(F.col("status") == s)
    a = validated.groupBy(key).agg(*[count(s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "skipped")], F.count("*").alias("_n"))
    return a.select(key, "n_pass", "n_warn", "n_fail", "n_skipped", F.when(F.col("_n") - F.col("n_skipped") < least_share * F.col("_n"), 2).when(F.col("n_fail") > 0, 1).otherwise(0).alias("exit_code"))


def drift(values: DataFrame, source: str, a: str, b: str, key: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """Two sources' values of the same documents, by metric: n_pairs, mean signed, mean absolute and greatest difference, mean relative one (null where the base is 0)."""
    pick = lambda s, n: values.filter(F.col(source) == s).groupBy(key, metric).agg(F.max(value).cast("double").alias(n))
    d = pick(a, "x").join(pick(b, "y"), [key, metric]).withColumn("d", F.col("y") - F.col("x")).filter("d IS NOT NULL")
    return d.groupBy(metric).agg(
        F.count("*").alias("n_pairs"), round6(F.avg("d")).alias("mean_signed"), round6(F.avg(F.abs("d"))).alias("mean_abs"), round6(F.max(F.abs("d"))).alias("max_abs"), round6(F.avg(safe_div(F.abs("d"), F.col("x")))).alias("mean_rel")
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, fingerprint): of a table whatever its row order: hashes of the rows, hashed again in order by their first bytes, then all together.

    Two levels keep every list bounded by the number of rows over 65,536 buckets. Nulls count as such; equal rows count each.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    times = df.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    bucket = times.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.sum("n").alias("n"), F.sha2(text(F.concat_ws(":", "h", "n")), 256).alias("h"))
    return bucket.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(text(F.concat_ws(":", "b", "h")), 256).alias("fingerprint"))


def top_by(df: DataFrame, group: list[str], order: list[Column], columns: list[str], k: int) -> DataFrame:
    """The first k rows of each group by ``order``, numbered from 1: k is the feature. Bounded state map-side: each task keeps k rows a group."""
    pick = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in columns])
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*columns), F.lit(64)))
    first = salted.groupBy(*group, "_s").agg(F.slice(F.array_sort(F.collect_list(pick)), 1, k).alias("r"))
    both = first.groupBy(*group).agg(F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, k).alias("r"))
    return both.select(*group, F.posexplode("r").alias("_p", "_r")).select(*group, (F.col("_p") + 1).alias("place"), *[F.col(f"_r.{c}").alias(c) for c in columns])
