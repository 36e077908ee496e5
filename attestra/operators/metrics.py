"""What violations mean for instances: flags, time buckets, rates, correlation, paired tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.nulls import as_list, join_same
from attestra.functions.ranks import global_rank
from attestra.operators.constraints import ViolationResult
from attestra.sources.shared import store


def instance_violation_flags(result: ViolationResult, instances: DataFrame, join_cols, flag: str = "violates") -> DataFrame:
    """instances with a flag: its key stands among the violations."""
    cols = as_list(join_cols)
    keys = result.violations.select(*cols).distinct().withColumn(flag, F.lit(True))
    return join_same(instances, keys, cols).withColumn(flag, F.coalesce(flag, F.lit(False)))


def pairwise_instance_violation_flags(result: ViolationResult, instances: DataFrame, id_col: str, suffixes=("_l", "_r"), flag: str = "violates") -> DataFrame:
    """instances with a flag: its id stands on either side of a violating pair."""
    left, right = (result.violations.select(F.col(id_col + s).alias(id_col)) for s in suffixes)
    keys = left.union(right).distinct().withColumn(flag, F.lit(True))
    return join_same(instances, keys, [id_col]).withColumn(flag, F.coalesce(flag, F.lit(False)))


def temporal_buckets(df: DataFrame, ts_col: str, tiebreak, n_bins: int = 4, out: str = "bucket") -> DataFrame:
    """df with a bucket number from 1: quantile bins of the rank by time, closed to the right; null where the time is missing.

    Of equal times the tie-break decides. One row alone is in bucket 1.
    """
    known = df.where(F.col(ts_col).isNotNull())
    ranked = global_rank(known, [ts_col, *as_list(tiebreak)], "_rank", "_total")
    bucket = F.lit(1)
    for k in range(1, n_bins):
        bucket = bucket + F.when(F.col("_rank") > 1 + F.lit(k / n_bins) * (F.col("_total") - 1), 1).otherwise(0)
    missing = df.where(F.col(ts_col).isNull()).withColumn(out, F.lit(None).cast("int"))
    return ranked.withColumn(out, bucket).select(*df.columns, out).unionByName(missing)


def bucket_label(bucket: Column) -> Column:
    return F.concat(F.lit("bucket_"), bucket.cast("string"))


def stratified_rate(flags: DataFrame, flag: str, group: str) -> DataFrame:
    """Per group: n, n_violations, violation_rate. Rows without a group don't count."""
    yes = F.col(flag).cast("int")
    return flags.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.sum(yes).cast("long").alias("n_violations"), F.avg(yes).alias("violation_rate")
    )


def violation_error_correlation(df: DataFrame, flag: str, error: str) -> DataFrame:
    """One row, correlation: Pearson's over flag and error; NaN if either doesn't vary."""
    f, e = F.col(flag).cast("double"), F.col(error).cast("double")
    both = df.select(f.alias("f"), e.alias("e")).where("f IS NOT NULL AND e IS NOT NULL AND NOT isnan(e)")
    m = both.agg(F.var_pop("f").alias("vf"), F.var_pop("e").alias("ve"), F.covar_pop("f", "e").alias("c"))
    return m.select(F.when((F.col("vf") > 0) & (F.col("ve") > 0), F.col("c") / F.sqrt(F.col("vf") * F.col("ve"))).otherwise(F.lit(float("nan"))).alias("correlation"))


# Paired comparisons ----------------------------------------------------------

#: Clusters of a bucket, on average: their draws for all replicates are one matrix.
_BUCKET = 512


@dataclass(frozen=True)
class Interval:
    estimate: float
    low: float
    high: float
    n_clusters: int = 0


def bucket_draws(sizes: np.ndarray, bucket: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of a replicate's draws fall into a bucket, for each replicate.

    A replicate draws as many clusters as there are, with replacement. Its draws are split over a tree of buckets (a
    power of two of them) by binomials, each seeded by its node, so every task finds the same split on its own way down.
    """
    draws = np.full(n_boot, int(sizes.sum()), np.int64)
    first, last, node = 0, len(sizes), 1
    while last - first > 1:
        middle = (first + last) // 2
        whole, left = sizes[first:last].sum(), sizes[first:middle].sum()
        taken = np.random.default_rng([seed, 0, node]).binomial(draws, left / whole if whole else 0.0)
        if bucket < middle:
            draws, last, node = taken, middle, 2 * node
        else:
            draws, first, node = draws - taken, middle, 2 * node + 1
    return draws


def cluster_draws(draws: np.ndarray, n: int, bucket: int, seed: int) -> np.ndarray:
    """(replicates, clusters): a bucket's draws dealt to its n clusters."""
    return np.random.default_rng([seed, 1, bucket]).multinomial(draws, np.full(n, 1 / n)) if n else np.zeros((len(draws), 0), np.int64)


def cluster_bootstrap_ci(df: DataFrame, diff: str, cluster, n_boot: int = 2000, seed: int = 0, level: float = 0.95) -> Interval:
    """Mean of diff with a percentile interval from resampling whole clusters with replacement.

    Each replicate draws exactly as many clusters as there are, those without a known diff included. Clusters are
    dealt to buckets by a hash and ordered in them by it, so the same draws come on any partitioning. The driver gets the buckets'
    sizes, one number for each _BUCKET clusters, and n_boot sums; no list of clusters.
    """
    value = F.col(diff).cast("double")
    keys = as_list(cluster)
    sums = df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"), F.count(value).cast("double").alias("_c"), F.xxhash64(*keys).alias("_h"))
    sums = store(sums.select("_h", "_s", "_c"), "clusters")
    n, total, count = sums.agg(F.count("*"), F.sum("_s"), F.sum("_c")).first()
    if not count:
        return Interval(math.nan, math.nan, math.nan, n)
    buckets = 1 << max(0, math.ceil(math.log2(max(1, n / _BUCKET))))
    dealt = sums.withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, np.int64)
    for r in dealt.groupBy("_bucket").agg(F.count("*").alias("n")).collect():  # a row for each bucket
        sizes[r["_bucket"]] = r["n"]

    def resample(table: pa.Table) -> pa.Table:
        bucket = table.column("_bucket")[0].as_py()
        h, s, c = (table.column(k).to_numpy() for k in ("_h", "_s", "_c"))
        order = np.lexsort((c, s, h))
        weights = cluster_draws(bucket_draws(sizes, bucket, n_boot, seed), len(h), bucket, seed)
        return pa.Table.from_arrays([pa.array(np.arange(n_boot), pa.int32()), pa.array(weights @ s[order]), pa.array(weights @ c[order])], ["r", "s", "c"])

    found = dealt.groupBy("_bucket").applyInArrow(resample, "r int, s double, c double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).where("c > 0").toArrow()  # n_boot rows
    ratios = found.column("s").to_numpy() / found.column("c").to_numpy()
    low, high = np.quantile(ratios, [(1 - level) / 2, (1 + level) / 2]) if len(ratios) else (math.nan, math.nan)
    return Interval(total / count, float(low), float(high), n)


def binomial_two_sided(a: int, b: int) -> float:
    """Exact two-sided p-value of a successes against b at even odds."""
    n, k = a + b, min(a, b)
    if n == 0 or 2 * k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total = 0.0
    while k >= 0 and term > 0:
        total += term
        if term < total * 1e-18:
            break
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * total)


@dataclass(frozen=True)
class McNemar:
    a_only: int
    b_only: int
    p: float


def discordant(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: a_only, b_only, the rows where just one of two boolean columns is true."""
    return df.agg(F.count_if(F.col(a) & ~F.col(b)).alias("a_only"), F.count_if(~F.col(a) & F.col(b)).alias("b_only"))


def top_counts(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The n commonest values with their counts; of equally common ones the least come first."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def mcnemar(df: DataFrame, a: str, b: str) -> McNemar:
    """McNemar's exact test of two boolean columns on the same rows."""
    row = discordant(df, a, b).first()
    return McNemar(row[0], row[1], binomial_two_sided(row[0], row[1]))


def wide_rates(flags: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """The rate over all rows and by each of several groups, in one scan: grouping, value, n, n_violations, violation_rate."""
    entries = [F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value"))]
    entries += [F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in by]
    long = flags.select(F.col(flag).alias("_f"), F.explode(F.array(*entries)).alias("_g")).select("_f", "_g.grouping", "_g.value")
    yes = F.col("_f").cast("int")
    return long.where("value IS NOT NULL").groupBy("grouping", "value").agg(F.count("*").alias("n"), F.sum(yes).cast("long").alias("n_violations"), F.avg(yes).alias("violation_rate"))
