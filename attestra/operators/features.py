"""Joins that feed models and constraints: guarded lookups, as-of averages, date windows, counterfactuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions.hot import join_facts
from attestra.functions.nulls import as_list, holds, join_same
from attestra.sources.shared import store


def _guard(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """df; evaluating a row where `broken` holds fails the job."""
    return df.where(F.when(broken, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def lookup(df: DataFrame, other: DataFrame, on, other_on=None, columns: Sequence[str] | None = None, required: bool = False) -> DataFrame:
    """df with other's columns: at most one row of other for each key, so df's rows stay as many.

    A key that other holds twice fails the job, and so does a row without a match if required.
    """
    on, other_on = as_list(on), as_list(other_on or on)
    columns = [c for c in other.columns if c not in other_on] if columns is None else list(columns)
    one = other.groupBy(*other_on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    one = _guard(one, F.col("_n") > 1, f"more than one row for a key of {', '.join(other_on)}").withColumnRenamed("_n", "_found")
    out = join_same(df, one, on, other_on)
    if required:
        out = _guard(out, F.col("_found").isNull(), f"no row for a key of {', '.join(on)}")
    return out.drop("_found")


def lag_mean(instances: DataFrame, history: DataFrame, key, time_col: str, value_col: str, n: int = 5, history_time: str | None = None,
             tiebreak=(), out: str = "lag_mean") -> DataFrame:
    """instances with the mean of the key's last n values in history strictly before its time.

    A missing value takes one of the n places without counting. Of rows of equal time in
    history the tie-break decides. Without earlier values the mean is null.

    History and instances are sorted once by key and time, instances before history of the same
    time; each history row knows the last n up to itself, and an instance takes those of
    the latest one. A key with more than a share of all rows is cut into SLICES by time, each of
    which takes over the last n values of those before it; the list of such keys, at
    most 4 * shuffle partitions, is broadcast.
    """
    key, tie = as_list(key), as_list(tiebreak)
    asked = instances.select(F.struct("*").alias("_row"), *key, F.col(time_col).alias("_t"), F.lit(0).alias("_side"), *[F.lit(None).cast(history.schema[c].dataType).alias(f"_tie_{c}") for c in tie])
    known = history.select(*key, F.col(history_time or time_col).alias("_t"), F.lit(1).alias("_side"), F.struct(F.col(value_col).cast("double").alias("v")).alias("_v"), *[F.col(c).alias(f"_tie_{c}") for c in tie])
    known = known.where(F.col("_t").isNotNull())
    both = asked.unionByName(known, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_tie_{c}" for c in tie]]
    edges = _time_slices(both, known, key)
    part, before = key, None
    if edges is not None:
        part = [*key, "_slice"]
        sliced = lambda df: join_same(df, F.broadcast(edges), key).withColumn("_slice", F.expr("coalesce(size(filter(_edges, e -> e < _t)), 0)")).drop("_edges")
        both = sliced(both)
        before = _carried(sliced(known), edges, key, order, n)
    both = both.repartition(*part)
    last = W.partitionBy(*part, "_side").orderBy(*order).rowsBetween(-(n - 1), W.currentRow)
    both = both.withColumn("_last", F.when(F.col("_side") == 1, F.collect_list("_v").over(last)))
    so_far = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_seen", F.last("_last", ignorenulls=True).over(so_far)).where("_side = 0")
    seen = "_seen"
    if before is not None:
        both = join_same(both, F.broadcast(before), part)
        seen = f"slice(reverse(concat(coalesce(_before, array()), coalesce(_seen, array()))), 1, {n})"
    values = F.filter(F.expr(f"transform({seen}, x -> x.v)"), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.when(F.col("_t").isNotNull() & (F.size(values) > 0), F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    return both.select("_row.*", mean.alias(out))


#: Parts that a hot key's history is cut into, and rows from which on a key is hot.
SLICES, HOT = 32, 100_000


def _time_slices(both: DataFrame, known: DataFrame, key: list[str]) -> DataFrame | None:
    """(key, _edges): times that cut the history of each hot key; None if no key is hot."""
    width = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = both.groupBy(*key).agg(F.count("*").alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most * 4 * width <= total or most < HOT:
        return None
    hot = sizes.where(F.col("_n") * 4 * width > total).select(*key)
    shares = [k / SLICES for k in range(1, SLICES)]
    return join_same(known, F.broadcast(hot), key, how="inner").groupBy(*key).agg(F.percentile_approx("_t", shares).alias("_edges"))


def _carried(known: DataFrame, edges: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """(key, _slice, _before): the last n values before each slice of the hot keys."""
    late = F.row_number().over(W.partitionBy(*key, "_slice").orderBy(*[F.desc(c) for c in order]))
    tails = known.withColumn("_late", late).where(F.col("_late") <= n)
    tails = tails.groupBy(*key, "_slice").agg(F.array_sort(F.collect_list(F.struct((-F.col("_late")).alias("place"), "_v"))).alias("_tail"))
    every = edges.select(*key, F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_slice"))
    earlier = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    lists = join_same(every, tails, [*key, "_slice"]).withColumn("_all", F.flatten(F.collect_list(F.coalesce("_tail", F.array().cast(tails.schema["_tail"].dataType))).over(earlier)))
    kept = F.expr(f"reverse(slice(reverse(transform(_all, x -> x._v)), 1, {n}))")
    return lists.select(*key, "_slice", kept.alias("_before"))


def windows_ahead(dates: DataFrame, date_col: str, rows: DataFrame, row_date: str, days: int, *aggregates: Column) -> DataFrame:
    """For each distinct date d: aggregates over the rows in (d, d + days]; a date without rows stays.

    A range join by day buckets as wide as the window: a date meets the rows of two buckets, not all.
    Aggregates see columns of `rows` (null for a date without any).
    """
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    distinct = dates.where(F.col(date_col).isNotNull()).select(F.col(date_col).alias("_d")).distinct()
    asked = distinct.withColumn("_bucket", F.explode(F.array(F.floor(day("_d") / days), F.floor(day("_d") / days) + 1)))
    held = rows.withColumn("_bucket", F.floor(day(row_date) / days)).withColumn("_at", F.col(row_date))
    hit = asked.join(held, "_bucket").where((F.col("_at") > F.col("_d")) & (F.col("_at") <= F.col("_d") + F.expr(f"INTERVAL {days} DAYS")))
    empty = distinct.join(hit.select(F.col("_d").alias("_hit")).distinct(), F.col("_d") == F.col("_hit"), "left_anti")
    everything = hit.drop("_bucket", "_at").unionByName(empty, allowMissingColumns=True)
    return everything.groupBy(F.col("_d").alias(date_col)).agg(*aggregates)


def aligned(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df with other's columns by a key that both hold once each; a key of df that other lacks, or that either repeats, fails the job."""
    alone = df.groupBy(key).agg(F.count("*").alias("_n"))
    repeated = alone.where("_n > 1").select(key, F.lit(True).alias("_repeated"))
    out = join_same(lookup(df, other, key, required=True), repeated, [key])
    return _guard(out, F.col("_repeated").isNotNull(), f"more than one row for a {key}").drop("_repeated")


#: Buckets of hashes that a quota's threshold is looked for in; their counts are what meets.
BUCKETS = 1 << 16


def _least_hashes(df: DataFrame, stratum: Column, quota: Column, keys: Sequence[str], seed: int, out: str) -> DataFrame:
    """df with the boolean out: the rows of the least hashes of their keys in each stratum, exactly as many as its quota.

    quota is a column over the stratum's size _n. Counts by bucket of the hash tell the bucket in which the
    quota is reached; only that bucket's rows, some 1 in BUCKETS, are ranked. Nothing is sorted as a whole. Rows
    that agree in all keys are taken in any order.
    """
    hashed = df.select("*", stratum.alias("_s"), F.xxhash64(F.lit(seed), *keys).alias("_h"))
    hashed = hashed.withColumn("_b", F.shiftright(F.col("_h"), 48))  # signed: buckets in the order of the hashes
    counts = store(hashed.groupBy("_s", "_b").agg(F.count("*").alias("_in")), "buckets")
    sizes = counts.groupBy("_s").agg(F.sum("_in").alias("_n"))
    before = F.coalesce(F.sum("_in").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    filled = join_same(counts.withColumn("_before", before), sizes.withColumn("_quota", quota.cast("long")).drop("_n"), ["_s"])
    # The last bucket that is taken whole, and the one that isn't, with the rows it still gives.
    whole, rest = F.col("_before") + F.col("_in") <= F.col("_quota"), F.col("_quota") - F.col("_before")
    edges = filled.groupBy("_s").agg(F.max(F.when(whole, F.col("_b"))).alias("_upto"), F.min(F.when(~whole & (rest > 0), F.struct("_b", rest.alias("n")))).alias("_edge"))
    marked = join_facts(hashed, edges, ["_s"], sizes).withColumn("_at_edge", holds(F.col("_b") == F.col("_edge._b")))
    inside = marked.where("NOT _at_edge").withColumn(out, holds(F.col("_b") <= F.col("_upto")))
    place = F.row_number().over(W.partitionBy("_s").orderBy("_h", *keys))
    border = marked.where("_at_edge").withColumn(out, place <= F.col("_edge.n"))
    return inside.unionByName(border).select(*df.columns, out)


def sample_rows(df: DataFrame, n: int, keys, seed: int = 0) -> DataFrame:
    """n rows by the least hashes of their keys: the same ones however the table is dealt out, and no more than a bucket is sorted."""
    return _least_hashes(df, F.lit(0), F.least(F.lit(n), F.col("_n")), as_list(keys), seed, "_taken").where("_taken").drop("_taken")


def flag_errors(df: DataFrame, truth: str, predicted: str, out: str = "error") -> DataFrame:
    """df with 1.0 where truth and prediction differ; where either is missing they do."""
    return df.withColumn(out, (~F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))).cast("double"))


def thresholded(df: DataFrame, score: str, out: str, threshold: float = 0.5) -> DataFrame:
    """df with a score as 0 or 1; a missing score stays missing."""
    return df.withColumn(out, (F.col(score) >= threshold).cast("int"))


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key with its support n and share; of equally common ones the least. Missing ones don't count."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"))).alias("b"), F.sum("n").alias("all"))
    return best.select(key, F.col("b.value").alias(value), (-F.col("b.less")).alias("n"), (-F.col("b.less") / F.col("all")).alias("share"))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by `order`, which leaves no ties; kept whole by one aggregate, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def step_function(x: Column, steps: Sequence[tuple[int, int]], name: str = "value") -> Column:
    """The value of the last step that x reaches; steps are (from, value). Below the first the job fails."""
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for start, value in sorted(steps, reverse=True):
        out = out.when(x >= start, F.lit(value))
    return out.otherwise(F.raise_error(F.concat(F.lit(f"no {name} for "), x.cast("string"))).cast("int"))


def sentinels_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative codes stand for missing values."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})


def perturb(df: DataFrame, col: str, delta: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """The rows where col is known, with col moved by delta and clipped to its range."""
    moved = F.col(col) + delta
    moved = F.greatest(moved, F.lit(low)) if low is not None else moved
    moved = F.least(moved, F.lit(high)) if high is not None else moved
    return df.where(F.col(col).isNotNull()).withColumn(col, moved)


def known_categories(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df where values that train doesn't have are null."""
    out = df
    for c in cols:
        vocabulary = train.select(F.col(c).alias("_known")).where("_known IS NOT NULL").distinct()
        out = out.join(vocabulary, F.col(c) == F.col("_known"), "left").withColumn(c, F.col("_known")).drop("_known")
    return out.select(*df.columns)


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with the boolean is_test: of each label's n rows those of the least hashes, test_share * n rounded half up, whatever the partitions."""
    return _least_hashes(df, F.col(label), F.floor(F.col("_n") * test_share + 0.5), [id_col], seed, "is_test")
