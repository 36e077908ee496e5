"""Running aggregates over whole tables: prefix scans by ranges, with carries.

Rows are sorted by group and order over range partitions. Each range is scanned by itself; a
group that lies in several ranges, of which there is at most one for each border, gets what its earlier
ranges have come to. Any aggregate whose states merge can be carried: sums, counts, least
and greatest values, and the greatest value with the place where it was first reached. So no task holds more than
its range, however large the group; with no keys at all the whole table is one group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions.nulls import join_same
from attestra.sources.shared import store


@dataclass(frozen=True)
class Running:
    """over: the aggregate of a frame of rows; merge: two of its results, the earlier one first. Either may be null."""

    over: Column
    merge: Callable[[Column, Column], Column]


def running_sum(x: Column) -> Running:
    return Running(F.sum(x), lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))


def running_count(x: Column | str = "*") -> Running:
    return Running(F.count(x), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_max(x: Column) -> Running:
    return Running(F.max(x), lambda a, b: F.greatest(a, b))


def running_min(x: Column) -> Running:
    return Running(F.min(x), lambda a, b: F.least(a, b))


def running_max_at(x: Column, place: Column) -> Running:
    """struct(value, place): the greatest value so far, and the place of the first row that has it. Places rise."""
    return Running(
        F.min_by(F.struct(x.alias("value"), place.alias("place")), F.struct(F.when(x.isNull(), 1).otherwise(0), -x, place)),
        lambda a, b: F.when(a["value"].isNull() | (b["value"] > a["value"]), b).otherwise(a),
    )


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], **aggregates: Running) -> DataFrame:
    """df with each aggregate over the rows of its keys up to its own, by `order`, as a column of its name.

    Missing keys match, missing orders come first. `order` should leave no ties: tied rows are taken in the order of
    a hash of the whole row. Sorts the table at once; the scan itself is lazy.
    """
    keys, order = list(keys), list(order)
    names = df.columns
    simple = [f"`{f.name}`" for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    tied = df.withColumn("_tie", F.expr(f"xxhash64({', '.join(simple)})"))
    dealt = store(tied.repartitionByRange(*keys, *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    own = W.partitionBy("_range", *keys).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = dealt.select(*dealt.columns, *[a.over.over(own).alias(n) for n, a in aggregates.items()])
    sums = dealt.groupBy("_range", *keys).agg(*[a.over.alias(n) for n, a in aggregates.items()])
    if keys:
        several = dealt.groupBy(*keys).agg(F.min("_range").alias("_a"), F.max("_range").alias("_b")).where("_a < _b").select(*keys)
        sums = join_same(sums, F.broadcast(several), keys, how="left_semi")  # at most one key for each border of ranges
    carried = store(_carries(sums, keys, aggregates), "carries")
    out = join_same(within, F.broadcast(carried), ["_range", *keys])  # a row for each range, and one more for each border
    return out.select(*names, *[F.when(F.col("_has"), a.merge(F.col(f"_before_{n}"), F.col(n)).cast(sums.schema[n].dataType)).otherwise(F.col(n)).alias(n) for n, a in aggregates.items()])


def _carries(sums: DataFrame, keys: list[str], aggregates: dict[str, Running]) -> DataFrame:
    """(range, keys, _has, _before_...): for each key's ranges but the first, the merged states of its earlier ones.

    A key's states, one for each of its ranges, are merged in order in one row.
    """
    states = F.struct("_range", *[F.col(n) for n in aggregates])
    lists = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", states.alias("state")))).alias("_all"))
    bare = F.struct(*[F.get("_all", 0)["state"][n].alias(n) for n in aggregates])
    kinds = {n: sums.schema[n].dataType for n in aggregates}  # sums of decimals would widen with each merge
    step = lambda s, x: F.struct(*[a.merge(s[n], x["state"][n]).cast(kinds[n]).alias(n) for n, a in aggregates.items()])
    first = F.struct(bare.alias("now"), F.array(F.struct(F.lit(-1).alias("_range"), bare.alias("before"))).alias("out"))
    grow = lambda s, x: F.struct(step(s["now"], x).alias("now"), F.concat(s["out"], F.array(F.struct(x["_range"].alias("_range"), s["now"].alias("before")))).alias("out"))
    told = lists.select(*keys, F.explode(F.reduce(F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1))), first, grow)["out"]).alias("_x")).where("_x._range >= 0")
    return told.select(*keys, F.col("_x._range").alias("_range"), F.lit(True).alias("_has"), *[F.col(f"_x.before.{n}").alias(f"_before_{n}") for n in aggregates])
