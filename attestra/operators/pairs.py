"""Pairs of rows within a group, when a group may hold a large share of all rows.

`tiled_pairs` makes the pairs: a large group's rows are dealt into blocks, and each two blocks
meet in a task of their own, a tile of the group's triangle, so no task has more than a tile's pairs.

`order_denial_counts` counts pairs that stand in a wrong order without making them. Rows are sorted by group
and order over range partitions. A task counts what is out of order within its range by merging.
Pairs across ranges exist only in groups that lie in several; their rows are sorted once more, by
value, where a task again counts within its range, and what is left are counts of ranges
by ranges. So the work is two sorts, whatever the groups' sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions.codes import codes_of
from attestra.functions.hot import join_facts
from attestra.functions.nulls import join_same, nan_to_null
from attestra.sources.shared import store

#: Rows of a block of a group's triangle: a tile has its square of pairs at most, on average.
TILE = 2048


def tiled_pairs(rows: DataFrame, keys: Sequence[str], id_col: str, suffixes: tuple[str, str], tile: int = TILE) -> DataFrame:
    """The pairs of rows with the same keys and id_l < id_r: keys, then the other columns with either suffix.

    Rows without an id are in no pair. Rows that agree in all columns share a block.
    """
    rows = rows.where(F.col(f"`{id_col}`").isNotNull())
    others = [c for c in rows.columns if c not in keys]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > tile)
    sized = join_facts(rows, sizes, keys, sizes)
    blocks = F.coalesce(F.ceil(F.col("_n") / tile), F.lit(1)).cast("int")
    dealt = sized.select(*keys, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), blocks.alias("_blocks"))
    dealt = dealt.withColumn("_block", F.expr("cast(pmod(xxhash64(_row), _blocks) AS int)"))
    one = dealt.select(*keys, F.col("_row").alias("_x"), F.col("_block").alias("_i"), F.explode(F.expr("sequence(_block, _blocks - 1)")).alias("_j"))
    two = dealt.select(*keys, F.col("_row").alias("_y"), F.explode(F.expr("sequence(0, _block)")).alias("_i"), F.col("_block").alias("_j"))
    met = join_same(one, two, [*keys, "_i", "_j"], how="inner")
    x, y = F.col("_x")[id_col], F.col("_y")[id_col]
    met = met.where(((F.col("_i") == F.col("_j")) & (x < y)) | ((F.col("_i") < F.col("_j")) & (x != y)))
    left, right = F.when(x < y, F.col("_x")).otherwise(F.col("_y")), F.when(x < y, F.col("_y")).otherwise(F.col("_x"))
    return met.select(*keys, *[s[c].alias(c + suffix) for s, suffix in ((left, suffixes[0]), (right, suffixes[1])) for c in others])


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """The weight of the pairs i < j with values[i] > values[j]: a merge sort, all blocks of a level at once."""
    n, total = len(values), 0
    if n < 2:
        return 0
    _, rank = np.unique(values, return_inverse=True)
    down = int(rank.max()) - rank  # 0 is the greatest
    order = np.arange(n)
    for level in range((n - 1).bit_length()):
        pair, second = order >> (level + 1), (order >> level & 1).astype(bool)
        # Of equal values the second half's come first, so that they don't count.
        at = np.argsort((pair * (int(down.max()) + 1) + down[order]) * 2 + ~second, kind="stable")
        order, pair, second = order[at], pair[at], second[at]
        first = np.cumsum(np.where(second, 0, weights[order]))
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        before = np.r_[0, first[:-1]][starts]
        since = first - np.repeat(before, np.diff(np.r_[starts, n]))
        total += int((weights[order] * since)[second].sum())
    return total


def _counted(rows: DataFrame, by: Sequence[Column], keys: Sequence[str], value: str, descending: bool, place: str) -> DataFrame:
    """rows by ranges of `by` and in its order, stored, with two more columns.

    place: the number of the range. _within: on a range's first row the weight _n * _n of its pairs with equal
    keys and, in their order, a falling value (with descending: a rising one); zero on all others.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = list(kinds)

    def count(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        group = np.zeros(t.num_rows, np.int64)
        for k in keys:
            codes = codes_of(t.column(k))
            group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        number = np.cumsum(np.diff(group, prepend=group[0]) != 0)  # a later group's values are all greater
        codes = codes_of(t.column(value), ordered=True)
        codes = int(codes.max()) - codes if descending else codes
        n = inversions(number * (int(codes.max()) + 1) + codes, t.column("_n").to_numpy())
        for b in held:
            within = np.zeros(b.num_rows, np.int64)
            within[0], n = n, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, TaskContext.get().partitionId(), np.int32)), pa.array(within)], [*names, place, "_within"])

    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return store(ordered.mapInArrow(count, ", ".join(f"{n} {t}" for n, t in kinds.items()) + f", {place} int, _within bigint"), "ordered")


def _between(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n): of (keys, turn, range, w) the weight of pairs with an earlier turn and a lesser range."""
    turns, ranges = grid.select(*keys, "_turn").distinct(), grid.select(*keys, "_range").distinct()
    whole = join_same(join_same(turns, ranges, keys, how="inner"), grid, [*keys, "_turn", "_range"]).withColumn("_w", F.coalesce("_w", F.lit(0)))
    earlier = W.partitionBy(*keys, "_range").orderBy("_turn").rowsBetween(W.unboundedPreceding, -1)
    lesser = W.partitionBy(*keys, "_turn").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = whole.withColumn("_before", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    return before.withColumn("_less", F.coalesce(F.sum("_before").over(lesser), F.lit(0))).select((F.col("_less") * F.col("_w")).alias("n"))


def count_inversions(rows: DataFrame, keys: Sequence[str], order_col: str, value_col: str, rising: bool = False) -> DataFrame:
    """(n): how many pairs of rows with the same keys have order_l < order_r and value_l > value_r (with rising: <).

    Missing orders and values are in no pair; missing keys match. A task holds the keys, values and
    counts of its range. Runs the sorts at once; the last sums are lazy.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    given = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, k)], F.col(f"`{order_col}`").alias("_order"), F.col(f"`{value_col}`").alias("_value"))
    counted = given.where("_order IS NOT NULL AND _value IS NOT NULL").groupBy(*k, "_order", "_value").agg(F.count("*").alias("_n"))
    # Within one order, values stand so that they make no pair.
    tie = F.desc("_value") if rising else F.asc("_value")
    first = _counted(counted, [*map(F.asc, k), F.asc("_order"), tie], k, "_value", rising, "_range")
    parts = [first.select(F.col("_within").alias("n"))]
    # At most one group lies across each border of two ranges.
    across = first.groupBy(*k).agg(F.min("_range").alias("a"), F.max("_range").alias("b")).where("a < b").select(*k)
    if across.take(1):
        far = join_same(first, F.broadcast(across), k, how="left_semi").groupBy(*k, "_value", "_range").agg(F.sum("_n").alias("_n"))
        # From the end that the earlier of a pair has: whatever comes before from a lesser range is a pair, but for equal values.
        start = F.asc("_value") if rising else F.desc("_value")
        second = _counted(far, [*map(F.asc, k), start, F.desc("_range")], k, "_range", True, "_turn")
        grid = second.groupBy(*k, "_turn", "_range").agg(F.sum("_n").alias("_w"))
        parts += [second.select(F.col("_within").alias("n")), _between(grid, k)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(0)).cast("long").alias("n"))


def count_pairs(rows: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """(n): how many pairs of rows with the same keys have order_l < order_r. Counts of counts only."""
    per = rows.where(F.col(f"`{order_col}`").isNotNull()).groupBy(*keys, order_col).agg(F.count("*").cast("decimal(19,0)").alias("_n"))
    sums = per.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.col("_n")).alias("_own"))
    return sums.agg(F.coalesce(F.sum((F.col("_all").cast("decimal(19,0)") * F.col("_all").cast("decimal(19,0)") - F.col("_own")) / 2), F.lit(0)).cast("long").alias("n"))


def order_denial_counts(rows: DataFrame, keys: Sequence[str], order_col: str, value_col: str, relation: str) -> DataFrame:
    """(n_checked, n_violations): pairs with order_l < order_r, and those of them whose values are in the relation."""
    rows = nan_to_null(rows.select(*dict.fromkeys([*keys, order_col, value_col])))
    out = count_inversions(rows, keys, order_col, value_col, rising=relation in ("<", ">="))
    checked = count_pairs(rows, keys, order_col)
    if relation in ("<=", ">="):  # all pairs of known values but those in the contrary relation
        known = count_pairs(rows.where(F.col(f"`{value_col}`").isNotNull()), keys, order_col).withColumnRenamed("n", "known")
        out = out.join(F.broadcast(known)).select((F.col("known") - F.col("n")).alias("n"))  # one row each
    return checked.withColumnRenamed("n", "n_checked").join(F.broadcast(out.withColumnRenamed("n", "n_violations")))
