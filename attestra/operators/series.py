"""Isotonic projection of one long series, spread over ranges of its order.

The projection's values are the slopes of the lower convex hull of the points (sum of weights, sum of weight *
value) along the series. Each range pools its own neighbours, which gives its own hull. Of the whole
hull only the edges across borders of ranges are then unknown. For each border a line between a point on
either side is tilted until no point of the series lies below it: every turn asks all ranges for their
lowest point along the line, by a search in their hulls, and puts it in place of the end on its side. The
line then lies on the hull, so its end points tell which pools of a range are joined with those of others. The driver
holds a line for each border; a turn moves a point for each border and range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.sources.shared import store

#: Far above what is needed: each turn finds another vertex of the hull.
TURNS = 500


def pooled(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the pools of a series under a rising order."""
    means, weights, ends = [], [], []
    for k, (m, v) in enumerate(zip(y.tolist(), w.tolist())):
        while means and means[-1] > m:
            m = (means[-1] * weights[-1] + m * v) / (weights[-1] + v)
            v += weights.pop()
            means.pop()
            ends.pop()
        means.append(m)
        weights.append(v)
        ends.append(k + 1)
    return np.array(ends, np.int64)


def _ranges(df: DataFrame, order: Sequence[str], y: str, weight: str | None, sign: int) -> DataFrame:
    """(row, range, end, sum, local, vertex), stored: by range, sums of weights and of weight * value up to each row, and the range's own fit."""
    w = F.lit(1.0) if weight is None else df[f"`{weight}`"].cast("double")
    v = df[f"`{y}`"].cast("double") * sign
    use = F.coalesce(~F.isnan(v) & ~F.isnan(w) & v.isNotNull() & (w > 0), F.lit(False))
    simple = [f"`{f.name}`" for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.when(use, v).alias("v"), F.when(use, w).otherwise(0.0).alias("w"), *[df[f"`{c}`"].alias(f"o{k}") for k, c in enumerate(order)], F.expr(f"xxhash64({', '.join(simple)})").alias("tie"))
    by = [*[f"o{k}" for k in range(len(order))], "tie"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("row", "v", "w")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        w = t.column("w").to_numpy()
        use = w > 0
        v = np.where(use, np.nan_to_num(t.column("v").to_numpy(zero_copy_only=False).astype(float)), 0.0)
        end, total = np.cumsum(w), np.cumsum(w * v)
        places = np.flatnonzero(use)
        local, vertex = np.full(len(w), np.nan), np.zeros(len(w), bool)
        if len(places):
            last = places[pooled(v[places], w[places]) - 1]
            slope = np.diff(total[last], prepend=0.0) / np.diff(end[last], prepend=0.0)
            vertex[last] = True
            local[places] = slope[np.searchsorted(last, places)]
        part = TaskContext.get().partitionId()
        at = 0
        for b in held:
            s = slice(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), *[pa.array(x[s]) for x in (end, total, local, vertex)], pa.array(use[s])], ["row", "range", "end", "sum", "local", "vertex", "used"])

    kind = rows.schema["row"].dataType.simpleString()
    return store(dealt.mapInArrow(run, f"row {kind}, range int, end double, sum double, local double, vertex boolean, used boolean"), "series")


def _lowest(offsets: dict[int, tuple[float, float]], slopes: np.ndarray, borders: np.ndarray):
    """For a range's hull: its lowest point along each line."""

    def find(table: pa.Table) -> pa.Table:
        w0, s0 = offsets[table.column("range")[0].as_py()]
        order = np.argsort(table.column("end").to_numpy())
        w = w0 + np.r_[0.0, table.column("end").to_numpy()[order]]
        s = s0 + np.r_[0.0, table.column("sum").to_numpy()[order]]
        at = np.searchsorted(np.diff(s) / np.diff(w), slopes, "left")
        return pa.Table.from_arrays([pa.array(borders), pa.array(s[at] - slopes * w[at]), pa.array(w[at]), pa.array(s[at])], ["border", "value", "w", "s"])

    return find


def _lines(hull: DataFrame, offsets: dict[int, tuple[float, float]], borders: np.ndarray, whole: tuple[float, float]) -> list[tuple[float, float, float]]:
    """(from, to, slope) of the hull's edges at the borders, in order; from and to are sums of weights."""
    left = np.zeros((len(borders), 2))
    right = np.tile(np.array(whole), (len(borders), 1))
    going = np.arange(len(borders))
    for _ in range(TURNS):
        if not len(going):
            break
        slopes = (right[going, 1] - left[going, 1]) / (right[going, 0] - left[going, 0])

        points = hull.groupBy("range").applyInArrow(_lowest(offsets, slopes, going), "border bigint, value double, w double, s double")
        found = points.groupBy("border").agg(F.min(F.struct("value", "w", "s")).alias("p")).collect()  # a row for each border
        more = []
        for r in found:
            b = r.border
            line = left[b, 1] - (right[b, 1] - left[b, 1]) / (right[b, 0] - left[b, 0]) * left[b, 0]
            if r.p.value < line - 1e-12 * (abs(left[b, 1]) + abs(right[b, 1]) + abs(line)):
                (left if r.p.w <= borders[b] else right)[b] = r.p.w, r.p.s
                more.append(b)
        going = np.array(sorted(more), np.int64)
    else:
        raise RuntimeError("a line didn't come to rest")
    out: list[list[float]] = []
    for (a, s), (b, t) in sorted(zip(map(tuple, left), map(tuple, right))):
        if out and a < out[-1][1]:  # parts of one edge
            if b > out[-1][1]:
                out[-1][1:] = [b, (t - out[-1][3]) / (b - out[-1][0]), out[-1][3]]
        else:
            out.append([a, b, (t - s) / (b - a), s])
    return [(a, b, m) for a, b, m, _ in out]


def isotonic_series(df: DataFrame, order: Sequence[str], y: str, weight: str | None = None, increasing: bool = True, out: str = "fitted") -> DataFrame:
    """df with the least squares fit of y that never falls (or rises) along `order`, over the whole table as one series.

    Rows with a missing y, or a weight that is missing or not above zero, take no part and have a null fit. Rows that
    agree in all of `order` are taken in the order of a hash of the whole row. Sorts and searches at once; the last step is lazy.
    """
    sign = 1 if increasing else -1
    stored = _ranges(df, order, y, weight, sign)
    totals = stored.where("used").groupBy("range").agg(F.max(F.struct("end", "sum")).alias("t")).orderBy("range").collect()  # a row for each range
    offsets, at, total = {}, 0.0, 0.0
    for r in totals:
        offsets[r.range] = (at, total)
        at, total = at + r.t.end, total + r.t.sum
    borders = np.array([w for w, _ in list(offsets.values())[1:]])
    lines = _lines(stored.where("vertex").select("range", "end", "sum"), offsets, borders, (at, total)) if len(borders) else []
    starts, ends, slopes = (np.array(x) for x in zip(*lines)) if lines else (np.zeros(0), np.zeros(0), np.zeros(0))

    def run(batches):
        for b in batches:
            fit = b.column("local").to_numpy(zero_copy_only=False).copy()
            if len(starts):
                place = np.array([offsets.get(k, (0.0, 0.0))[0] for k in b.column("range").to_pylist()]) + b.column("end").to_numpy()
                k = np.searchsorted(starts, place, "left") - 1
                joined = (k >= 0) & (place <= ends[np.maximum(k, 0)])
                fit = np.where(joined, slopes[np.maximum(k, 0)], fit)
            none = ~b.column("used").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sign * fit, pa.float64(), mask=none)], ["row", "fit"])

    kind = stored.schema["row"].dataType.simpleString()
    fitted = stored.select("row", "range", "end", "local", "used").mapInArrow(run, f"row {kind}, fit double")
    return fitted.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out], F.col("fit").alias(out))
