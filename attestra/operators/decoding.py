"""Predictive distributions conditioned on constraints: closed forms over one scope.

A scope is a set of cells, each with a distribution of its own over value indices from 0,
whose joint values a constraint couples. Every form gives log_qc (the log of the mass on
coherent values; -Infinity if there is none), the conditioned marginals, and map, the likeliest
coherent values (null if there are none).

Two-cell forms, agreement, strengths and temperatures are SQL expressions; the
dynamic programmes (cardinality, aggregate sum) and isotonic projection take one scope a row,
many rows an Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import logs as L

NEG = -math.inf
SCOPE = "log_qc double, marginals array<array<double>>, map array<int>"


def _numbers(xs: Sequence) -> str:
    return "array(" + ", ".join(repr(x) for x in xs) + ")"


# Two cells and agreement, as expressions ------------------------------------


def restrict(q: str, mask: str) -> tuple[Column, Column]:
    """(log_qc, distribution) of one cell whose value must be admissible; the distribution is null if none is."""
    kept = f"zip_with({q}, {mask}, (p, ok) -> CASE WHEN ok THEN p ELSE 0D END)"
    mass = f"aggregate({kept}, 0D, (a, x) -> a + x)"
    return F.expr(L.ln(mass)), F.expr(f"CASE WHEN {mass} > 0 THEN transform({kept}, x -> x / {mass}) END")


def relation(df: DataFrame, qa: str, qb: str, allowed: Sequence[Sequence[bool]]) -> DataFrame:
    """df with the scope's columns for two cells whose pair (a, b) must be allowed[a][b]."""
    table = "array(" + ", ".join("array(" + ", ".join("1D" if x else "0D" for x in row) + ")" for row in allowed) + ")"
    flipped = "array(" + ", ".join("array(" + ", ".join("1D" if row[b] else "0D" for row in allowed) + ")" for b in range(len(allowed[0]))) + ")"
    dot = lambda u, v: f"aggregate(zip_with({u}, {v}, (x, y) -> x * y), 0D, (a, x) -> a + x)"
    top = lambda u, v: f"array_max(zip_with({u}, {v}, (x, y) -> x * y))"
    out = df.withColumn("_a", F.expr(f"zip_with({qa}, {table}, (p, row) -> p * {dot('row', qb)})"))
    out = out.withColumn("_b", F.expr(f"zip_with({qb}, {flipped}, (p, row) -> p * {dot('row', qa)})"))
    out = out.withColumn("_mass", F.expr("aggregate(_a, 0D, (s, x) -> s + x)"))
    out = out.withColumn("_best", F.expr(f"zip_with({qa}, {table}, (p, row) -> p * {top('row', qb)})")).withColumn("_ma", F.expr(L.arg_max("_best")))
    out = out.withColumn("_mb", F.expr(L.arg_max(f"zip_with(element_at({table}, _ma + 1), {qb}, (x, y) -> x * y)")))
    return out.select(
        *df.columns,
        F.expr(L.ln("_mass")).alias("log_qc"),
        F.expr("CASE WHEN _mass > 0 THEN array(transform(_a, x -> x / _mass), transform(_b, x -> x / _mass)) END").alias("marginals"),
        F.expr("CASE WHEN _mass > 0 THEN array(_ma, _mb) END").alias("map"),
    )


def not_after(df: DataFrame, qi: str, qj: str) -> DataFrame:
    """df with the scope's columns for two cells on one ordered grid where the first is at most the second."""
    n = f"size({qi})"
    tails = f"transform(sequence(1, {n}), k -> aggregate(slice({qj}, k, {n}), 0D, (a, x) -> a + x))"
    heads = f"transform(sequence(1, {n}), k -> aggregate(slice({qi}, 1, k), 0D, (a, x) -> a + x))"
    out = df.withColumn("_i", F.expr(f"zip_with({qi}, {tails}, (p, t) -> p * t)")).withColumn("_j", F.expr(f"zip_with({qj}, {heads}, (p, h) -> p * h)"))
    out = out.withColumn("_mass", F.expr("aggregate(_i, 0D, (s, x) -> s + x)"))
    out = out.withColumn("_best", F.expr(f"zip_with({qi}, transform(sequence(1, {n}), k -> array_max(slice({qj}, k, {n}))), (p, m) -> p * m)")).withColumn("_mi", F.expr(L.arg_max("_best")))
    out = out.withColumn("_mj", F.expr(f"_mi + {L.arg_max(f'slice({qj}, _mi + 1, {n})')}"))
    return out.select(
        *df.columns,
        F.expr(L.ln("_mass")).alias("log_qc"),
        F.expr("CASE WHEN _mass > 0 THEN array(transform(_i, x -> x / _mass), transform(_j, x -> x / _mass)) END").alias("marginals"),
        F.expr("CASE WHEN _mass > 0 THEN array(_mi, _mj) END").alias("map"),
    )


def sum_by_scope(df: DataFrame, scope: str | Sequence[str], *arrays: str) -> DataFrame:
    """Element-wise sums of arrays over a scope's rows. -Infinity stays; sums are partial before the shuffle."""
    keys = [scope] if isinstance(scope, str) else list(scope)
    entries = F.explode(F.arrays_zip(F.expr(f"sequence(0, size({arrays[0]}) - 1)").alias("k"), *[F.col(a) for a in arrays])).alias("_e")
    sums = df.select(*keys, entries).groupBy(*keys, F.col("_e.k").alias("k")).agg(*[F.sum(f"_e.{a}").alias(a) for a in arrays])
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", *arrays))).alias("_s"))  # as many as classes
    return whole.select(*keys, *[F.expr(f"transform(_s, x -> x.{a})").alias(a) for a in arrays])


def group_agreement(df: DataFrame, scope: str | Sequence[str], log_q: str = "log_q") -> DataFrame:
    """(scope, log_qc, marginal, map) of scopes whose cells (rows) must all have one value; marginal holds for each cell."""
    keys = [scope] if isinstance(scope, str) else list(scope)
    out = sum_by_scope(df, keys, log_q).withColumn("log_qc", F.expr(L.lse(log_q)))
    feasible = f"log_qc > {L.NEG_INF}"
    return out.select(
        *keys, "log_qc", F.expr(f"CASE WHEN {feasible} THEN transform({log_q}, x -> exp(x - log_qc)) END").alias("marginal"),
        F.expr(f"CASE WHEN {feasible} THEN {L.arg_max(log_q)} END").alias("map"),
    )


# Dynamic programmes, one scope a row ----------------------------------------


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _times(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Logs of the first coefficients of the product of two polynomials given by logs."""
    out = np.full(min(len(a) + len(b) - 1, width), NEG)
    for k, x in enumerate(a[: len(out)]):
        n = min(len(b), len(out) - k)
        out[k : k + n] = np.logaddexp(out[k : k + n], x + b[:n])
    return out


def _without_each(factors: list[np.ndarray], around: np.ndarray, width: int) -> list[np.ndarray]:
    """The product of around and all factors but one, for each factor: halves multiply what goes down to the other half."""
    if len(factors) == 1:
        return [around]
    half = len(factors) // 2
    product_of = lambda xs: reduce(lambda a, b: _times(a, b, width), xs)
    left, right = factors[:half], factors[half:]
    return _without_each(left, _times(around, product_of(right), width), width) + _without_each(right, _times(around, product_of(left), width), width)


def cardinality_scope(p: np.ndarray, low: int, high: int) -> tuple[float, list[list[float]], list[int] | None]:
    """Binary cells with probabilities p of which low to high are on.

    A cell is the polynomial (1 - p) + p x; the coefficients of a product are the chances of each count.
    """
    n, low, high = len(p), max(low, 0), min(high, len(p))
    nothing = NEG, [[math.nan, math.nan]] * n, None
    if low > high:
        return nothing
    cells = list(np.stack([_log(1 - p), _log(p)], axis=1))
    others = _without_each(cells, np.zeros(1), high + 1) if n else []
    counts = _times(others[0], cells[0], high + 1) if n else np.zeros(1)
    log_qc = float(np.logaddexp.reduce(counts[low:]))
    if log_qc == NEG:
        return nothing
    yes = [math.exp(cell[1] + np.logaddexp.reduce(rest[max(low - 1, 0) : high]) - log_qc) if high else 0.0 for cell, rest in zip(cells, others)]
    ranked = np.argsort(-p, kind="stable")
    chosen = np.zeros(n, int)
    chosen[ranked[: np.clip(np.count_nonzero(p > 0.5), low, high)]] = 1
    return log_qc, [[1 - x, x] for x in yes], chosen.tolist()


def aggregate_sum_scope(qs: Sequence[np.ndarray], values: Sequence[np.ndarray], total: int) -> tuple[float, list[list[float]], list[int] | None]:
    """Cells with whole values whose sum must be total."""
    forward: list[dict[int, float]] = [{0: 0.0}]
    top: list[dict[int, tuple[float, int]]] = []
    best = {0: 0.0}
    for q, v in zip(qs, values):
        lq, now, peak = _log(np.asarray(q, float)), {}, {}
        for k, (l, x) in enumerate(zip(lq, v)):
            if l == NEG:
                continue
            for s, a in forward[-1].items():
                now[s + int(x)] = np.logaddexp(now.get(s + int(x), NEG), a + l)
            for s, a in best.items():
                if s + int(x) not in peak or a + l > peak[s + int(x)][0]:
                    peak[s + int(x)] = (a + l, k)
        forward.append(now)
        top.append(peak)
        best = {s: a for s, (a, _) in peak.items()}
    log_qc = float(forward[-1].get(total, NEG))
    if log_qc == NEG:
        return NEG, [[math.nan] * len(q) for q in qs], None
    back, marginals, chosen, left = {total: 0.0}, [], [], total
    for i in range(len(qs) - 1, -1, -1):
        lq, new, own = _log(np.asarray(qs[i], float)), {}, []
        for l, x in zip(lq, values[i]):
            reach = NEG
            for s, b in back.items():
                if l > NEG and s - int(x) in forward[i]:
                    reach = np.logaddexp(reach, b + forward[i][s - int(x)])
                    new[s - int(x)] = np.logaddexp(new.get(s - int(x), NEG), b + l)
            own.append(math.exp(l + reach - log_qc) if reach > NEG else 0.0)
        marginals.insert(0, own)
        chosen.insert(0, top[i][left][1])
        left -= int(values[i][chosen[0]])
        back = new
    return log_qc, marginals, chosen


def isotonic_scope(y: np.ndarray, weights: np.ndarray, increasing: bool = True) -> list[float]:
    """Weighted least squares under monotonicity: neighbours out of order are pooled."""
    sign = 1 if increasing else -1
    pools: list[list[float]] = []  # mean, weight, cells
    for v, w in zip(sign * y, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (v1, w1, n1), (v2, w2, n2) = pools[-2:]
            pools[-2:] = [[(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return [sign * v for v, _, n in pools for _ in range(int(n))]


def _per_scope(df: DataFrame, cols: Sequence[str], scope: Callable) -> DataFrame:
    """df with the scope's columns, by a function of some of its columns."""

    @F.pandas_udf(SCOPE)
    def run(*series: pd.Series) -> pd.DataFrame:
        rows = [scope(*x) for x in zip(*series)]
        return pd.DataFrame({"log_qc": [r[0] for r in rows], "marginals": [r[1] for r in rows], "map": [r[2] for r in rows]})

    return df.withColumn("_scope", run(*cols)).select(*df.columns, "_scope.*")


def cardinality(df: DataFrame, p: str, low: str, high: str) -> DataFrame:
    """df with the scope's columns: p holds the cells' probabilities of being on, low and high bound how many are."""
    return _per_scope(df, [p, low, high], lambda p, a, b: cardinality_scope(np.asarray(p, float), int(a), int(b)))


def aggregate_sum(df: DataFrame, qs: str, values: str, total: str) -> DataFrame:
    """df with the scope's columns: qs and values are arrays of arrays, one of them for each cell."""
    return _per_scope(df, [qs, values, total], lambda q, v, t: aggregate_sum_scope(list(q), list(v), int(t)))


def isotonic(df: DataFrame, y: str, weights: str, increasing: bool = True, out: str = "fitted") -> DataFrame:
    """df with the isotonic projection of the series in y, one series a row."""

    @F.pandas_udf("array<double>")
    def run(ys: pd.Series, ws: pd.Series) -> pd.Series:
        return pd.Series([isotonic_scope(np.asarray(a, float), np.asarray(b, float), increasing) for a, b in zip(ys, ws)])

    return df.withColumn(out, run(y, weights))


def brute_force(qs: Sequence[Sequence[float]], coherent: Callable[[tuple[int, ...]], bool]) -> tuple[float, list[list[float]], list[int] | None]:
    """The same by going through all joint values: for small scopes without a closed form."""
    marginals, mass, best, chosen = [[0.0] * len(q) for q in qs], 0.0, 0.0, None
    for values in product(*(range(len(q)) for q in qs)):
        p = math.prod(q[v] for q, v in zip(qs, values)) if coherent(values) else 0.0
        if p > 0:
            mass += p
            for m, v in zip(marginals, values):
                m[v] += p
            if p > best:
                best, chosen = p, list(values)
    if chosen is None:
        return NEG, [[math.nan] * len(q) for q in qs], None
    return math.log(mass), [[x / mass for x in m] for m in marginals], chosen


# Soft conditioning ------------------------------------------------------------


def soft_marginal(raw: str, hard: str, q_c: str, delta: str) -> Column:
    """One cell's marginal where incoherent values count by delta."""
    below = f"({q_c} + {delta} * (1 - {q_c}))"
    return F.expr(f"zip_with({raw}, {hard}, (r, h) -> ({q_c} * h + {delta} * (r - {q_c} * h)) / {below})")


def joint_nll(raw_nll: str, violated: str, log_qc: str, log_delta: float) -> Column:
    """Negative log-likelihood of the true values under strength log_delta (0: none, -inf: hard)."""
    if log_delta == 0:
        return F.col(raw_nll)
    if log_delta == NEG:
        return F.expr(f"CASE WHEN {violated} THEN double('infinity') ELSE {raw_nll} + {log_qc} END")
    norm = L.add(log_qc, f"({log_delta!r}D + {L.not_coherent(log_qc)})")
    return F.expr(f"{raw_nll} + {norm} - CASE WHEN {violated} THEN {log_delta!r}D ELSE 0D END")


def prefers_incoherent(log_coherent: str, log_incoherent: str, log_delta: float) -> Column:
    """The likeliest values under soft conditioning are incoherent ones."""
    if log_delta == NEG:
        return F.lit(False)
    return F.expr(f"{log_incoherent} + {log_delta!r}D > {log_coherent}")


#: Bounds of the log strength; candidates tried in one job; how often the interval is narrowed.
STRENGTH_BOUNDS, CANDIDATES, TURNS = (-1e7, 1e7), 64, 8


def _means(df: DataFrame, values: Sequence[float], expression: str) -> list[float]:
    """The mean over df's rows of an expression in t, for each value of t: one job, combined before the shuffle."""
    tries = F.explode(F.lit([float(v) for v in values])).alias("t")
    rows = df.select("*", tries).groupBy("t").agg(F.avg(F.expr(expression)).alias("m")).collect()  # a row for each value
    found = {r.t: r.m for r in rows}
    return [found.get(float(v)) for v in values]


def strength_objective(df: DataFrame, violated: str, log_qc: str, strengths: Sequence[float]) -> list[float]:
    """The mean validation loss at each log strength, in one job."""
    return _means(df, strengths, f"{L.add(log_qc, f'(t + {L.not_coherent(log_qc)})')} - CASE WHEN {violated} THEN t ELSE 0D END")


def fit_log_strength(df: DataFrame, violated: str, log_qc: str, bounds: tuple[float, float] = STRENGTH_BOUNDS) -> float:
    """The log strength at which violations are as frequent as they are: -inf without any, else within bounds.

    The expected frequency grows with the strength, so each job tries many and narrows the interval.
    """
    rows = df.select(F.expr(f"CASE WHEN {violated} THEN 1D ELSE 0D END").alias("_v"), F.expr(log_qc).alias("_in"), F.expr(L.not_coherent(log_qc)).alias("_out"))
    share = rows.agg(F.avg("_v")).first()[0]
    if not share:
        return NEG
    low, high = bounds
    root = lambda x: math.copysign(abs(x) ** (1 / 3), x)
    for _ in range(TURNS):
        # Steps are even in the cube root, so they are fine around zero and reach the bounds.
        tries = [float(x**3) for x in np.linspace(root(low), root(high), CANDIDATES)]
        tries[0], tries[-1] = low, high
        # Probability of a violation under strength t.
        means = _means(rows, tries, f"exp(t + _out - {L.add('_in', '(t + _out)')})")
        above = [k for k, m in enumerate(means) if m is not None and not math.isnan(m) and m >= share]
        if not above or above[0] == 0:
            return high if not above else low
        low, high = tries[above[0] - 1], tries[above[0]]
        if high - low <= 1e-9 * max(1.0, abs(low)):
            break
    return (low + high) / 2


TEMPERATURE_BOUNDS = (1e-3, 1e7)


def temper(log_q: str, temperature: float) -> Column:
    return F.expr(L.temper(log_q, f"{float(temperature)!r}D"))


def fit_temperature(df: DataFrame, log_q: str, label: str, bounds: tuple[float, float] = TEMPERATURE_BOUNDS) -> float:
    """The temperature that makes the labels likeliest; 1 if none can count.

    Labels that aren't among the classes (-1) or have probability zero don't count. The loss
    is convex in the inverse temperature: each job tries many and keeps the neighbours of the best.
    """
    own = f"element_at({log_q}, {label} + 1)"
    rows = df.where(f"{label} >= 0").select(F.col(log_q).alias("_q"), F.expr(own).alias("_own")).where(f"_own > {L.NEG_INF}")
    low, high = -math.log(bounds[1]), -math.log(bounds[0])
    for _ in range(TURNS):
        tries = np.linspace(low, high, 32)
        means = _means(rows, tries, f"{L.lse('transform(_q, x -> x * exp(t))')} - exp(t) * _own")
        if means[0] is None:
            return 1.0
        k = int(np.argmin(means))
        low, high = float(tries[max(k - 1, 0)]), float(tries[min(k + 1, len(tries) - 1)])
        if high - low < 1e-6:
            break
    return math.exp(-(low + high) / 2)

