"""Exact splits and samples, resampling with replacement, a user's reducers; against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import constraints as K
from attestra.operators import features as X
from attestra.operators import metrics as M
from attestra.operators.reducers import Reducer, reduce_by


def test_split_has_the_exact_share(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a"] * 12 + ["b", "c", None])) for i in range(700)] + [(1000, "alone"), (1001, "two"), (1002, "two")]
    df = spark.createDataFrame(rows, "id long, label string")
    for share in (0.0, 0.2, 0.5, 1.0):
        got = X.stratified_split(df, "label", "id", share, seed=3)
        assert got.columns == ["id", "label", "is_test"]
        found = {r.id: r.is_test for r in got.collect()}
        sizes, taken = Counter(l for _, l in rows), Counter(l for i, l in rows if found[i])
        assert len(found) == len(rows) and all(taken[l] == math.floor(n * share + 0.5) for l, n in sizes.items())
        again = {r.id: r.is_test for r in X.stratified_split(df.repartition(7), "label", "id", share, seed=3).collect()}
        assert again == found
    half = [{r.id: r.is_test for r in X.stratified_split(df, "label", "id", 0.5, seed=k).collect()} for k in (3, 4)]
    assert half[0] != half[1]
    assert X.stratified_split(df.limit(0), "label", "id").count() == 0


def test_sample_is_exact(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS v")
    for n in (0, 1, 999, 5000, 9000):
        assert X.sample_rows(df, n, "id", 1).distinct().count() == min(n, 5000)
    few = {r.id for r in X.sample_rows(df, 40, "id", 1).collect()}
    assert few <= {r.id for r in X.sample_rows(df.repartition(5), 90, "id", 1).collect()}
    copies = spark.createDataFrame([(1,)] * 50, "id int")
    assert X.sample_rows(copies, 20, "id").count() == 20


def test_draws_are_exact():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 30, 64)
    sizes[5] = 0
    draws = np.stack([M.bucket_draws(sizes, b, 200, 9) for b in range(64)])
    assert (draws.sum(axis=0) == sizes.sum()).all() and (draws[5] == 0).all()
    assert np.allclose(draws.mean(axis=1), sizes, atol=2.0)
    dealt = M.cluster_draws(draws[0], int(sizes[0]), 0, 9)
    assert (dealt.sum(axis=1) == draws[0]).all()


def test_bootstrap_against_plain_resampling(spark, monkeypatch):
    monkeypatch.setattr(M, "_BUCKET", 8)  # many buckets
    rnd = random.Random(8)
    rows = [(c, None if c % 10 == 0 else rnd.gauss(c % 5, 1)) for c in range(150) for _ in range(1 + c % 4)]
    df = spark.createDataFrame(rows, "c int, d double")
    got = M.cluster_bootstrap_ci(df, "d", "c", n_boot=2000, seed=1)
    sums, counts = np.zeros(150), np.zeros(150)
    for c, d in rows:
        if d is not None:
            sums[c] += d
            counts[c] += 1
    picked = np.random.default_rng(0).integers(0, 150, (2000, 150))
    low, high = np.quantile(sums[picked].sum(axis=1) / counts[picked].sum(axis=1), [0.025, 0.975])
    assert got.estimate == pytest.approx(sums.sum() / counts.sum()) and got.n_clusters == 150  # those without a known value, too
    assert got.low == pytest.approx(low, abs=0.06) and got.high == pytest.approx(high, abs=0.06)
    again = M.cluster_bootstrap_ci(df.repartition(7), "d", "c", n_boot=2000, seed=1)
    assert (again.low, again.high) == (pytest.approx(got.low), pytest.approx(got.high))
    none = M.cluster_bootstrap_ci(df.where("c % 10 = 0"), "d", "c", n_boot=50)
    assert math.isnan(none.estimate) and none.n_clusters == 15


def trimmed(values):
    """The mean without the least and the greatest tenth."""
    v = sorted(values)
    k = len(v) // 10
    return sum(v[k : len(v) - k]) / (len(v) - 2 * k) if v else None


def trimmed_reducer():
    """States are counts of values; the functions are local, so that they travel to the workers whole."""

    def add(state, values):
        for x, n in zip(*np.unique(values, return_counts=True)):
            state[float(x)] = state.get(float(x), 0) + int(n)
        return state

    def finish(state):
        v = sorted(k for k, n in state.items() for _ in range(n))
        k = len(v) // 10
        return sum(v[k : len(v) - k]) / (len(v) - 2 * k) if v else None

    return Reducer(start=lambda: {}, add=add, merge=lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}, finish=finish)


def test_reducers(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot"] * 9 + [f"g{k}" for k in range(12)] + [None]), k % 2, None if rnd.random() < 0.1 else float(rnd.randrange(50))) for k in range(900)] + [("empty", 0, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    groups = {}
    for g, h, v in rows:
        groups.setdefault((g, h), []).extend([] if v is None else [v])
    got = {(r.g, r.h): r.value for r in reduce_by(df, ["g", "h"], "v", trimmed_reducer(), states=5).collect()}
    assert got.keys() == groups.keys() and all(got[k] == (None if not v else pytest.approx(trimmed(v))) for k, v in groups.items())
    parent = spark.createDataFrame([(g, h, (trimmed(v) or 0.0) + (h if g == "hot" else 0)) for (g, h), v in groups.items() if g], "g string, h int, total double")
    r = K.AggregateConsistency("trimmed", "parent", ["g", "h"], "total", "child", ["g", "h"], "v", agg=trimmed_reducer()).check({"parent": parent, "child": df})
    assert (r.n_checked, r.n_violations) == (parent.count(), 1) and r.violations.first().g == "hot"
    assert reduce_by(df.limit(0), ["g"], "v", trimmed_reducer()).count() == 0


def test_reducers_of_many_keys_take_each_keys_values_together(spark):
    """With many keys, in no order, a state is told once for each key and range, not for each row."""
    told = spark.sparkContext.accumulator(0)

    def add(state, values):
        told.add(1)
        return state + values.sum()

    total = Reducer(lambda: 0.0, add, lambda a, b: a + b, float)
    rows = spark.range(60_000).selectExpr("IF(id % 2 = 0, -1, id * 7919 % 3001) AS g", "double(id % 11) AS v").repartition(6)
    expected = {r.g: r.v for r in rows.groupBy("g").agg(F.sum("v").alias("v")).collect()}
    assert {r.g: r.value for r in reduce_by(rows, ["g"], "v", total).collect()} == expected
    assert told.value < 2 * len(expected)
