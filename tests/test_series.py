"""Isotonic projection over ranges, against the projection of one array."""

import numpy as np
import pytest

from attestra.operators.decoding import isotonic_scope
from attestra.operators.series import isotonic_series

SHAPES = {
    "noise": lambda n, rng: np.linspace(0, 3, n) + rng.normal(size=n),
    "rising": lambda n, rng: np.cumsum(rng.random(n)),
    "falling": lambda n, rng: -np.arange(n, dtype=float),
    "late_low": lambda n, rng: np.r_[np.arange(n - 1, dtype=float), -float(n) ** 2 / 4],
    "ties": lambda n, rng: rng.integers(0, 4, n).astype(float),
    "walk": lambda n, rng: np.cumsum(rng.normal(size=n)),
    "flat": lambda n, rng: np.ones(n),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_series(spark, shape):
    rng = np.random.default_rng(3)
    n = 1500
    y, w = SHAPES[shape](n, rng), rng.integers(1, 6, n).astype(float)
    df = spark.createDataFrame([(i, float(v), float(x), "k") for i, (v, x) in enumerate(zip(y, w))], "id int, y double, w double, row string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for up in (True, False):
            got = isotonic_series(df, ["id"], "y", "w", up)
            assert got.columns == ["id", "y", "w", "row", "fitted"]
            found = np.array([r.fitted for r in got.orderBy("id").collect()])
            assert np.allclose(found, isotonic_scope(y, w, up), atol=1e-8 * max(1, np.abs(y).max())), up
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    rows = [(1, 3.0, 1.0), (2, None, 1.0), (3, 1.0, 1.0), (4, float("nan"), 1.0), (5, 2.0, 0.0), (6, 5.0, None), (7, 4.0, 2.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, y double, w double")
    got = {r.id: r.fitted for r in isotonic_series(df, ["id"], "y", "w").collect()}
    assert got == {None: 1.0, 1: 2.0, 2: None, 3: 2.0, 4: None, 5: None, 6: None, 7: 4.0}
    assert isotonic_series(df.limit(0), ["id"], "y", "w").count() == 0
    assert [r.fitted for r in isotonic_series(df.where("id = 2"), ["id"], "y").collect()] == [None]


def test_a_million_points(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("id", "pmod(xxhash64(id), 1000) / 100.0 + floor(id / 250) * 0.001 AS y", "1 + pmod(xxhash64(id, 1), 3) AS w")
    rows = df.toPandas()
    expected = np.array(isotonic_scope(rows.y.to_numpy(float), rows.w.to_numpy(float)))
    found = isotonic_series(df, ["id"], "y", "w").toPandas().sort_values("id").fitted.to_numpy()
    assert np.allclose(found, expected, atol=1e-7)
