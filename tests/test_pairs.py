"""Pairs within groups: tiles and counts of pairs out of order, against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import constraints as K
from attestra.operators import pairs


def by_hand(rows, relation):
    """(checked, violations) over (group, order, value); missing groups match."""
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[relation]
    checked = violations = 0
    for (g, x, y), (h, u, v) in itertools.permutations(rows, 2):
        if g == h and x is not None and u is not None and x < u:
            checked += 1
            violations += y is not None and v is not None and test(y, v)
    return checked, violations


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 200):
        v, w = rng.integers(0, 12, n), rng.integers(1, 5, n)
        assert pairs.inversions(v, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])


@pytest.mark.parametrize("relation", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("shape", ["hot", "small", "ties", "empty"])
def test_order_denial(spark, relation, shape):
    rnd = random.Random(7)
    some = lambda k, none=0.1: None if rnd.random() < none else rnd.randrange(k)
    rows = {
        "hot": [("a" if rnd.random() < 0.8 else rnd.choice(["b", None]), some(40), some(30)) for _ in range(260)],
        "small": [(f"g{rnd.randrange(80)}", some(10), some(10)) for _ in range(250)],
        "ties": [("a", 1 + i % 2, i % 3) for i in range(120)] + [(None, 1, None)] * 5,
        "empty": [],
    }[shape]
    df = spark.createDataFrame(rows, "g string, x int, y int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the hot group lies in many ranges
    try:
        c = K.OrderDenial("o", "t", "g", "x", "y", relation)
        r = c.check({"t": df})
        assert (r.n_checked, r.n_violations) == by_hand(rows, relation)
        assert r.violations.count() == r.n_violations
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_denial_of_other_types(spark):
    df = spark.sql("SELECT g, cast(x AS decimal(9,2)) AS x, date_add(date'2020-01-01', cast(hash(x) % 50 AS int)) AS y, 1 AS n FROM (SELECT id % 3 AS g, id * 1.25 AS x FROM range(60))")
    rows = [(r.g, r.x, r.y) for r in df.collect()]
    r = K.OrderDenial("o", "t", ["g", "n"], "x", "y").check({"t": df})
    assert (r.n_checked, r.n_violations) == by_hand(rows, ">")


@pytest.mark.parametrize("tile", [3, 50, 10_000])
def test_tiles(spark, tile):
    rnd = random.Random(3)
    rows = [("a" if rnd.random() < 0.7 else rnd.choice(["b", None]), None if rnd.random() < 0.05 else rnd.randrange(150), rnd.randrange(9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = sorted(map(tuple, pairs.tiled_pairs(df, ["g"], "id", ("_l", "_r"), tile).select("g", "id_l", "v_l", "id_r", "v_r").collect()), key=repr)
    expected = [(g, i, v, j, w) for (g, i, v), (h, j, w) in itertools.permutations(rows, 2) if g == h and None not in (i, j) and i < j]
    assert got == sorted(expected, key=repr)


def test_no_task_above_its_tile(spark):
    """A group of 3000 rows in tiles of 500: 21 tiles, none with more than a few times its share of pairs."""
    df = spark.range(3000).selectExpr("1 AS g", "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        met = pairs.tiled_pairs(df, ["g"], "id", ("_l", "_r"), 500)
        per_task = met.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in per_task) == 3000 * 2999 // 2
    assert len(per_task) > 10 and max(r["count"] for r in per_task) < 3 * 600 * 600
