"""Running aggregates with carries, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import scans


def by_hand(rows):
    """(id, sum, count, least, greatest, first place of the greatest) of rows (group, time, id, value)."""
    out, state = [], {}
    for g, t, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        seen = state.setdefault(g, [])
        seen.append((v, i))
        known = [x for x in seen if x[0] is not None]
        best = max((x[0] for x in known), default=None)
        out.append((i, sum(x[0] for x in known) if known else None, len(seen), min((x[0] for x in known), default=None), best, next((p for x, p in known if x == best), None)))
    return sorted(out)


@pytest.mark.parametrize("shape", ["hot", "small", "one", "empty"])
def test_scan(spark, shape):
    rnd = random.Random(5)
    groups = {"hot": ["a"] * 8 + ["b", None], "small": [f"g{k}" for k in range(60)], "one": ["a"], "empty": []}[shape]
    # places rise with the order: ids are given in it
    times = sorted((rnd.choice(groups), rnd.randrange(50)) for _ in range(300)) if None not in groups and groups else [(rnd.choice(groups), rnd.randrange(50)) for _ in range(300 if groups else 0)]
    times.sort(key=lambda r: r[1])
    rows = [(g, t, i, None if rnd.random() < 0.1 else rnd.randrange(-9, 30)) for i, (g, t) in enumerate(times)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v = F.col("v")
        got = scans.scan(df, ["g"], ["t", "id"], s=scans.running_sum(v), n=scans.running_count(), low=scans.running_min(v), high=scans.running_max(v), at=scans.running_max_at(v, F.col("id")))
        assert got.columns == ["g", "t", "id", "v", "s", "n", "low", "high", "at"]
        found = sorted((r.id, r.s, r.n, r.low, r.high, r["at"]["place"] if r["at"]["value"] is not None else None) for r in got.collect())
        assert found == by_hand(rows)
        alone = scans.scan(df, [], ["t", "id"], s=scans.running_sum(v))  # the whole table is one group
        assert sorted((r.id, r.s) for r in alone.collect()) == [(i, s) for i, s, *_ in by_hand([("", *r[1:]) for r in rows])]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
