import math
import random

import pytest

from attestra.operators import constraints as K

NAN = math.nan


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def numbers(c, tables):
    """(checked, violations), and that the rows agree with the counts."""
    r = c.check(tables)
    assert r.violations.count() == r.n_violations
    assert c.checked(tables).where(K.VIOLATES).count() == r.n_violations
    return r.n_checked, r.n_violations


def test_referential_integrity(spark):
    drivers = frame(spark, "driverId long", (1,), (2,), (2,))
    results = frame(spark, "resultId long, driverId long", (1, 1), (2, None), (3, 4))
    t = {"drivers": drivers, "results": results}
    assert numbers(K.ReferentialIntegrity("a", "results", "driverId", "drivers", "driverId", nullable=True), t) == (2, 1)
    assert numbers(K.ReferentialIntegrity("a", "results", "driverId", "drivers", "driverId"), t) == (3, 2)
    t["drivers"] = drivers.union(frame(spark, "driverId long", (None,)))
    assert numbers(K.ReferentialIntegrity("a", "results", "driverId", "drivers", "driverId"), t) == (3, 1)
    with pytest.raises(ValueError):
        K.ReferentialIntegrity("a", "results", ["a", "b"], "drivers", "c")


def test_empty_table_has_no_rate(spark):
    t = {"r": frame(spark, "a long"), "p": frame(spark, "a long")}
    r = K.ReferentialIntegrity("a", "r", "a", "p", "a").check(t)
    assert (r.n_checked, r.n_violations) == (0, 0) and math.isnan(r.rate)
    assert K.summarize([r]).columns == K.SUMMARY


def test_cardinality(spark):
    rows = frame(spark, "raceId long, driverId long", (1, 1), (1, 2), (1, 2), (2, 1), (None, 1))
    assert numbers(K.Cardinality("a", "t", ["raceId", "driverId"], exact=1), {"t": rows}) == (4, 1)
    races = frame(spark, "raceId long", (1,), (2,), (3,))
    preds = frame(spark, "raceId long, top int", (1, 1), (1, 1), (1, 1), (2, 1), (2, 0))
    c = K.Cardinality("a", "p", "raceId", exact=3, row_filter="top = 1", universe_table="races")
    assert numbers(c, {"p": preds, "races": races}) == (3, 2)
    bounds = frame(spark, "d string, exact int, max int", ("d1", 3, None), ("d2", 3, None), ("d3", None, 6))
    t = {"b": bounds, "w": frame(spark, "d string", ("d1",), ("d2",), ("d3",), ("d4",)), "t": frame(spark, "d string", *[("d1",)] * 3, *[("d2",)] * 2, ("d3",))}
    assert numbers(K.Cardinality("a", "t", "d", universe_table="w", bounds_table="b"), t) == (3, 1)
    t["b"] = bounds.union(bounds)
    assert numbers(K.Cardinality("a", "t", "d", universe_table="w", bounds_table="b"), t) == (6, 2)
    for bad in ({}, {"exact": 1, "bounds_table": "b"}):
        with pytest.raises(ValueError):
            K.Cardinality("a", "t", "d", **bad)


def test_functional_dependency(spark):
    t = {"t": frame(spark, "id int, zip string, city string", (1, "1", "a"), (2, "1", "a"), (3, "1", "b"), (4, "2", "c"))}
    c = K.FunctionalDependency("a", "t", "zip", "city")
    assert numbers(c, t) == (4, 1) and c.violations(t).first().id == 3
    ties = {"t": frame(spark, "zip string, city string", ("1", "b"), ("1", "a"), (None, "x"), (None, None), ("3", None))}
    assert numbers(c, ties) == (5, 3)  # b, the missing city, and the group without any
    nan = {"t": frame(spark, "zip string, city double", ("1", 1.0), ("1", NAN))}
    assert numbers(c, nan) == (2, 1)


def test_aggregate_consistency(spark):
    parent = frame(spark, "d long, y int, points double", (1, 2023, 30.0), (1, 2024, 40.0), (2, 2023, 15.0), (9, 2023, 0.0), (8, 2023, None))
    child = frame(spark, "d long, y int, points double", (1, 2023, 10.0), (1, 2023, 20.0), (1, 2024, 40.0), (2, 2023, 5.0), (2, 2023, 5.0), (None, 2023, 9.0), (1, 2023, NAN))
    c = K.AggregateConsistency("a", "p", ["d", "y"], "points", "c", ["d", "y"], "points")
    assert numbers(c, {"p": parent, "c": child}) == (5, 1)
    for agg, bad in (("mean", 2), ("max", 2), ("min", 2), ("count", 3), ("size", 3), ("nunique", 3), ("median", 2), ("std", 3), ("var", 3), ("prod", 2), ("first", 2), ("last", 2)):
        c = K.AggregateConsistency("a", "p", ["d", "y"], "points", "c", ["d", "y"], "points", agg=agg)
        assert numbers(c, {"p": parent, "c": child})[0] == 5, (agg, bad)
    with pytest.raises(ValueError):
        K.AggregateConsistency("a", "p", "d", "points", "c", "d", "points", agg="mystery")


def test_temporal_order(spark):
    left = frame(spark, "k int, t int", (1, 1), (2, 5), (3, None), (4, 1))
    right = frame(spark, "k int, t int", (1, 2), (1, 1), (2, 4), (3, 1))
    assert numbers(K.TemporalOrder("a", "l", "t", "r", "t", "k", "<="), {"l": left, "r": right}) == (4, 2)
    assert numbers(K.TemporalOrder("a", "l", "t", "r", "t", "k", "<"), {"l": left, "r": right}) == (4, 3)
    with pytest.raises(ValueError):
        K.TemporalOrder("a", "l", "t", "r", "t", "k", "==")


def test_denial(spark):
    preds = frame(spark, "id int, p double", (1, 5.0), (2, 25.0), (3, NAN))
    assert numbers(K.DenialConstraint("a", "t", "NOT coalesce(p BETWEEN 1 AND 20, false)"), {"t": preds}) == (3, 2)
    assert numbers(K.DenialConstraint("a", "t", lambda df: df.p > 20), {"t": preds}) == (3, 1)
    emp = frame(spark, "id int, b string, salary int, tax int", (1, "A", 50, 8), (2, "A", 60, 7), (3, "B", 70, 9))
    c = K.DenialConstraint("a", "e", "salary_l < salary_r AND tax_l > tax_r", right="e", join_on="b", dedupe_cols=("id_l", "id_r"), columns=["id", "salary", "tax"])
    assert numbers(c, {"e": emp}) == (1, 1)
    with pytest.raises(ValueError):
        K.DenialConstraint("a", "e", "true", right="e")


def test_pair_counts_equal_the_join(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice([*xs, None])
    rows = [(pick(1, 2, 3), pick(1, 2, 3, 4), pick("a", "b")) for _ in range(60)]
    t = {"t": frame(spark, "g int, i int, v string", *rows)}
    c = K.PairDisagreement("a", "t", "g", "i", "v")
    r, joined = c.check(t), c.pairs().check(t)
    assert (r.n_checked, r.n_violations) == (joined.n_checked, joined.n_violations)


def test_monotonicity(spark):
    t = {"original": frame(spark, "id int, y_pred double", (1, 0.5), (2, 0.5), (3, NAN)), "perturbed": frame(spark, "id int, y_pred double", (1, 0.4), (2, 0.6), (3, 0.1))}
    assert numbers(K.MonotonicityConstraint("a", "id"), t) == (3, 1)
    assert numbers(K.MonotonicityConstraint("a", "id", "non_increasing"), t) == (3, 1)
    t["perturbed"] = frame(spark, "id int, y_pred double", (1, 0.5 - 1e-12))
    assert numbers(K.MonotonicityConstraint("a", "id"), t) == (1, 0)


def test_summary_and_one_pass(spark):
    t = {"t": frame(spark, "a int", (1,), (5,), (None,))}
    cs = [K.DenialConstraint("big", "t", "a > 3"), K.DenialConstraint("small", "t", "a < 2")]
    lines = []
    rows = [tuple(r) for r in K.summarize(K.run_constraints(cs, t, lines.append)).collect()]
    assert [r[:4] for r in rows] == [("big", "denial", 3, 1), ("small", "denial", 3, 1)] and len(lines) == 2
    assert [tuple(r) for r in K.one_pass(t["t"], {"big": "a > 3", "small": "a < 2"}).orderBy("name").collect()] == rows
