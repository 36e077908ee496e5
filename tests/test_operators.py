import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.operators import constraints as K
from attestra.operators import decode_items as I
from attestra.operators import decoding as D
from attestra.operators import features as X
from attestra.operators import metrics as M
from attestra.plans import audit, specs


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# Metrics -------------------------------------------------------------------


@pytest.mark.parametrize("n,k", [(2, 4), (7, 4), (10, 3), (50, 4), (26, 5)])
def test_buckets_are_quantiles_of_the_rank(spark, n, k):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, *range(9)])) for i in range(n)]
    got = {r.i: r.bucket for r in M.temporal_buckets(frame(spark, "i int, t int", *rows), "t", "i", k).collect()}
    known = pd.DataFrame([r for r in rows if r[1] is not None], columns=["i", "t"]).sort_values(["t", "i"])
    if len(known) > 1:
        cut = pd.qcut(pd.Series(range(1, len(known) + 1)), k, labels=False) + 1
        assert [got[i] for i in known.i] == cut.tolist()
    assert all(got[i] is None for i, t in rows if t is None)


def test_flags_rates_correlation(spark):
    rows = frame(spark, "g int, i int, v string", (1, 1, "a"), (1, 2, "b"), (2, 3, "a"), (None, 4, "a"))
    r = K.PairDisagreement("a", "t", "g", "i", "v").check({"t": rows})
    assert [x.violates for x in M.pairwise_instance_violation_flags(r, rows, "i").orderBy("i").collect()] == [True, True, False, False]
    flagged = M.instance_violation_flags(r, rows, "g")
    rates = {x.v: (x.n, x.n_violations, x.violation_rate) for x in M.stratified_rate(flagged, "violates", "v").collect()}
    assert rates == {"a": (3, 1, pytest.approx(1 / 3)), "b": (1, 1, 1.0)}
    errors = frame(spark, "f boolean, e double", (False, 0.1), (False, 0.2), (True, 5.0), (True, 6.0))
    assert M.violation_error_correlation(errors, "f", "e").first()[0] > 0.9
    assert math.isnan(M.violation_error_correlation(errors.withColumn("f", F.lit(True)), "f", "e").first()[0])


def test_paired_statistics(spark):
    rng = random.Random(1)
    rows = [(c, rng.gauss(0.3, 1)) for c in range(200) for _ in range(3)]
    ci = M.cluster_bootstrap_ci(frame(spark, "c int, d double", *rows), "d", "c", n_boot=500)
    mean = sum(d for _, d in rows) / len(rows)
    assert ci.estimate == pytest.approx(mean) and ci.low < mean < ci.high and ci.high - ci.low < 0.4
    again = M.cluster_bootstrap_ci(frame(spark, "c int, d double", *rows).repartition(3), "d", "c", n_boot=500)
    assert again.low == pytest.approx(ci.low) and again.high == pytest.approx(ci.high)
    pairs = frame(spark, "a boolean, b boolean", *[(True, False)] * 9, (False, True), (True, True))
    assert M.mcnemar(pairs, "a", "b") == M.McNemar(9, 1, pytest.approx(2 * 11 / 1024))
    assert M.binomial_two_sided(0, 0) == M.binomial_two_sided(5, 5) == 1.0


# Features -------------------------------------------------------------------


@pytest.mark.parametrize("hot,slices", [(10**9, 32), (1, 4), (1, 32)])
def test_lag_mean_against_brute_force(spark, monkeypatch, hot, slices):
    monkeypatch.setattr(X, "HOT", hot)
    monkeypatch.setattr(X, "SLICES", slices)
    rng = random.Random(2)
    history = [(rng.randrange(3), rng.randrange(12), i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(60)]
    asked = [(j, rng.choice([0, 1, 2, 9, None]), rng.choice([None, *range(13)])) for j in range(40)]
    got = X.lag_mean(frame(spark, "j int, k int, t int", *asked), frame(spark, "k int, t int, i int, v double", *history), "k", "t", "v", tiebreak="i")
    for r in got.collect():
        before = sorted([h for h in history if h[0] == r.k and r.t is not None and h[1] < r.t], key=lambda h: h[1:3])[-5:]
        values = [h[3] for h in before if h[3] is not None]
        assert r.lag_mean == (pytest.approx(sum(values) / len(values)) if values else None)
    assert got.count() == 40


def test_lookup_guards(spark):
    left, right = frame(spark, "k int", (1,), (2,), (None,)), frame(spark, "k int, v string", (1, "a"), (2, "b"))
    assert [r.v for r in X.lookup(left, right, "k").orderBy("k").collect()] == [None, "a", "b"]
    with pytest.raises(Exception, match="no row"):
        X.lookup(left, right, "k", required=True).collect()
    with pytest.raises(Exception, match="more than one"):
        X.lookup(left, right.union(right), "k").collect()


def test_windows_steps_and_rest(spark):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    dates = frame(spark, "d timestamp_ntz", (day(0),), (day(0),), (day(5),), (day(40),))
    rows = frame(spark, "at timestamp_ntz, x int", (day(0), 1), (day(1), 2), (day(7), 3), (day(8), 4), (day(12), 5))
    got = {r.d: r.n for r in X.windows_ahead(dates, "d", rows, "at", 7, F.count("x").alias("n")).collect()}
    assert got == {day(0): 2, day(5): 3, day(40): 0}
    steps = frame(spark, "y int", (1950,), (2005,), (None,)).select(X.step_function(F.col("y"), specs.SCORING_CUTOFFS).alias("c"))
    assert [r.c for r in steps.collect()] == [5, 8, None]
    with pytest.raises(Exception, match="no value"):
        frame(spark, "y int", (1900,)).select(X.step_function(F.col("y"), specs.SCORING_CUTOFFS)).collect()
    assert [r.a for r in X.known_categories(frame(spark, "a string", ("x",)), frame(spark, "a string", ("x",), ("y",)), ["a"]).orderBy("a").collect()] == [None, "x"]
    assert [r.p for r in specs.rounded(frame(spark, "p double", (2.5,), (3.5,)), "p").collect()] == [2.0, 4.0]
    assert X.perturb(frame(spark, "a int", (90,), (None,)), "a", 10, None, 94).first().a == 94


def test_specs_build(spark):
    names = [c.name for c in [*specs.racing_constraints(), *specs.sales_constraints()]]
    assert len(names) == len(set(names)) == 23 and len(specs.SECOND_TIER) == 11
    assert {c.name for c in audit.tier1_only(specs.racing_constraints(), specs.SECOND_TIER)} == set(names[:8])
    with pytest.raises(ValueError):
        specs.consistency_constraint("COLOUR")
    qualifying = frame(spark, "raceId int, date timestamp_ntz", (1, dt.datetime(2020, 1, 2)), (2, dt.datetime(2020, 1, 20)))
    dates = frame(spark, "date timestamp_ntz", *[(dt.datetime(2020, m, 1),) for m in (1, 2)], (dt.datetime(2020, 1, 10),))
    got = [tuple(r)[1:] for r in specs.top3_bounds(qualifying, dates).orderBy("date").collect()]
    assert got == [(None, 3, 6), (3, None, None), (0, None, None)]


def test_features_of_specs(spark):
    t = {
        "salesdocumentitem": frame(spark, "ID int, SALESDOCUMENT int, PLANT string, " + ", ".join(f"{c} string" for c in specs.ITEM_FEATURES), (1, 10, "P", *"abcsefg"), (2, 10, "P", *"abcxefg")),
        "salesdocument": frame(spark, "SALESDOCUMENT int, " + ", ".join(f"{c} string" for c in specs.HEADER_FEATURES), (10, *"ABCDEFGHIJK")),
        "customer": frame(spark, "CUSTOMER string, ADDRESSID int", ("s", 7)), "address": frame(spark, "ADDRESSID int, COUNTRY string, REGION string", (7, "DE", "BY")),
    }
    got = specs.features_for("ID", frame(spark, "ID int", (1,), (2,)), t, [("salesdocument", "SALESOFFICE")]).orderBy("ID").collect()
    assert [(r.ID, r.SHIPTOPARTY, r.SALESGROUP, r.COUNTRY) for r in got] == [(1, "s", "B", "DE"), (2, "x", "B", None)] and "SALESOFFICE" not in got[0]
    assert specs.features_for("SALESDOCUMENT", frame(spark, "SALESDOCUMENT int", (10,)), t).first().SALESOFFICE == "A"
    with pytest.raises(Exception, match="no row"):
        specs.features_for("ID", frame(spark, "ID int", (3,)), t).collect()
    with pytest.raises(ValueError):
        specs.features_for("X", t["customer"], t)
    day = lambda n: dt.datetime(2020, 1, n)
    quali = frame(spark, "raceId int, driverId int, constructorId int, date timestamp_ntz, position int", (1, 1, 5, day(1), 4), (2, 1, 5, day(2), 6), (3, 1, 5, day(3), 9))
    results = frame(spark, "raceId int, driverId int, date timestamp_ntz, positionOrder int", (1, 1, day(1), 3))
    r = specs.qualifying_features(frame(spark, "raceId int, driverId int, constructorId int, date timestamp_ntz", (3, 1, 5, day(3))), quali, results).first()
    assert (r.driver_quali_avg_last5, r.constructor_quali_avg_last5, r.driver_result_avg_last5) == (5.0, 5.0, 3.0)


def test_racing_audit(spark):
    day = lambda n: dt.datetime(2020, 1, n)
    t = {
        "races": frame(spark, "raceId int, year int, round int, date timestamp_ntz", (1, 2020, 1, day(2)), (2, 2020, 2, day(9))),
        "drivers": frame(spark, "driverId int", (1,)), "constructors": frame(spark, "constructorId int", (5,)),
        "results": frame(spark, "raceId int, driverId int, constructorId int, points double, positionOrder int, date timestamp_ntz", (1, 1, 5, 25.0, 1, day(2)), (2, 1, 5, 2.0, 11, day(9)), (2, 1, 6, -1.0, 12, day(9))),
        "standings": frame(spark, "raceId int, driverId int, points double", (1, 1, 25.0), (2, 1, 27.0)),
        "qualifying": frame(spark, "raceId int, date timestamp_ntz", (1, day(1)), (2, day(10))),
    }
    results = K.run_constraints(specs.racing_constraints(), specs.racing_tables(t))
    assert {r.name: (r.n_checked, r.n_violations) for r in results} == {
        "results_fk_race": (3, 0), "results_fk_driver": (3, 0), "results_fk_constructor": (3, 1), "results_unique_per_race_driver": (2, 1), "standings_unique_per_race_driver": (2, 0),
        "season_points_consistency": (1, 1), "qualifying_before_race": (2, 1), "points_non_negative": (3, 1), "fia_scoring_position_eligibility": (3, 1),
    }


def test_report(spark, tmp_path):
    _, summary = audit.run_audit([K.DenialConstraint("big", "t", "a > 3")], {"t": frame(spark, "a int", (1,), (5,))}, str(tmp_path))
    text = audit.findings("Audit", {"Database": summary, "Earlier": None})
    assert "| big | denial | 2 | 1 | 50.0000% |" in text and "not run" in text
    assert list((tmp_path / "violation_rates").glob("*.csv"))


# Decoding -------------------------------------------------------------------


def _agree(got, expected, chosen_p=None):
    lq, marginals, chosen = expected
    assert got["log_qc"] == pytest.approx(lq) if lq > -math.inf else got["log_qc"] == -math.inf
    if chosen is not None:
        for a, b in zip(got["marginals"], marginals):
            assert list(a) == pytest.approx(list(b), abs=1e-9)
        assert chosen_p(got["map"]) == pytest.approx(chosen_p(chosen))
    else:
        assert got["map"] is None


def _simplex(rng, n, zeros=True):
    q = rng.dirichlet(np.ones(n))
    if zeros and rng.random() < 0.4:
        q[rng.integers(n)] = 0
        q /= q.sum() or 1
    return q.tolist()


def test_two_cell_forms_against_enumeration(spark):
    rng = np.random.default_rng(3)
    allowed = (rng.random((4, 3)) < 0.5).tolist()
    rows = [(k, _simplex(rng, 4), _simplex(rng, 3)) for k in range(25)]
    for r in D.relation(frame(spark, "k int, a array<double>, b array<double>", *rows), "a", "b", allowed).collect():
        p = lambda v: r.a[v[0]] * r.b[v[1]]  # noqa: B023, E731
        _agree(r.asDict(), D.brute_force([r.a, r.b], lambda v: allowed[v[0]][v[1]]), p)
    rows = [(k, _simplex(rng, 6), _simplex(rng, 6)) for k in range(25)]
    for r in D.not_after(frame(spark, "k int, a array<double>, b array<double>", *rows), "a", "b").collect():
        p = lambda v: r.a[v[0]] * r.b[v[1]]  # noqa: B023, E731
        _agree(r.asDict(), D.brute_force([r.a, r.b], lambda v: v[0] <= v[1]), p)


def test_dynamic_programmes_against_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(60):
        p = rng.random(6)
        p[rng.random(6) < 0.2] = rng.choice([0.0, 1.0])
        lo, hi = sorted(rng.integers(0, 7, 2))
        qs = [[1 - x, x] for x in p]
        got = dict(zip(("log_qc", "marginals", "map"), D.cardinality_scope(p, lo, hi)))
        _agree(got, D.brute_force(qs, lambda v: lo <= sum(v) <= hi), lambda v: math.prod(q[k] for q, k in zip(qs, v)))  # noqa: B023
        values, qs = [[0, 1, 2], [0, 2, 5], [1, 3]], [_simplex(rng, n) for n in (3, 3, 2)]
        total = int(rng.integers(3, 7))
        got = dict(zip(("log_qc", "marginals", "map"), D.aggregate_sum_scope(qs, values, total)))
        _agree(got, D.brute_force(qs, lambda v: sum(x[k] for x, k in zip(values, v)) == total), lambda v: math.prod(q[k] for q, k in zip(qs, v)))  # noqa: B023


def test_scopes_as_rows(spark):
    df = frame(spark, "p array<double>, lo int, hi int", ([0.5, 0.5], 1, 1), ([0.0, 0.0], 1, 2))
    a, b = D.cardinality(df, "p", "lo", "hi").collect()
    assert a.log_qc == pytest.approx(math.log(0.5)) and b.log_qc == -math.inf and b.map is None
    s = frame(spark, "q array<array<double>>, v array<array<int>>, t int", ([[0.5, 0.5], [0.25, 0.75]], [[0, 1], [0, 1]], 2))
    assert D.aggregate_sum(s, "q", "v", "t").first().map == [1, 1]
    y = frame(spark, "y array<double>, w array<double>", ([1.0, 3.0, 2.0], [1.0, 1.0, 1.0]))
    assert D.isotonic(y, "y", "w").first().fitted == [1.0, 2.5, 2.5]


def test_orders_against_enumeration(spark):
    rng = np.random.default_rng(6)
    g = [0, 1, 1, -1]
    log = lambda q: [math.log(x) if x else -math.inf for x in q]
    rows = [(k // 2, k, log(_simplex(rng, 4)), log(_simplex(rng, 2))) for k in range(16)]
    items = frame(spark, "order_id int, i int, log_child array<double>, log_parent array<double>", *rows)
    for r in I.item_fd(items, g).collect():
        qs = [np.exp(r.log_child).tolist(), np.exp(r.log_parent).tolist()]
        lq, _, chosen = D.brute_force(qs, lambda v: g[v[0]] == v[1])
        assert r.log_qc == pytest.approx(lq)
        other = max(qs[0][a] * qs[1][b] for a in range(4) for b in range(2) if g[a] != b)
        assert math.exp(r.log_q_incoherent) == pytest.approx(other)
        assert qs[0][r.incoherent_child] * qs[1][r.incoherent_parent] == pytest.approx(other)
        if chosen:
            assert r.log_q_map == pytest.approx(math.log(qs[0][chosen[0]] * qs[1][chosen[1]]))
    for r in I.order_agreement_fd(items, g).collect():
        own = [x for x in rows if x[0] == r.order_id]
        qs = [np.exp(x[3]).tolist() for x in own] + [np.exp(x[2]).tolist() for x in own]
        lq, _, chosen = D.brute_force(qs, lambda v: v[0] == v[1] and g[v[2]] == v[0] and g[v[3]] == v[0])
        assert r.order_log_qc == pytest.approx(lq) if lq > -math.inf else r.order_log_qc == -math.inf


def test_strength_and_temperature(spark):
    rng = np.random.default_rng(7)
    lq = np.log(rng.random(3000) * 0.98 + 0.01)
    true = 0.2
    q = np.exp(lq)
    violated = rng.random(3000) < true * (1 - q) / (q + true * (1 - q))
    df = frame(spark, "v boolean, l double", *zip(violated.tolist(), lq.tolist()))
    fitted = D.fit_log_strength(df, "v", "l")
    assert abs(math.exp(fitted) - true) < 0.05
    losses = D.strength_objective(df, "v", "l", [fitted - 0.3, fitted, fitted + 0.3])
    assert losses[1] < min(losses[0], losses[2])
    assert D.fit_log_strength(df.where("NOT v"), "v", "l") == -math.inf
    z = rng.normal(0, 2, (3000, 5))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    labels = [int(rng.choice(5, p=x)) for x in p]
    sharp = z * 3 - np.log(np.exp(z * 3).sum(1, keepdims=True))
    t = D.fit_temperature(frame(spark, "q array<double>, y int", *zip(sharp.tolist(), labels), ([0.0, -1.0, -1.0, -1.0, -1.0], -1)), "q", "y")
    assert t == pytest.approx(3, rel=0.1)


def test_stream_checks(spark, tmp_path):
    from attestra.streaming.checks import violating_rows

    frame(spark, "a int", (1,), (5,), (None,)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int").parquet(str(tmp_path / "in"))
    q = violating_rows(stream, {"big": "a > 3", "odd": "a % 2 = 1"}).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.a, r.violated) for r in spark.table("found").collect()) == [(1, "odd"), (5, "big"), (5, "odd")]


def test_pair_disagreement_by_group(spark):
    """Groups' counts against all pairs, with repeated ids, missing ids and values, and a hot group."""
    rng = random.Random(17)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(12), None]), rng.choice(["a", "b", None])) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, i int, v string")
    expected = {}
    for (g, i, v), (h, j, w) in ((a, b) for a in rows for b in rows):
        if g == h and i is not None and j is not None and i < j:
            n, bad = expected.get(g, (0, 0))
            expected[g] = n + 1, bad + (v is None or w is None or v != w)
    found = {r.g: (r.n_checked, r.n_violations) for r in K.PairDisagreement("p", "t", "g", "i", "v").group_counts({"t": df}).collect()}
    assert {g: c for g, c in found.items() if c[0]} == expected


def test_pair_disagreement_takes_tasks_by_its_rows(spark, monkeypatch):
    """More rows, more tasks: none holds a fixed share of a table's groups."""
    from attestra.functions import hot

    monkeypatch.setattr(hot, "TASK_ROWS", 10)
    df = spark.range(200).selectExpr("id % 50 AS g", "id AS i", "id % 3 AS v")
    found = K.PairDisagreement("p", "t", "g", "i", "v").group_counts({"t": df})
    assert found.rdd.getNumPartitions() >= 20
    assert {(r.n_checked, r.n_violations) for r in found.collect()} == {(6, 5)}


def test_child_marginals_of_an_order(spark):
    """Against enumeration over all joint values of two items that share a parent."""
    rng, g = np.random.default_rng(11), [0, 1, 1, -1]
    q = lambda n: rng.dirichlet(np.ones(n))
    children, parents = [q(4), q(4)], [q(2), q(2)]
    log = lambda x: [float(y) for y in np.log(x)]
    items = spark.createDataFrame([(1, k, log(children[k]), log(parents[k])) for k in range(2)], "order_id int, item int, log_child array<double>, log_parent array<double>")
    mass, marginals = 0.0, np.zeros((2, 4))
    for a in range(4):
        for b in range(4):
            if g[a] == g[b] >= 0:
                p = children[0][a] * children[1][b] * parents[0][g[a]] * parents[1][g[b]]
                mass += p
                marginals[0][a] += p
                marginals[1][b] += p
    out = I.order_child_marginals(items, I.order_agreement_fd(items, g), g)
    for r in out.collect():
        assert r.child_marginal == pytest.approx(list(marginals[r.item] / mass))


def test_reports_runs_and_failed_tasks(spark):
    good = spark.createDataFrame([(1, "a", "a"), (2, "b", "a"), (None, "c", "c")], "k int, y_true string, y_pred string")
    other = spark.createDataFrame([(2, "b", "b"), (3, "b", "b"), (None, "c", None)], "k int, y_true string, y_pred string")
    assert tuple(audit.compare_runs(good, other, "k").first()) == (2, 2, 1, 1)
    done, failed = audit.run_tasks({"good": lambda: good, "bad": lambda: good.select("nothing")})
    assert set(done) == {"good"} and "nothing" in failed["bad"]
    summary = spark.createDataFrame([("x", "denial", 4, 1, 0.25), ("y", "denial", 2, 0, 0.0)], "name string, kind string, n_checked int, n_violations int, violation_rate double")
    text = audit.tier_report("Audit", summary, ["y"], {"data": "a table"}, ["small"])
    assert text.index("| x ") < text.index("## Conventions") < text.index("| y ") and "- data: a table" in text and "- small" in text


def test_evaluation_reports_and_significance(spark):
    """Decoders on items with a known answer: conditioning mends what the parent alone gets wrong."""
    rng, g = np.random.default_rng(5), [0, 0, 1, 1]
    rows = []
    for k in range(80):
        child = int(rng.integers(4))
        lc, lp = np.full(4, 0.1), np.array([0.45, 0.45])
        lc[child] = 0.7
        lp[g[child]] += 0.1 if k % 3 else -0.1
        rows.append((k // 2, [float(x) for x in np.log(lc)], [float(x) for x in np.log(lp / lp.sum())], child, g[child]))
    items = spark.createDataFrame(rows, "order_id int, log_child array<double>, log_parent array<double>, true_child int, true_parent int")
    found = I.evaluate(items, g, calibrate=True)
    table = {r.method: r for r in found.item_table().collect()}
    wrong = sum(k % 3 == 0 for k in range(80))
    assert table["raw"].n_violations == wrong and table["conditioned"].n_violations == 0
    assert table["raw"].exact_match == pytest.approx(1 - wrong / 80) and table["conditioned"].exact_match == 1
    assert all(f["t_child"] > 0 and f["log_delta_item"] == -math.inf for f in found.folds)
    tests = found.significance(n_boot=200)
    first = next(t for t in tests if t["comparison"] == "conditioned vs raw")
    assert (first["a_only"], first["b_only"]) == (wrong, 0) and first["ci_low"] <= first["difference"] == pytest.approx(wrong / 80)
    report = audit.decoding_report(found, tests)
    assert set(report) == {"items.csv", "orders.csv", "report.json", "report.md"} and report["items.csv"].startswith("method,") and "conditioned vs raw" in report["report.md"]


def test_losses_strengths_and_mappings(spark):
    """Closed forms against their definitions: joint loss, soft marginals, the strength's fit, mappings and class indices."""
    df = spark.createDataFrame([(2.0, False, math.log(0.4)), (3.0, True, math.log(0.4)), (2.5, False, math.log(0.9))], "nll double, v boolean, log_qc double")
    soft = [r[0] for r in df.select(D.joint_nll("nll", "v", "log_qc", math.log(0.5))).collect()]
    assert soft == pytest.approx([2 + math.log(0.4 + 0.5 * 0.6), 3 + math.log(0.7) - math.log(0.5), 2.5 + math.log(0.95)])
    assert [r[0] for r in df.select(D.joint_nll("nll", "v", "log_qc", -math.inf)).collect()] == pytest.approx([2 + math.log(0.4), math.inf, 2.5 + math.log(0.9)])
    t = D.fit_log_strength(df, "v", "log_qc")
    share = lambda t: sum(math.exp(t) * (1 - q) / (q + math.exp(t) * (1 - q)) for q in (0.4, 0.4, 0.9)) / 3
    assert share(t) == pytest.approx(1 / 3, abs=1e-6)
    best = D.strength_objective(df, "v", "log_qc", [t - 0.1, t, t + 0.1])
    assert best[1] == min(best)
    one = spark.createDataFrame([([0.2, 0.8], [0.0, 1.0], 0.8)], "raw array<double>, hard array<double>, qc double")
    assert one.select(D.soft_marginal("raw", "hard", "qc", "0.5D")).first()[0] == pytest.approx([0.1 / 0.9, 0.8 / 0.9])
    pairs = spark.createDataFrame([("s", "p"), ("s", "p"), ("s", "q"), ("t", "q"), (None, "q")], "c string, p string")
    learned = {r.c: (r.p, r.n, r.share) for r in I.learn_mapping(pairs, "c", "p").collect()}
    assert learned == {"s": ("p", 2, pytest.approx(2 / 3)), "t": ("q", 1, 1.0)}
    assert I.child_to_parent(pairs.groupBy("c").agg(F.min("p").alias("p")), "c", "p", ["t", "s", "u"], ["p", "q"]) == [1, 0, -1]
    assert [r.k for r in I.class_index(pairs, "p", ["q", "p"], "k").collect()] == [1, 1, 0, 0, 0]
    cells = spark.createDataFrame([([math.log(0.7), math.log(0.3)], [math.log(0.4), math.log(0.6)])], "log_child array<double>, log_parent array<double>")
    fixed = I.greedy_repair(cells.selectExpr("*", "0 AS c", "1 AS p"), [0, 1], "c", "p").first()
    assert (fixed.greedy_child, fixed.greedy_parent) == (0, 0)  # the parent is less sure
    near = I.hamming_repair(cells.selectExpr("*", "1 AS c", "0 AS p"), [0, 1], "c", "p").first()
    assert (near.hamming_child, near.hamming_parent) == (1, 1)


def test_scratch_removes_what_it_stored(spark):
    from pathlib import Path

    from attestra.sources.shared import scratch, shared_dir, store

    with scratch():
        kept = store(spark.range(5), "numbers")
        assert kept.count() == 5
        path = kept._stored_at.removeprefix("file:")
        assert path.startswith(shared_dir(spark).removeprefix("file:")) and Path(path).exists()
    assert not Path(path).exists()


def test_splits_log_probabilities_samples(spark, tmp_path):
    from attestra.sources import tables as T

    rows = frame(spark, "ID long, log_q array<double>", (1, [-0.5, -1.0]), (2, [-2.0, -0.1]))
    T.write_log_probabilities(rows, str(tmp_path), "plant", "ID")
    back = T.read_log_probabilities(spark, str(tmp_path), "plant", "ID", ["a", "b"])
    assert {r.ID: r.log_q for r in back.collect()} == {1: pytest.approx([-0.5, -1.0]), 2: pytest.approx([-2.0, -0.1])}
    with pytest.raises(Exception, match="3 classes"):
        T.read_log_probabilities(spark, str(tmp_path), "plant", "ID", ["a", "b", "c"]).collect()
    rows.write.parquet(f"{tmp_path}/bad_log_proba.parquet")
    with pytest.raises(ValueError, match="log_proba"):
        T.read_log_probabilities(spark, str(tmp_path), "bad", "ID", ["a", "b"])
    rows.write.parquet(f"{tmp_path}/task/test.parquet")
    assert T.read_split(spark, str(tmp_path), "task", "test").count() == 2
    credit = frame(spark, "age int, score double, risk string", (30, -9.0, "Good"), (-7, 0.0, "Bad"), (1, 2.0, None))
    assert sorted(map(tuple, T.read_labelled(credit, "risk", "Good").collect()), key=repr) == sorted([(30, None, 1), (None, 0.0, 0), (1, 2.0, None)], key=repr)
    many = spark.range(200)
    taken = {r.id for r in X.sample_rows(many, 20, "id", 3).collect()}
    assert len(taken) == 20 and taken == {r.id for r in X.sample_rows(many.repartition(7), 20, "id", 3).collect()} != {r.id for r in X.sample_rows(many, 20, "id", 4).collect()}
    twice = frame(spark, "k int, v int", (1, 1), (1, 2))
    with pytest.raises(Exception, match="more than one row"):
        X.aligned(twice, frame(spark, "k int, w int", (1, 5)), "k").collect()
    assert audit.write_failed({}, spark, str(tmp_path)) is None and audit.write_failed({"t": "wrong"}, spark, str(tmp_path)).endswith("failed_tasks")
