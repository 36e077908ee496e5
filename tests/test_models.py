"""Adapters: fitting, prediction tables, log probabilities and counterfactuals, checked by the constraints."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import constraints as K
from attestra.operators import features as X
from attestra.operators.models import Adapter
from attestra.sources import tables as T


@pytest.fixture(scope="module")
def credit(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        income, kind = rnd.gauss(0, 1), rnd.choice(["own", "rent", "free"])
        good = income * 2 + {"own": 1.0, "rent": -1.0, "free": 0.0}[kind] + rnd.gauss(0, 0.5) > 0
        rows.append((i, f"2024-01-{1 + i % 28:02d}", None if i % 40 == 0 else income, None if i % 50 == 0 else kind, "good" if good else "bad"))
    return spark.createDataFrame(rows, "id int, at string, income double, kind string, risk string")


@pytest.mark.parametrize("estimator, params", [("logistic", {"maxIter": 30}), ("forest", {"numTrees": 10, "seed": 1}), ("boosted", {"maxIter": 5, "seed": 1})])
def test_predictions_and_log_probabilities(spark, credit, estimator, params, tmp_path):
    split = X.stratified_split(credit, "risk", "id", 0.3)
    train, test = split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")
    adapter = Adapter("risk", ["kind"], ["income"], estimator, params)
    model = adapter.fit(train)
    assert model.classes == ("bad", "good")
    # an unknown category is no error
    odd = test.limit(3).withColumns({"kind": F.lit("castle"), "id": F.col("id") + 5000})
    got = model.predict(test.unionByName(odd)).collect()
    assert all(math.isclose(sum(math.exp(x) for x in r.log_q), 1, abs_tol=1e-9) and r.y_pred == model.classes[int(np.argmax(r.log_q))] for r in got)
    assert np.mean([r.y_pred == r.risk for r in got if r.id < 5000]) > 0.85
    table = adapter.fit_predict(train, test, "id", "at")
    assert table.columns == ["id", "at", "y_true", "y_pred"] and table.count() == test.count()
    T.write_predictions(table, str(tmp_path), "risk")
    assert T.read_predictions(spark, str(tmp_path), "risk", "id", "at").count() == test.count()
    T.write_log_probabilities(model.predict(test), str(tmp_path), "risk", "id")
    assert T.read_log_probabilities(spark, str(tmp_path), "risk", "id", model.classes).count() == test.count()


def test_counterfactuals_are_monotone(spark, credit):
    model = Adapter("risk", ["kind"], ["income"], params={"maxIter": 30}).fit(credit)
    scored = model.counterfactuals(credit, "id", "good", {"richer": {"income": F.col("income") + 1}, "poorer": {"income": F.col("income") - 1}, "owner": {"kind": F.lit("own")}})
    of = lambda v: scored.where(F.col("variant") == v).drop("variant")
    known = credit.where("income IS NOT NULL").count()
    assert of("original").count() == of("owner").count() == 900 and of("richer").count() == known
    up, down = K.MonotonicityConstraint("up", "id"), K.MonotonicityConstraint("down", "id", "non_increasing")
    assert [up.check({"original": of("original"), "perturbed": of("richer")}).n_violations, down.check({"original": of("original"), "perturbed": of("poorer")}).n_violations] == [0, 0]
    assert up.check({"original": of("original"), "perturbed": of("poorer")}).n_violations > 0.95 * known
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # one pass over the rows


def test_wrong_models(credit):
    with pytest.raises(ValueError, match="estimator"):
        Adapter("risk", ["kind"], estimator="oracle")
    with pytest.raises(ValueError, match="features"):
        Adapter("risk")
    with pytest.raises(ValueError, match="classes"):
        Adapter("risk", [], ["income"], params={"maxIter": 2}).fit(credit).counterfactuals(credit, "id", "fine", {})


def test_numeric_targets(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i % 3) + 0.1 * (i % 2)) for i in range(90)], "id int, y int, x double")
    model = Adapter("y", numeric=["x"], params={"maxIter": 60}).fit(rows)
    got = model.predict(rows)
    assert got.schema["y_pred"].dataType.simpleString() == "int" and got.where("y = y_pred").count() > 80
