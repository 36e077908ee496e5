"""Visible snapshots, earlier results, orders of predictions, monotone features; and the library without its text package."""

import datetime as dt
import os
import shutil
import subprocess
import sys

from helpers import REPO
from pyspark.sql import functions as F

from attestra.plans import specs
from attestra.sources import tables as T


def test_visible_snapshot(spark, tmp_path):
    days = [dt.date(2024, 1, d) for d in range(1, 11)]
    spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, day date").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/static.parquet")
    tables = T.read_tables(spark, str(tmp_path), ["events", "static"])
    seen = T.visible(tables, {"events": "day"}, dt.date(2024, 1, 4))
    assert sorted(r.id for r in seen["events"].collect()) == [0, 1, 2, 3] and seen["static"].count() == 3
    plan = seen["events"]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(day), LessThanOrEqual(day,2024-01-04)]" in plan


def test_earlier_results(spark, tmp_path):
    assert T.read_csv(spark, f"{tmp_path}/none", "a int") is None
    df = spark.createDataFrame([(1, "x y"), (2, None)], "a int, b string")
    path = T.write_csv(df, str(tmp_path), "first run")
    assert path.endswith("first_run") and sorted(map(tuple, T.read_csv(spark, path, df.schema).collect())) == [(1, "x y"), (2, None)]


def test_orders_of_predictions(spark):
    items = spark.createDataFrame([(1, "s1", "p"), (2, "s2", "q")], "ID int, SALESDOCUMENT string, PRODUCT string")
    predictions = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.2)], "ID int, y_pred double")
    got = specs.with_order(predictions, items)
    assert got.columns == ["ID", "y_pred", "SALESDOCUMENT"] and sorted(map(tuple, got.collect())) == [(1, 0.5, "s1"), (2, 0.1, "s2"), (3, 0.2, None)]


def test_monotone_features(spark):
    rows = spark.createDataFrame([(1, 50.0, 30.0), (2, 93.0, 5.0), (3, None, None)], "_row_id int, ExternalRiskEstimate double, NetFractionRevolvingBurden double")
    for feature, moved, sign in (("ExternalRiskEstimate", {1: 60.0, 2: 94.0}, 1), ("NetFractionRevolvingBurden", {1: 10.0, 2: 0.0}, -1)):
        changed = specs.counterfactual(rows, feature)
        assert {r["_row_id"]: r[feature] for r in changed.collect()} == moved
        score = lambda df: df.select("_row_id", (F.col(feature) * sign).alias("y_pred"))  # noqa: B023, E731
        good = specs.monotone(feature).check({"original": score(rows), "perturbed": score(changed)})
        bad = specs.monotone(feature).check({"original": score(changed), "perturbed": score(rows)})
        assert (good.n_checked, good.n_violations, bad.n_violations) == (2, 0, 2)


def test_the_rest_works_without_the_text_package(tmp_path):
    """Both text folders and the pipeline away: queries and tests of the rest still pass."""
    for name in ("attestra", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    said = subprocess.run([sys.executable, "-m", "pytest", "tests/test_constraints.py", "tests/test_queries.py", "-q", "-x", "-k", "constraints or entry_has_rows or split_shares"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout[-2000:] + said.stderr[-2000:]
