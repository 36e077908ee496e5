"""A suite as one plan: the same summary as constraint by constraint, from one scan of each table."""

import random
import re

import pytest
from helpers import DATA, rows_of

from attestra.operators import constraints as K
from attestra.operators.suite import summarize_suite

TEN = [
    K.ReferentialIntegrity("line_has_part", "lineitem", "l_partkey", "part", "p_partkey"),
    K.ReferentialIntegrity("line_has_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey", nullable=True),
    K.Cardinality("unique_line", "lineitem", ["l_orderkey", "l_linenumber"], exact=1),
    K.Cardinality("lines", "lineitem", "l_orderkey", min=1, max=7),
    K.Cardinality("returned", "lineitem", "l_orderkey", max=2, row_filter="l_returnflag = 'R'"),
    K.FunctionalDependency("supplier", "lineitem", "l_partkey", "l_suppkey"),
    K.FunctionalDependency("status", "lineitem", ["l_orderkey", "l_returnflag"], "l_linestatus"),
    K.DenialConstraint("big_discount", "lineitem", "l_quantity > 45 AND l_discount > 0.08"),
    K.DenialConstraint("tax", "lineitem", lambda df: df.l_tax > 0.05),
    K.PairDisagreement("one_flag", "lineitem", "l_orderkey", "l_linenumber", "l_returnflag"),
]


def test_ten_constraints_scan_each_table_once(spark):
    tables = {n: spark.read.parquet(f"{DATA}/sf0.001/{n}.parquet") for n in ("lineitem", "part", "supplier")}
    got = summarize_suite(TEN, tables)
    plan = got._jdf.queryExecution().executedPlan().toString()  # before it runs: one version
    assert rows_of(got) == rows_of(K.summarize(K.run_constraints(TEN, tables)))
    assert [r.name for r in got.collect()] == [c.name for c in TEN]
    assert sorted(re.findall(r"FileScan parquet \[([a-z]+)_", plan)) == ["l", "p", "s"]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_other_constraints(spark, empty):
    rnd = random.Random(2)
    some = lambda *xs: rnd.choice(xs)
    child = [] if empty else [(some(1, 2, 3, None), some(1.0, float("nan"), None, 2.0), some("x", "y", None), i if rnd.random() < 0.9 else None) for i in range(200)]
    tables = {
        "child": spark.createDataFrame(child, "a int, b double, v string, i long"),
        "parent": spark.createDataFrame([] if empty else [(1, 1.0), (1, 1.0), (None, 2.0), (2, None), (9, 9.0)], "p long, q double"),
        "all": spark.createDataFrame([] if empty else [(1, None), (2, 1.0), (7, 7.0), (7, 7.0)], "a int, b double"),
        "bounds": spark.createDataFrame([(1, 5, None), (2, None, 40)], "a int, min int, max int"),
        "other": spark.createDataFrame([(1, "x")], "a int, w string"),
    }
    suite = [
        K.ReferentialIntegrity("ri", "child", ["a", "b"], "parent", ["p", "q"]),
        K.ReferentialIntegrity("ri_known", "child", ["a", "b"], "parent", ["p", "q"], nullable=True),
        K.ReferentialIntegrity("ri_back", "parent", "p", "child", "a"),
        K.Cardinality("universe", "child", ["a", "b"], min=1, universe_table="all"),
        K.Cardinality("universe_filter", "child", ["a", "b"], exact=0, universe_table="all", row_filter="v = 'x'"),
        K.Cardinality("filter", "child", "a", exact=3, row_filter="v = 'x'"),
        K.Cardinality("bounds", "child", "a", bounds_table="bounds"),
        K.FunctionalDependency("fd", "child", ["a"], "v"),
        K.FunctionalDependency("fd_number", "child", ["v", "a"], "b"),
        K.DenialConstraint("row", "child", "b > 1 OR v = 'y'"),
        K.DenialConstraint("pairs", "child", "v <> w", right="other", join_on="a"),
        K.PairDisagreement("same", "child", "a", "i", "v"),
        K.OrderDenial("order", "child", "a", "i", "b"),

    ]
    assert rows_of(summarize_suite(suite, tables)) == rows_of(K.summarize(K.run_constraints(suite, tables)))


def _shuffled_rows(spark, df):
    """The rows of df, and how many rows all its stages wrote for a shuffle."""
    java, gateway = spark._jvm.java.util, spark.sparkContext._gateway
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jsc.sc().statusStore().stageList(java.ArrayList(), False, False, gateway.new_array(spark._jvm.double, 0), java.ArrayList())
    )
    before = {s.stageId() for s in stages()}
    rows = rows_of(df())
    return rows, sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


def test_sets_with_a_common_key_are_shuffled_as_one_entry(spark):
    """Six sets of keys, all of them distinct: a row is shuffled once, and its key once more in the counts by buckets."""
    n = 20_000
    tables = {"t": spark.range(n).selectExpr("id AS a", "id + 1 AS b", "cast(id AS string) AS c", "id % 7 AS d")}
    sets = [["a"], ["a", "b"], ["a", "c"], ["a", "b", "c"], ["d", "a"], ["c", "d", "a"]]
    suite = [K.Cardinality(f"c{k}", "t", s, exact=1) for k, s in enumerate(sets)] + [K.DenialConstraint("d", "t", "d = 1")]
    rows, shuffled = _shuffled_rows(spark, lambda: summarize_suite(suite, tables))
    assert rows == rows_of(K.summarize(K.run_constraints(suite, tables)))
    assert shuffled < 3 * n


@pytest.mark.parametrize("limit", [10, 10**6])
def test_roots_of_many_rows_are_counted_before_the_shuffle(spark, monkeypatch, limit):
    """Most roots, or none, above a task's rows: the same counts, also for zeros of both signs and missing keys."""
    monkeypatch.setattr("attestra.operators.suite.TASK_ROWS", limit)
    rnd = random.Random(5)
    rows = [(None if i % 3 == 0 else i % 50, rnd.choice([0.0, -0.0, 1.0, float("nan"), None]), rnd.choice("xyz"), i // 2, rnd.choice([0.0, -0.0, 1.0, None])) for i in range(300)]
    tables = {
        "t": spark.createDataFrame(rows, "a int, b double, v string, i long, z double"),
        "p": spark.createDataFrame([(k, 0.0, k % 8) for k in range(0, 40, 2)] + [(None, -0.0, None)], "a long, b double, c long"),
    }
    suite = [
        K.ReferentialIntegrity("twice", "t", ["a", "a"], "p", ["a", "c"]),
        K.ReferentialIntegrity("pair", "t", ["a", "b"], "p", ["a", "b"]),
        K.ReferentialIntegrity("one", "t", "b", "p", "b", nullable=True),
        K.ReferentialIntegrity("itself", "t", "i", "t", "i"),
        K.Cardinality("least", "t", ["v", "a"], min=3),
        K.Cardinality("universe", "t", ["a"], min=7, universe_table="p"),
        K.FunctionalDependency("fd", "t", ["b", "a"], "v"),
        K.FunctionalDependency("fd_back", "t", ["v"], "a"),
        K.PairDisagreement("pairs", "t", "a", "i", "v"),
        K.PairDisagreement("pairs_by_number", "t", ["z", "v"], "i", "a"),
        K.DenialConstraint("row", "t", "b = 0"),
        K.DenialConstraint("row_of_parent", "p", "a > 10"),
    ]
    assert rows_of(summarize_suite(suite, tables)) == rows_of(K.summarize(K.run_constraints(suite, tables)))
