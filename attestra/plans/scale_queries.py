"""Queries for forms made for large groups and long series: suites in one plan, pairs out of order, tiles."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.nulls import holds
from attestra.operators import constraints as K
from attestra.operators import decoding as D
from attestra.operators import features as X
from attestra.operators import scans as N
from attestra.operators.reducers import Reducer, reduce_by
from attestra.operators.series import isotonic_series
from attestra.operators.suite import summarize_suite
from attestra.plans.registry import query, table, tables

# A suite of ten constraints over one table ---------------------------------------

SUITE = [
    K.ReferentialIntegrity("line_has_part", "lineitem", "l_partkey", "part", "p_partkey"),
    K.ReferentialIntegrity("line_has_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey", nullable=True),
    K.Cardinality("unique_line", "lineitem", ["l_orderkey", "l_linenumber"], exact=1),
    K.Cardinality("lines_of_order", "lineitem", "l_orderkey", min=1, max=7),
    K.Cardinality("returned_lines", "lineitem", "l_orderkey", max=2, row_filter="l_returnflag = 'R'"),
    K.FunctionalDependency("part_supplier", "lineitem", "l_partkey", "l_suppkey"),
    K.FunctionalDependency("flag_status", "lineitem", ["l_orderkey", "l_returnflag"], "l_linestatus"),
    K.DenialConstraint("big_discount", "lineitem", "l_quantity > 45 AND l_discount > 0.08"),
    K.DenialConstraint("high_tax", "lineitem", "l_tax > 0.05"),
    K.PairDisagreement("one_flag", "lineitem", "l_orderkey", "l_linenumber", "l_returnflag"),
]


def _dependency(name: str, keys: str, value: str) -> str:
    inner = f"SELECT sum(n) AS a, coalesce(max(n) FILTER (v IS NOT NULL), 0) AS b FROM (SELECT {keys}, {value} AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY {keys}"
    return f"SELECT '{name}' AS name, 'functional_dependency' AS kind, CAST(sum(a) AS BIGINT) AS n_checked, CAST(sum(a - b) AS BIGINT) AS n_violations FROM ({inner})"


@query(
    "suite_of_lineitem",
    f"""WITH s AS (
       SELECT 'line_has_part' AS name, 'referential_integrity' AS kind, count(*) AS n_checked, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) AS n_violations FROM lineitem
       UNION ALL SELECT 'line_has_supplier', 'referential_integrity', count(*), count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) FROM lineitem WHERE l_suppkey IS NOT NULL
       UNION ALL SELECT 'unique_line', 'cardinality', count(*), count(*) FILTER (n <> 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
       UNION ALL SELECT 'lines_of_order', 'cardinality', count(*), count(*) FILTER (n > 7) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
       UNION ALL SELECT 'returned_lines', 'cardinality', count(*), count(*) FILTER (n > 2) FROM (SELECT count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY l_orderkey)
       UNION ALL {_dependency("part_supplier", "l_partkey", "l_suppkey")} UNION ALL {_dependency("flag_status", "l_orderkey, l_returnflag", "l_linestatus")}
       UNION ALL SELECT 'big_discount', 'denial', count(*), count(*) FILTER (l_quantity > 45 AND l_discount > 0.08) FROM lineitem
       UNION ALL SELECT 'high_tax', 'denial', count(*), count(*) FILTER (l_tax > 0.05) FROM lineitem
       UNION ALL SELECT 'one_flag', 'denial', count(*), count(*) FILTER (a.l_returnflag <> b.l_returnflag) FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
       SELECT name, kind, n_checked, n_violations, round(n_violations / n_checked, 6) AS violation_rate FROM s""",
)
def suite_of_lineitem(spark, sf_dir):
    return summarize_suite(SUITE, tables(spark, sf_dir, "lineitem", "part", "supplier")).withColumn("violation_rate", F.round("violation_rate", 6))


# Pairs within groups ---------------------------------------------------------------

_RELATIONS = (">", "<=")


@query(
    "denial_order_of_events",
    " UNION ALL ".join(
        f"""SELECT '{r}' AS relation, count(*) AS n_checked, count(*) FILTER (a.value {r} b.value) AS n_violations FROM events a JOIN events b ON a.event_type = b.event_type AND a.ts < b.ts"""
        for r in _RELATIONS
    ),
)
def denial_order_of_events(spark, sf_dir):
    """Values that fall, or don't, while time goes on: five event types hold all events."""
    events = table(spark, sf_dir, "events")
    counts = lambda r: K.OrderDenial("order", "events", "event_type", "ts", "value", r).check({"events": events}).counts.withColumn("relation", F.lit(r))
    return reduce(DataFrame.unionByName, map(counts, _RELATIONS))


@query(
    "denial_near_events_rows",
    """SELECT a.user_id, a.event_id AS event_id_l, b.event_id AS event_id_r FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
       WHERE a.event_type = b.event_type AND abs(a.value - b.value) < 0.02""",
)
def denial_near_events_rows(spark, sf_dir):
    """Pairs of a user's events of one type with nearly the same value, by tiles."""
    near = "event_type_l = event_type_r AND abs(value_l - value_r) < 0.02"
    c = K.DenialConstraint("near", "events", near, right="events", join_on="user_id", dedupe_cols=("event_id_l", "event_id_r"), columns=["event_type", "value"])
    return c.violations(tables(spark, sf_dir, "events")).select("user_id", "event_id_l", "event_id_r")


# Running aggregates, exact splits, reducers ---------------------------------------------


@query(
    "running_events",
    """SELECT event_id, event_type, sum(CAST(value AS DECIMAL(18, 2))) OVER w::DOUBLE AS total, max(value) OVER w AS most, arg_max(event_id, (value, -event_id)) OVER w AS most_at,
              sum(CAST(value AS DECIMAL(18, 2))) OVER (ORDER BY ts, event_id)::DOUBLE AS total_of_all FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def running_events(spark, sf_dir):
    """Running sums and maxima of five event types, and of the whole table as one group."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    value = F.col("value")
    exact = N.running_sum(value.cast("decimal(18,2)"))
    by_type = N.scan(events, ["event_type"], ["ts", "event_id"], total=exact, most=N.running_max(value), at=N.running_max_at(value, F.col("event_id")))
    out = N.scan(by_type, [], ["ts", "event_id"], total_of_all=exact)
    return out.select("event_id", "event_type", F.col("total").cast("double").alias("total"), "most", F.col("at.place").alias("most_at"), F.col("total_of_all").cast("double").alias("total_of_all"))


@query("split_shares", "SELECT o_orderstatus, count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_test FROM orders GROUP BY 1")
def split_shares(spark, sf_dir):
    split = X.stratified_split(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", 0.2, seed=1)
    return split.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


def _second(state, values):
    return np.unique(np.concatenate([state, values]))[-2:]


_SECOND_GREATEST = Reducer(lambda: np.zeros(0), _second, _second, lambda s: float(s[0]) if len(s) == 2 else None)


@query(
    "reducer_second_price",
    "SELECT l_suppkey, list_sort(list(DISTINCT l_extendedprice), 'DESC')[2] AS second_price FROM lineitem GROUP BY 1",
)
def reducer_second_price(spark, sf_dir):
    """The second greatest price of each supplier, by a reducer of one's own."""
    return reduce_by(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", _SECOND_GREATEST, "second_price")


# A long series ------------------------------------------------------------------------------


@query(
    "isotonic_customers",
    """WITH c AS (SELECT c_custkey, row_number() OVER o AS i, sum(1 + c_nationkey) OVER o AS w, sum((1 + c_nationkey) * c_acctbal) OVER o AS s FROM customer WINDOW o AS (ORDER BY c_custkey)),
       p AS (SELECT 0 AS i, 0 AS w, 0.0 AS s UNION ALL SELECT i, w, s FROM c),
       m AS (SELECT a.i AS j, b.i AS k, min((b.s - a.s) / (b.w - a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM p a JOIN p b ON a.i < b.i)
       SELECT c_custkey, round(max(least), 4) AS fitted FROM c JOIN m ON m.k = c.i GROUP BY 1""",
)
def isotonic_customers(spark, sf_dir):
    """Balances by customer, weighted, as one series that never falls; the SQL takes the greatest of the least means."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (1 + F.col("c_nationkey")).alias("weight"))
    return isotonic_series(customers, ["c_custkey"], "c_acctbal", "weight").select("c_custkey", F.round("fitted", 4).alias("fitted"))


# Small forms that other queries don't reach -------------------------------------------------


@query("first_line_of_order", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1")
def first_line_of_order(spark, sf_dir):
    """The line of each order that ships first."""
    lines = table(spark, sf_dir, "lineitem")
    return K.first_rows(lines, ["l_orderkey"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


_CELL = "[l_discount, l_tax, 0.05 + l_quantity / 500]"


@query(
    "restricted_cells",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, {_CELL} AS x, [l_quantity < 40, l_returnflag <> 'R', l_linestatus = 'O'] AS ok FROM lineitem),
        q AS (SELECT *, list_transform(x, lambda v: v / list_sum(x)) AS q FROM r), k AS (SELECT *, list_transform(list_zip(q, ok), lambda z: CASE WHEN z[2] THEN z[1] ELSE 0 END) AS kept FROM q)
        SELECT l_returnflag, count(*) AS n, count(*) FILTER (list_sum(kept) = 0) AS n_impossible, round(avg(ln(list_sum(kept))) FILTER (list_sum(kept) > 0), 6) AS mean_log_qc,
               round(avg(kept[3] / list_sum(kept)) FILTER (list_sum(kept) > 0), 6) AS mean_last, count(*) FILTER (list_sum(kept) BETWEEN 1e-9 AND 1 - 1e-9 AND ln(1 - list_sum(kept)) - 0.5 > ln(list_sum(kept))) AS n_incoherent
        FROM k GROUP BY 1""",
)
def restricted_cells(spark, sf_dir):
    """One cell of three values under what is admissible for it, and whether soft conditioning prefers the rest."""
    lines = table(spark, sf_dir, "lineitem").withColumn("x", F.expr("array(l_discount, l_tax, 0.05D + l_quantity / 500)"))
    lines = lines.withColumns({"q": F.expr("transform(x, v -> v / aggregate(x, 0D, (a, y) -> a + y))"), "ok": F.expr("array(l_quantity < 40, l_returnflag <> 'R', l_linestatus = 'O')")})
    log_qc, kept = D.restrict("q", "ok")
    out = lines.withColumns({"log_qc": log_qc, "kept": kept})
    mass = F.exp("log_qc")
    both = out.withColumns({"mass": mass, "inside": F.col("kept").isNotNull(), "log_out": F.when((mass >= 1e-9) & (mass <= 1 - 1e-9), F.log(1 - mass))})
    soft = holds(D.prefers_incoherent("log_qc", "log_out", -0.5))
    known = lambda c: F.round(F.avg(F.when(F.col("inside"), c)), 6)
    return both.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("n_impossible"), known(F.col("log_qc")).alias("mean_log_qc"),
        known(F.get("kept", 2)).alias("mean_last"), F.count_if(soft).alias("n_incoherent"),
    )
