"""Queries for whole audits: summaries, the remaining forms of constraints, predictions' checks, features and decoders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import logs as L
from attestra.functions.nulls import holds
from attestra.operators import constraints as K
from attestra.operators import decode_items as I
from attestra.operators import decoding as D
from attestra.operators import features as X
from attestra.operators import metrics as M
from attestra.plans import audit, specs
from attestra.plans.registry import query, table, tables


def _named(parts: dict[str, DataFrame], column: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(column, F.lit(n)) for n, df in parts.items()])


def _union_sql(column: str, parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {column}, * FROM ({q})" for n, q in parts.items())


# Summaries and the remaining forms of constraints ---------------------------------

_SUITE = [
    K.ReferentialIntegrity("line_has_part", "lineitem", "l_partkey", "part", "p_partkey"),
    K.Cardinality("unique_line", "lineitem", ["l_orderkey", "l_linenumber"], exact=1),
    K.FunctionalDependency("brand_type", "part", "p_brand", "p_type"),
    K.DenialConstraint("big_discount", "lineitem", "l_quantity > 45 AND l_discount > 0.08"),
    K.PairDisagreement("one_flag", "lineitem", "l_orderkey", "l_linenumber", "l_returnflag"),
]


@query(
    "summary_suite",
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), s AS (
       SELECT 'line_has_part' AS name, 'referential_integrity' AS kind, count(*) AS n_checked, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) AS n_violations FROM lineitem
       UNION ALL SELECT 'unique_line', 'cardinality', count(*), count(*) FILTER (n <> 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
       UNION ALL SELECT 'brand_type', 'functional_dependency', CAST(sum(a) AS BIGINT), CAST(sum(a - b) AS BIGINT) FROM (SELECT sum(n) AS a, max(n) AS b FROM c GROUP BY p_brand)
       UNION ALL SELECT 'big_discount', 'denial', count(*), count(*) FILTER (l_quantity > 45 AND l_discount > 0.08) FROM lineitem
       UNION ALL SELECT 'one_flag', 'denial', count(*), count(*) FILTER (a.l_returnflag <> b.l_returnflag) FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
       SELECT name, kind, n_checked, n_violations, round(n_violations / n_checked, 6) AS violation_rate FROM s""",
)
def summary_suite(spark, sf_dir):
    results = K.run_constraints(_SUITE, tables(spark, sf_dir, "lineitem", "part"))
    return K.summarize(results).withColumn("violation_rate", F.round("violation_rate", 6))


_AGGS = {"mean": "avg(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "count": "count(o_totalprice)", "nunique": "count(DISTINCT o_totalprice)", "median": "median(o_totalprice)"}


@query(
    "agg_kinds",
    _union_sql(
        "aggregate",
        {
            n: f"""WITH p AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT o_custkey, {sql} AS s FROM orders GROUP BY 1)
                   SELECT count(*) AS n_checked, count(*) FILTER (abs(v - coalesce(s, 0)) > 0.005) AS n_violations FROM p LEFT JOIN a USING (o_custkey)"""
            for n, sql in _AGGS.items()
        },
    ),
)
def agg_kinds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    t = {"orders": orders, "parent": orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))}
    check = lambda n: K.AggregateConsistency(n, "parent", "o_custkey", "v", "orders", "o_custkey", "o_totalprice", agg=n, tol=0.005).check(t).counts
    return _named({n: check(n) for n in _AGGS}, "aggregate")


_RELATIONS = ("<", ">", ">=")


@query(
    "temporal_relations",
    _union_sql("relation", {r: f"SELECT count(*) AS n_checked, count(*) FILTER (NOT coalesce(o_orderdate {r} l_shipdate, false)) AS n_violations FROM orders JOIN lineitem ON l_orderkey = o_orderkey" for r in _RELATIONS}),
)
def temporal_relations(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    t["lineitem"] = t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey")
    return _named({r: K.TemporalOrder("t", "orders", "o_orderdate", "lineitem", "l_shipdate", "o_orderkey", r).check(t).counts for r in _RELATIONS}, "relation")


@query(
    "mono_part_size_down",
    "SELECT count(*) AS n_checked, count(*) FILTER (p_retailprice * (1 + (p_size - 40) / 100.0) - p_retailprice > 1e-9) AS n_violations FROM part",
)
def mono_part_size_down(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    moved = part.select("p_partkey", (F.col("p_retailprice") * (1 + (F.col("p_size") - 40) / 100.0)).alias("y_pred"))
    original = part.select("p_partkey", F.col("p_retailprice").alias("y_pred"))
    return K.MonotonicityConstraint("down", "p_partkey", "non_increasing").check({"original": original, "perturbed": moved}).counts


@query(
    "flags_of_pairs",
    """WITH v AS (SELECT DISTINCT a.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderpriority <> b.o_orderpriority)
       SELECT o_orderstatus, count(*) AS n, count(v.o_orderkey) AS n_violations, round(count(v.o_orderkey) / count(*), 6) AS violation_rate FROM orders LEFT JOIN v USING (o_orderkey) GROUP BY 1""",
)
def flags_of_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    result = K.PairDisagreement("priority", "orders", "o_custkey", "o_orderkey", "o_orderpriority").check({"orders": orders})
    flagged = M.pairwise_instance_violation_flags(result, orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return M.stratified_rate(flagged, "violates", "o_orderstatus").withColumn("violation_rate", F.round("violation_rate", 6))


@query(
    "rates_by_groups",
    """WITH f AS (SELECT l_discount > 0.05 AS f, l_returnflag, l_linestatus FROM lineitem)
       SELECT 'all' AS grouping, 'all' AS value, count(*) AS n, count(*) FILTER (f) AS n_violations, round(avg(f::INT), 6) AS violation_rate FROM f
       UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), count(*) FILTER (f), round(avg(f::INT), 6) FROM f GROUP BY 2
       UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), count(*) FILTER (f), round(avg(f::INT), 6) FROM f GROUP BY 2""",
)
def rates_by_groups(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_discount") > 0.05)
    return M.wide_rates(items, ["l_returnflag", "l_linestatus"], "flag").withColumn("violation_rate", F.round("violation_rate", 6))


@query("mcnemar_counts", "SELECT count(*) FILTER (l_discount > 0.05 AND NOT l_tax > 0.04) AS a_only, count(*) FILTER (l_tax > 0.04 AND NOT l_discount > 0.05) AS b_only FROM lineitem")
def mcnemar_counts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).alias("a"), (F.col("l_tax") > 0.04).alias("b"))
    return M.discordant(items, "a", "b")


# Predictions of races, by the events ------------------------------------------------

_DAY = "cast(date_trunc('DAY', ts) AS timestamp_ntz)"
_RACES = """s AS (SELECT DISTINCT event_id AS raceId, date_trunc('day', ts) AS held FROM events WHERE event_type = 'purchase' AND user_id % 31 = 0), d AS (SELECT DISTINCT date_trunc('day', ts) AS date FROM events),
    w AS (SELECT date, count(DISTINCT raceId) AS n FROM d LEFT JOIN s ON held > date AND held <= date + INTERVAL 2 DAY GROUP BY 1),
    b AS (SELECT date, CASE n WHEN 0 THEN 0 WHEN 1 THEN 3 END AS exact, CASE WHEN n > 1 THEN 3 END AS min, CASE WHEN n > 1 THEN 3 * n END AS max FROM w)"""


def _sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("date", F.expr(_DAY))
    sessions = events.where("event_type = 'purchase' AND user_id % 31 = 0").select(F.col("event_id").alias("raceId"), "date")
    return events, specs.top3_bounds(sessions, events.select("date"), days=2)


@query("spec_top3_bounds", f"WITH {_RACES} SELECT CAST(date AS DATE) AS date, exact, min, max FROM b")
def spec_top3_bounds(spark, sf_dir):
    _, bounds = _sessions(spark, sf_dir)
    return bounds.select(F.col("date").cast("date").alias("date"), "exact", "min", "max")


@query(
    "spec_top3_per_window",
    f"""WITH {_RACES}, p AS (SELECT date_trunc('day', ts) AS date, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 17 = 0 GROUP BY 1), c AS (SELECT date, coalesce(n, 0) AS n FROM d LEFT JOIN p USING (date))
        SELECT count(*) AS n_checked, count(*) FILTER (coalesce(n <> exact, false) OR coalesce(n < min, false) OR coalesce(n > max, false)) AS n_violations FROM c JOIN b USING (date)""",
)
def spec_top3_per_window(spark, sf_dir):
    events, bounds = _sessions(spark, sf_dir)
    predictions = events.select("date", F.expr("cast(event_type = 'click' AND user_id % 17 = 0 AS int)").alias("top3_pred"))
    return specs.top3_per_window().check({"predictions": predictions, "windows": events.select("date").distinct(), "bounds": bounds}).counts


_SHIPPED = """r AS (SELECT l_linenumber AS pos, date_trunc('day', l_shipdate) AS held, l_orderkey FROM lineitem WHERE l_orderkey % 50 = 0), d AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS date FROM orders),
    m AS (SELECT date, CAST(max(pos) AS INT) AS max_position FROM d LEFT JOIN r ON held > date AND held <= date + INTERVAL 3 DAY GROUP BY 1)"""


def _shipped(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    orders = t["orders"].withColumn("date", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    results = t["lineitem"].where("l_orderkey % 50 = 0").select(F.col("l_linenumber").alias("positionOrder"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("date"))
    return orders, specs.position_bounds(results, orders.select("date"), 3)


@query("spec_position_bounds", f"WITH {_SHIPPED} SELECT CAST(date AS DATE) AS date, max_position FROM m")
def spec_position_bounds(spark, sf_dir):
    _, bounds = _shipped(spark, sf_dir)
    return bounds.select(F.col("date").cast("date").alias("date"), F.col("max_position").cast("int").alias("max_position"))


@query(
    "spec_position_domain",
    f"""WITH {_SHIPPED}, p AS (SELECT round_even(o_totalprice / 60000, 0) AS pred, date_trunc('day', o_orderdate) AS date FROM orders)
        SELECT count(*) AS n_checked, count(*) FILTER (NOT coalesce(pred BETWEEN 1 AND max_position, false)) AS n_violations FROM p LEFT JOIN m USING (date)""",
)
def spec_position_domain(spark, sf_dir):
    orders, bounds = _shipped(spark, sf_dir)
    predictions = specs.rounded(orders.select("date", (F.col("o_totalprice") / 60000).alias("position_pred")), "position_pred")
    return specs.position_in_domain().check({"predictions": X.lookup(predictions, bounds, "date")}).counts


@query(
    "spec_no_duplicate_positions",
    "SELECT count(*) AS n_checked, count(*) FILTER (n > 1) AS n_violations FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, round_even(l_quantity / 4, 0))",
)
def spec_no_duplicate_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raceId"), (F.col("l_quantity") / 4).alias("position_pred"))
    return specs.positions_without_duplicates().check({"predictions": specs.rounded(rows, "position_pred")}).counts


@query(
    "audit_of_predictions",
    """WITH p AS (SELECT user_id, date_trunc('day', ts) AS date, value AS y_pred, abs(value - 50) AS error, event_id FROM events),
       f AS (SELECT *, NOT coalesce(y_pred BETWEEN 10 AND 80, false) AS v FROM p)
       SELECT 'in_range' AS name, count(*) AS n_checked, count(*) FILTER (v) AS n_violations, round(corr(v::INT, error), 6) AS correlation FROM f""",
)
def audit_of_predictions(spark, sf_dir):
    """A prediction-side audit: flags of the violating instances and their correlation with the error."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("date"), F.col("value").alias("y_pred"), F.lit(50.0).alias("y_true"))
    c = K.DenialConstraint("in_range", "predictions", lambda df: ~holds(F.col("y_pred").between(10, 80)))
    found = audit.audit_predictions({"in_range": (c, {"predictions": rows}, ["event_id"])}, rows, F.abs(F.col("y_pred") - F.col("y_true")))
    return found.select("name", "n_checked", "n_violations", F.round("correlation", 6).alias("correlation"))


# Predictions of orders, by the lines -------------------------------------------------



def _line_predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("SALESDOCUMENT"), F.col("l_linenumber").alias("ID"), F.expr("cast(l_suppkey % 3 AS int)").alias("PLANT_pred"),
        F.expr("cast(l_partkey % 14 AS int)").alias("ITEMINCOTERMSCLASSIFICATION_pred"),
    )


@query(
    "spec_plant_within_order",
    "SELECT count(*) AS n_checked, count(*) FILTER (a.l_suppkey % 3 <> b.l_suppkey % 3) AS n_violations FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber",
)
def spec_plant_within_order(spark, sf_dir):
    return specs.consistency_constraint("PLANT").check({"predictions": _line_predictions(spark, sf_dir)}).counts


@query(
    "spec_incoterms_of_header",
    "SELECT count(*) AS n_checked, count(*) FILTER (l_partkey % 14 <> o_custkey % 14) AS n_violations FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def spec_incoterms_of_header(spark, sf_dir):
    headers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("SALESDOCUMENT"), F.expr("cast(o_custkey % 14 AS int)").alias("HEADERINCOTERMSCLASSIFICATION_pred"))
    combined = X.lookup(_line_predictions(spark, sf_dir), headers, "SALESDOCUMENT")
    return specs.item_header_incoterms().check({"combined": combined}).counts


@query(
    "spec_cross_task_fd",
    """WITH c AS (SELECT l_partkey % 14 AS d, l_suppkey % 3 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT CAST(sum(a) AS BIGINT) AS n_checked, CAST(sum(a - b) AS BIGINT) AS n_violations FROM (SELECT sum(n) AS a, max(n) AS b FROM c GROUP BY d)""",
)
def spec_cross_task_fd(spark, sf_dir):
    return specs.cross_task_fd("terms_plant", "ITEMINCOTERMSCLASSIFICATION_pred", "PLANT_pred").check({"combined": _line_predictions(spark, sf_dir)}).counts


# Features and comparisons --------------------------------------------------------------


@query(
    "features_of_items",
    """SELECT c.c_mktsegment AS "COUNTRY", o_orderstatus AS "SALESOFFICE", count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS parties
       FROM (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_suppkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) l JOIN orders ON o_orderkey = l_orderkey
       LEFT JOIN customer c ON c.c_custkey = l.l_suppkey GROUP BY 1, 2""",
)
def features_of_items(spark, sf_dir):
    """Item features of each order's first line, with the country of the party that it goes to."""
    t = tables(spark, sf_dir, "orders", "lineitem", "customer")
    first = t["lineitem"].groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "x.l_partkey", "x.l_suppkey")
    item = first.select(F.col("l_orderkey").alias("ID"), F.col("l_orderkey").alias("SALESDOCUMENT"), F.col("l_partkey").alias("PRODUCT"), *[F.col("l_suppkey").alias(c) for c in ("SHIPTOPARTY", "SOLDTOPARTY")])
    item = item.withColumns({c: F.lit(None).cast("string") for c in specs.ITEM_FEATURES if c not in item.columns})
    header = t["orders"].select(F.col("o_orderkey").alias("SALESDOCUMENT"), F.col("o_orderstatus").alias("SALESOFFICE"))
    header = header.withColumns({c: F.lit(None).cast("string") for c in specs.HEADER_FEATURES if c not in header.columns})
    customer = t["customer"].select(F.col("c_custkey").alias("CUSTOMER"), F.col("c_custkey").alias("ADDRESSID"))
    address = t["customer"].select(F.col("c_custkey").alias("ADDRESSID"), F.col("c_mktsegment").alias("COUNTRY"), F.lit("").alias("REGION"))
    out = specs.features_for("ID", item.select("ID"), {"salesdocumentitem": item, "salesdocument": header, "customer": customer, "address": address})
    return out.groupBy("COUNTRY", "SALESOFFICE").agg(F.count("*").alias("n"), F.sum("SOLDTOPARTY").cast("long").alias("parties"))


_LAST5 = """SELECT i.event_id, h.{v} AS v, row_number() OVER (PARTITION BY i.event_id ORDER BY h.ts DESC, h.event_id DESC) AS k FROM i JOIN h ON h.{key} = i.{key} AND h.ts < i.ts"""


@query(
    "features_qualifying",
    f"""WITH h AS (SELECT *, event_id % 24 AS team FROM events WHERE event_type = 'click'), i AS (SELECT *, event_id % 24 AS team FROM events WHERE event_id % 5 = 0),
        a AS (SELECT event_id, avg(v) AS m FROM ({_LAST5.format(v="value", key="user_id")}) WHERE k <= 5 GROUP BY 1), b AS (SELECT event_id, avg(v) AS m FROM ({_LAST5.format(v="value", key="team")}) WHERE k <= 5 GROUP BY 1)
        SELECT i.event_id, round(a.m, 6) AS driver, round(b.m, 6) AS constructor, round(a.m, 6) AS result FROM i LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""",
)
def features_qualifying(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").alias("raceId"), F.col("user_id").alias("driverId"), F.expr("event_id % 24").alias("constructorId"), F.col("ts").alias("date"), F.col("value").alias("position"),
        F.col("value").alias("positionOrder"), "event_type",
    )
    history = events.where("event_type = 'click'")
    out = specs.qualifying_features(events.where("event_id % 5 = 0").select("event_id", "driverId", "constructorId", "date"), history, history)
    rounded = {"driver": "driver_quali_avg_last5", "constructor": "constructor_quali_avg_last5", "result": "driver_result_avg_last5"}
    return out.select("event_id", *[F.round(c, 6).alias(n) for n, c in rounded.items()])


@query(
    "runs_compared",
    """SELECT count(*) AS n, count(*) FILTER (l_returnflag <> l_linestatus) AS n_changed, count(*) FILTER (l_returnflag = 'N') AS a_right, count(*) FILTER (l_linestatus = 'N') AS b_right
       FROM (SELECT DISTINCT ON (l_orderkey) * FROM lineitem WHERE l_linenumber = 1 ORDER BY l_orderkey, l_returnflag, l_linestatus)""",
)
def runs_compared(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min(F.struct("l_returnflag", "l_linestatus")).alias("x"))
    run = lambda c: first.select("l_orderkey", F.lit("N").alias("y_true"), F.col(f"x.{c}").alias("y_pred"))
    return audit.compare_runs(run("l_returnflag"), run("l_linestatus"), "l_orderkey")


@query("top_types", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5")
def top_types(spark, sf_dir):
    return M.top_counts(table(spark, sf_dir, "part"), "p_type", 5)


_RANKED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1"


@query(
    "races_of_sessions",
    f"""WITH s AS ({_RANKED}) SELECT p.o_orderstatus, count(*) AS n, count(s.o_orderkey) AS n_found, CAST(sum(s.o_orderkey) AS BIGINT) AS total
        FROM orders p LEFT JOIN (SELECT * FROM s WHERE o_orderkey % 3 = 0) s ON s.o_custkey = p.o_custkey AND s.o_orderdate = p.o_orderdate GROUP BY 1""",
)
def races_of_sessions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("driverId"), F.col("o_orderdate").alias("date"), "o_orderstatus")
    sessions = orders.groupBy("driverId", "date").agg(F.min("o_orderkey").alias("raceId")).where("raceId % 3 = 0")
    out = specs.with_race_id(orders.select("driverId", "date", "o_orderstatus"), sessions, "driverId")
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("raceId").alias("n_found"), F.sum("raceId").cast("long").alias("total"))


@query(
    "errors_and_thresholds",
    """SELECT event_type, CAST(sum(CASE WHEN coalesce(event_type = 'click', false) THEN 0 ELSE 1 END) AS DOUBLE) AS errors, CAST(sum((value >= 40)::INT) AS BIGINT) AS above,
              round(avg(-ln(1 + exp(-(value - 50) / 10))), 6) AS log_p FROM events GROUP BY 1""",
)
def errors_and_thresholds(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("y_true", F.lit("click"))
    out = X.thresholded(X.flag_errors(events, "y_true", "event_type"), "value", "above", 40.0)
    log_p = F.expr(f"element_at({L.log_softmax_binary('((value - 50) / 10)')}, 2)")
    return out.groupBy("event_type").agg(F.sum("error").alias("errors"), F.sum("above").cast("long").alias("above"), F.round(F.avg(log_p), 6).alias("log_p"))


@query("aligned_totals", "SELECT count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM customer")
def aligned_totals(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    out = X.aligned(customer.select("c_custkey", "c_name"), customer.select("c_custkey", "c_nationkey"), "c_custkey")
    return out.agg(F.count("*").alias("n"), F.sum("c_nationkey").cast("long").alias("nations"))


# Decoders ---------------------------------------------------------------------------------

_G = [0, 0, 1, 1, 2, 2, 3, 3, 4, -1]
_ITEMS = """e AS (SELECT vec_id, vec_id // 3 AS order_id, ((label % 10) + 10) % 10 AS tc, embedding[1:10]::DOUBLE[] AS c, embedding[11:15]::DOUBLE[] AS p FROM embeddings WHERE len(embedding) >= 15),
    q AS (SELECT *, tc // 2 AS tp, list_transform(c, lambda z: z - ln(list_sum(list_transform(c, lambda y: exp(y))))) AS lc, list_transform(p, lambda z: z - ln(list_sum(list_transform(p, lambda y: exp(y))))) AS lp FROM e),
    g AS (SELECT unnest(""" + str(_G) + """) AS g, unnest(range(10)) AS k)"""


def items(spark, sf_dir) -> DataFrame:
    """Items by the embeddings: ten child and five parent classes by its first entries, the true ones by its label."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) >= 15")
    logits = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    out = e.select("vec_id", F.expr("vec_id div 3").alias("order_id"), F.expr("cast(pmod(label, 10) AS int)").alias("true_child"), logits(1, 10).alias("c"), logits(11, 5).alias("p"))
    out = out.withColumns({"log_child": F.expr(L.log_softmax("c")), "log_parent": F.expr(L.log_softmax("p")), "true_parent": F.expr("true_child div 2")})
    return out.drop("c", "p").withColumn("true_parent", F.col("true_parent").cast("int"))


@query(
    "ccd_item_methods",
    f"""WITH {_ITEMS},
        r AS (SELECT *, list_position(lc, list_max(lc)) - 1 AS rc, list_position(lp, list_max(lp)) - 1 AS rp FROM q),
        h AS (SELECT r.*, g AS gr FROM r JOIN g ON k = rc),
        o AS (SELECT vec_id, arg_max(k, lc[k + 1]) AS alt FROM h, g WHERE g = rp GROUP BY 1),
        m AS (SELECT vec_id, arg_max(k, lc[k + 1] + lp[g + 1]) AS mc, arg_max(g, lc[k + 1] + lp[g + 1]) AS mp, ln(sum(exp(lc[k + 1] + lp[g + 1]))) AS lq FROM h, g WHERE g >= 0 GROUP BY 1),
        a AS (SELECT h.*, alt, mc, mp, lq, gr <> rp AND gr >= 0 AND (lp[rp + 1] <= lc[rc + 1] OR alt IS NULL) AS pm, gr <> rp AS bad, -(lc[tc + 1] + lp[tp + 1]) AS nll, coalesce((SELECT g FROM g WHERE k = tc), -1) <> tp AS tv
              FROM h LEFT JOIN o USING (vec_id) JOIN m USING (vec_id)),
        z AS (SELECT *, 'raw' AS method, rc AS dc, rp AS dp, nll AS l FROM a
              UNION ALL SELECT *, 'greedy repair', CASE WHEN bad AND NOT pm AND alt IS NOT NULL THEN alt ELSE rc END, CASE WHEN pm THEN gr ELSE rp END, nll FROM a
              UNION ALL SELECT *, 'nearest repair', rc, CASE WHEN bad AND gr >= 0 THEN gr ELSE rp END, nll FROM a
              UNION ALL SELECT *, 'conditioned', mc, mp, CASE WHEN tv THEN NULL ELSE nll + lq END FROM a)
        SELECT method, count(*) FILTER (coalesce(g, -1) <> dp) AS n_violations, round(avg((dc = tc)::INT), 6) AS acc_child, round(avg((dp = tp)::INT), 6) AS acc_parent, round(avg((dc = tc AND dp = tp)::INT), 6) AS exact_match,
               round(avg((coalesce(g, -1) <> dp)::INT), 6) AS violation_rate, round(avg(CASE WHEN NOT tv THEN l END), 6) AS nll_coherent_truth
        FROM z LEFT JOIN g ON k = dc GROUP BY 1""",
)
def ccd_item_methods(spark, sf_dir):
    """Decoders of items compared, without calibration: those that fit nothing."""
    found = I.evaluate(items(spark, sf_dir), _G, calibrate=False).item_table().where("method <> 'softly conditioned'")
    return found.select("method", "n_violations", *[F.round(c, 6).alias(c) for c in ("acc_child", "acc_parent", "exact_match", "violation_rate", "nll_coherent_truth")])


@query(
    "ccd_order_child",
    f"""WITH {_ITEMS}, w AS (SELECT vec_id, order_id, g, any_value(lp[g + 1]) + ln(sum(exp(lc[k + 1]))) AS o FROM q, g WHERE g >= 0 GROUP BY 1, 2, 3),
        s AS (SELECT order_id, g, sum(o) AS s FROM w GROUP BY 1, 2), n AS (SELECT order_id, ln(sum(exp(s))) AS z FROM s GROUP BY 1),
        m AS (SELECT vec_id, k, exp(lc[k + 1] + lp[g + 1] + s - o - z) AS p FROM q JOIN g ON true JOIN w USING (vec_id, order_id, g) JOIN s USING (order_id, g) JOIN n USING (order_id))
        SELECT vec_id, CAST(arg_max(k, p) AS INT) AS child, round(max(p), 6) AS p, round(sum(p), 6) AS total FROM m GROUP BY 1""",
)
def ccd_order_child(spark, sf_dir):
    rows = items(spark, sf_dir)
    out = I.order_child_marginals(rows, I.order_agreement_fd(rows, _G), _G)
    return out.select("vec_id", F.expr(L.arg_max("child_marginal")).cast("int").alias("child"), F.round(F.array_max("child_marginal"), 6).alias("p"), F.round(F.expr("aggregate(child_marginal, 0D, (a, x) -> a + x)"), 6).alias("total"))


@query(
    "ccd_soft",
    f"""WITH {_ITEMS}, s AS (SELECT vec_id, tc, tp, any_value(lc) AS lc, any_value(lp) AS lp, ln(sum(exp(lc[k + 1] + lp[g + 1]))) AS lq FROM q, g WHERE g >= 0 GROUP BY 1, 2, 3),
        v AS (SELECT *, coalesce((SELECT g FROM g WHERE k = tc), -1) <> tp AS v, -(lc[tc + 1] + lp[tp + 1]) AS nll FROM s)
        SELECT vec_id, round(CASE WHEN v THEN NULL ELSE nll + lq END, 6) AS hard, round(nll + ln(exp(lq) + exp(-1.5) * (1 - exp(lq))) + CASE WHEN v THEN 1.5 ELSE 0 END, 6) AS soft FROM v""",
)
def ccd_soft(spark, sf_dir):
    """Losses of the true pair under hard conditioning (null where it is incoherent) and under log strength -1.5."""
    out = I.item_fd(items(spark, sf_dir), _G)
    out = out.withColumns({"nll": -(I.pick("log_child", "true_child") + I.pick("log_parent", "true_parent")), "v": F.expr(f"NOT {I.admissible('true_child', 'true_parent', _G)}")})
    hard = D.joint_nll("nll", "v", "log_qc", -float("inf"))
    return out.select("vec_id", F.when(hard < float("inf"), F.round(hard, 6)).alias("hard"), F.round(D.joint_nll("nll", "v", "log_qc", -1.5), 6).alias("soft"))


@query(
    "ccd_strengths",
    f"""WITH {_ITEMS}, s AS (SELECT vec_id, coalesce((SELECT g FROM g WHERE k = tc), -1) <> tp AS v, ln(sum(exp(lc[k + 1] + lp[g + 1]))) AS lq FROM (SELECT * FROM q), g WHERE g >= 0 GROUP BY 1, 2)
        SELECT t, round(avg(ln(exp(lq) + exp(t) * (1 - exp(lq))) - CASE WHEN v THEN t ELSE 0 END), 6) AS loss FROM s, (SELECT unnest([-4.0, -1.0, 0.0, 0.5]::DOUBLE[]) AS t) GROUP BY 1""",
)
def ccd_strengths(spark, sf_dir):
    out = I.item_fd(items(spark, sf_dir), _G).withColumn("v", F.expr(f"NOT {I.admissible('true_child', 'true_parent', _G)}"))
    tries = [-4.0, -1.0, 0.0, 0.5]
    return spark.createDataFrame([(t, round(m, 6)) for t, m in zip(tries, D.strength_objective(out, "v", "log_qc", tries))], "t double, loss double")


@query(
    "ccd_mapping",
    """WITH c AS (SELECT p_size % 10 AS child, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
       SELECT child, arg_min(p_brand, (-n, p_brand)) AS p_brand, max(n) AS n, round(max(n) / sum(n), 6) AS share FROM c GROUP BY 1""",
)
def ccd_mapping(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.expr("p_size % 10").alias("child"), "p_brand")
    return I.learn_mapping(part, "child", "p_brand").withColumn("share", F.round("share", 6))
