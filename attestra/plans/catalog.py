"""Registered queries over the shared tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import logs as L
from attestra.functions.nulls import holds
from attestra.operators import constraints as K
from attestra.operators import decode_items as I
from attestra.operators import decoding as D
from attestra.operators import features as X
from attestra.operators import metrics as M
from attestra.plans import audit_queries, scale_queries  # noqa: F401  register their own
from attestra.plans.registry import ORACLES, QUERIES, constraint, query, table, tables  # noqa: F401

# Referential integrity --------------------------------------------------------

for _name, _child, _fk, _parent, _pk in (
    ("ri_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("ri_lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("ri_lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("ri_orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("ri_documents_labels", "documents", "doc_id", "labels", "doc_id"),
    ("ri_labels_documents", "labels", "doc_id", "documents", "doc_id"),
):
    constraint(
        K.ReferentialIntegrity(_name, _child, _fk, _parent, _pk), (_child, _parent),
        f"SELECT count(*) AS n_checked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {_parent} p WHERE p.{_pk} = c.{_fk})) AS n_violations FROM {_child} c",
    )


@query("ri_documents_without_label", "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ri_documents_without_label(spark, sf_dir):
    c = K.ReferentialIntegrity("labels", "documents", "doc_id", "labels", "doc_id")
    return c.violations(tables(spark, sf_dir, "documents", "labels")).select("doc_id", "lang", "source")


# Cardinality ---------------------------------------------------------------------


@query(
    "card_order_has_item",
    """SELECT o_orderkey, coalesce(n, 0) AS count FROM (SELECT DISTINCT o_orderkey FROM orders)
       LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
       WHERE coalesce(n, 0) < 1""",
)
def card_order_has_item(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    items = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"))
    return K.Cardinality("card_order_has_item", "items", "o_orderkey", min=1, universe_table="orders").violations({"items": items, "orders": t["orders"]})


for _name, _keys in (("card_unique_line", ["l_orderkey", "l_linenumber"]), ("card_unique_order_part", ["l_orderkey", "l_partkey"])):
    constraint(
        K.Cardinality(_name, "lineitem", _keys, exact=1), ("lineitem",),
        f"SELECT count(*) AS n_checked, count(*) FILTER (n <> 1) AS n_violations FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(_keys)})",
    )


@query(
    "card_returned_range",
    """SELECT count(*) AS n_checked, count(*) FILTER (coalesce(n, 0) < 1 OR coalesce(n, 0) > 3) AS n_violations FROM (SELECT DISTINCT o_orderkey FROM orders)
       LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def card_returned_range(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    items = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    c = K.Cardinality("card_returned_range", "items", "o_orderkey", min=1, max=3, row_filter="l_returnflag = 'R'", universe_table="orders")
    return c.check({"items": items, "orders": t["orders"]}).counts


def _purchases(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_id")


_WEEK = """p AS (SELECT date_trunc('day', ts) AS day, event_id FROM events WHERE event_type = 'purchase'),
    d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events),
    w AS (SELECT d.day, count(p.event_id) AS n FROM d LEFT JOIN p ON p.day > d.day AND p.day <= d.day + INTERVAL 7 DAY GROUP BY 1)"""


@query("window_events_7d", f"WITH {_WEEK} SELECT CAST(day AS DATE) AS day, n FROM w")
def window_events_7d(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return _week(days, _purchases(spark, sf_dir)).select(F.col("day").cast("date").alias("day"), "n")


def _week(days, purchases):
    """Purchases in the seven days after each; counted by day first, so days meet days."""
    by_day = purchases.groupBy(F.col("day").alias("at")).agg(F.count("event_id").alias("n"))
    return X.windows_ahead(days, "day", by_day, "at", 7, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(
    "card_purchases_bounds",
    f"""WITH {_WEEK}, b AS (SELECT day, CASE WHEN n = 0 THEN 0 END AS exact, CASE WHEN n > 0 THEN n // 7 END AS lo, CASE WHEN n > 0 THEN n // 6 END AS hi FROM w),
        c AS (SELECT d.day, count(p.event_id) AS n FROM d LEFT JOIN p USING (day) GROUP BY 1)
        SELECT count(*) AS n_checked, count(*) FILTER (coalesce(n <> exact, false) OR coalesce(n < lo, false) OR coalesce(n > hi, false)) AS n_violations FROM c JOIN b USING (day)""",
)
def card_purchases_bounds(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    rows = _purchases(spark, sf_dir)
    w = _week(days, rows)
    bounds = w.select("day", F.expr("CASE WHEN n = 0 THEN 0 END").alias("exact"), F.expr("CASE WHEN n > 0 THEN n div 7 END").alias("min"), F.expr("CASE WHEN n > 0 THEN n div 6 END").alias("max"))
    c = K.Cardinality("purchases", "rows", "day", universe_table="days", bounds_table="bounds")
    return c.check({"rows": rows, "days": days, "bounds": bounds}).counts


# Functional dependency -------------------------------------------------------------

for _name, _table, _det, _dep in (
    ("fd_brand_type", "part", "p_brand", "p_type"), ("fd_source_lang", "documents", "source", "lang"),
    ("fd_nation_segment", "customer", "c_nationkey", "c_mktsegment"), ("fd_nation_region", "nation", "n_nationkey", "n_regionkey"),
):
    constraint(
        K.FunctionalDependency(_name, _table, _det, _dep), (_table,),
        f"""WITH c AS (SELECT {_det} AS d, {_dep} AS v, count(*) AS n FROM {_table} GROUP BY 1, 2)
            SELECT CAST(sum(a) AS BIGINT) AS n_checked, CAST(sum(a - b) AS BIGINT) AS n_violations FROM (SELECT sum(n) AS a, coalesce(max(n) FILTER (v IS NOT NULL), 0) AS b FROM c GROUP BY d)""",
    )


@query(
    "fd_nation_segment_rows",
    """WITH m AS (SELECT c_nationkey, c_mktsegment AS best FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r
       FROM customer GROUP BY 1, 2) WHERE r = 1) SELECT c_custkey, c_nationkey, c_mktsegment FROM customer JOIN m USING (c_nationkey) WHERE c_mktsegment <> best""",
)
def fd_nation_segment_rows(spark, sf_dir):
    c = K.FunctionalDependency("fd", "customer", "c_nationkey", "c_mktsegment")
    return c.violations(tables(spark, sf_dir, "customer")).select("c_custkey", "c_nationkey", "c_mktsegment")


# Aggregates, times, denials, monotonicity --------------------------------------------


@query(
    "agg_customer_total",
    """WITH p AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)
       SELECT count(*) AS n_checked, count(*) FILTER (abs(v - coalesce(s, 0)) > 0.01) AS n_violations FROM p LEFT JOIN a USING (o_custkey)""",
)
def agg_customer_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parent = orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = K.AggregateConsistency("totals", "parent", "custkey", "total", "orders", "o_custkey", "o_totalprice", tol=0.01)
    return c.check({"parent": parent, "orders": orders}).counts


@query(
    "temporal_order_before_ship",
    "SELECT count(*) AS n_checked, count(*) FILTER (NOT coalesce(o_orderdate <= l_shipdate, false)) AS n_violations FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def temporal_order_before_ship(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    t["lineitem"] = t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey")
    return K.TemporalOrder("ship", "orders", "o_orderdate", "lineitem", "l_shipdate", "o_orderkey").check(t).counts


constraint(
    K.DenialConstraint("denial_big_discount", "lineitem", "l_quantity > 45 AND l_discount > 0.08"), ("lineitem",),
    "SELECT count(*) AS n_checked, count(*) FILTER (l_quantity > 45 AND l_discount > 0.08) AS n_violations FROM lineitem",
)


@query(
    "denial_status_conflict",
    "SELECT count(*) AS n_checked, count(*) FILTER (o_orderstatus = 'F' AND l_linestatus = 'O') AS n_violations FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def denial_status_conflict(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    t["lineitem"] = t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey")
    c = K.DenialConstraint("status", "orders", "o_orderstatus = 'F' AND l_linestatus = 'O'", right="lineitem", join_on="o_orderkey", columns=["o_orderstatus", "l_linestatus"])
    return c.check(t).counts


_PAIRS = "lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber"
_DISAGREE = K.PairDisagreement("denial_pairs_returnflag", "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
constraint(_DISAGREE, ("lineitem",), f"SELECT count(*) AS n_checked, count(*) FILTER (a.l_returnflag <> b.l_returnflag) AS n_violations FROM {_PAIRS}")


@query("denial_pairs_returnflag_joined", ORACLES["denial_pairs_returnflag"])
def denial_pairs_returnflag_joined(spark, sf_dir):
    return _DISAGREE.pairs().check(tables(spark, sf_dir, "lineitem")).counts


@query(
    "mono_part_price",
    "SELECT count(*) AS n_checked, count(*) FILTER ((p_retailprice + (p_size - 25) * 0.5) - p_retailprice < -1e-9) AS n_violations FROM part",
)
def mono_part_price(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    original = part.select("p_partkey", F.col("p_retailprice").alias("y_pred"))
    perturbed = part.select("p_partkey", (F.col("p_retailprice") + (F.col("p_size") - 25) * 0.5).alias("y_pred"))
    return K.MonotonicityConstraint("mono", "p_partkey").check({"original": original, "perturbed": perturbed}).counts


@query(
    "audit_summary",
    """WITH s AS (SELECT 'quantity' AS name, count(*) AS n_checked, count(*) FILTER (l_quantity > 45) AS n_violations FROM lineitem
       UNION ALL SELECT 'discount', count(*), count(*) FILTER (l_discount > 0.08) FROM lineitem UNION ALL SELECT 'flag', count(*), count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem)
       SELECT name, 'denial' AS kind, n_checked, n_violations, round(n_violations / n_checked, 6) AS violation_rate FROM s""",
)
def audit_summary(spark, sf_dir):
    checks = {"quantity": "l_quantity > 45", "discount": "l_discount > 0.08", "flag": ~holds(F.col("l_returnflag").isin("A", "N"))}
    return K.one_pass(table(spark, sf_dir, "lineitem"), checks).withColumn("violation_rate", F.round("violation_rate", 6))


# Metrics and features ----------------------------------------------------------------

_BUCKETS = """b AS (SELECT *, 1 + CAST(r > 1 + 0.25 * (n - 1) AS INT) + CAST(r > 1 + 0.5 * (n - 1) AS INT) + CAST(r > 1 + 0.75 * (n - 1) AS INT) AS bucket
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders))"""


@query("bucket_orders", f"WITH {_BUCKETS} SELECT bucket, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM b GROUP BY 1")
def bucket_orders(spark, sf_dir):
    out = M.temporal_buckets(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return out.groupBy("bucket").agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query(
    "flags_strata_orders",
    f"""WITH {_BUCKETS},
        v AS (SELECT DISTINCT a.l_orderkey FROM {_PAIRS} WHERE a.l_returnflag <> b.l_returnflag)
        SELECT bucket, count(*) AS n, count(v.l_orderkey) AS n_violations, round(count(v.l_orderkey) / count(*), 6) AS violation_rate FROM b LEFT JOIN v ON l_orderkey = o_orderkey GROUP BY 1""",
)
def flags_strata_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    groups = _DISAGREE.group_counts(tables(spark, sf_dir, "lineitem"))
    violating = groups.where("n_violations > 0").select(F.col("l_orderkey").alias("o_orderkey"))
    result = K.ViolationResult(_DISAGREE.name, _DISAGREE.kind, violating, groups.agg(F.sum("n_checked").alias("n_checked"), F.sum("n_violations").alias("n_violations")))
    flagged = M.instance_violation_flags(result, M.temporal_buckets(orders, "o_orderdate", "o_orderkey"), "o_orderkey")
    return M.stratified_rate(flagged, "violates", "bucket").withColumn("violation_rate", F.round("violation_rate", 6))


@query(
    "corr_discount_price",
    "SELECT round(corr(CAST(l_discount > 0.05 AS INT), l_extendedprice), 6) AS correlation FROM lineitem",
)
def corr_discount_price(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).alias("flag"), "l_extendedprice")
    return M.violation_error_correlation(items, "flag", "l_extendedprice").withColumn("correlation", F.round("correlation", 6))


@query(
    "asof_events_lag5",
    """WITH h AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
       r AS (SELECT i.event_id, h.value, row_number() OVER (PARTITION BY i.event_id ORDER BY h.ts DESC, h.event_id DESC) AS k FROM events i JOIN h ON h.user_id = i.user_id AND h.ts < i.ts)
       SELECT e.event_id, round(avg(r.value), 6) AS lag_mean FROM events e LEFT JOIN r ON r.event_id = e.event_id AND r.k <= 5 GROUP BY 1""",
)
def asof_events_lag5(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    history = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    out = X.lag_mean(events.select("event_id", "user_id", "ts"), history, "user_id", "ts", "value", tiebreak="event_id")
    return out.select("event_id", F.round("lag_mean", 6).alias("lag_mean"))


@query(
    "majority_brand_type",
    """SELECT p_brand, p_type, n, round(n / t, 6) AS share FROM (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS t,
       row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1""",
)
def majority_brand_type(spark, sf_dir):
    return X.majority(table(spark, sf_dir, "part"), "p_brand", "p_type").withColumn("share", F.round("share", 6))


@query(
    "lookup_order_region",
    """SELECT r_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""",
)
def lookup_order_region(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "customer", "nation", "region")
    out = X.lookup(t["orders"].select("o_orderkey", "o_custkey"), t["customer"], "o_custkey", "c_custkey", ["c_nationkey"], required=True)
    out = X.lookup(out, t["nation"], "c_nationkey", "n_nationkey", ["n_regionkey"], required=True)
    return X.lookup(out, t["region"], "n_regionkey", "r_regionkey", ["r_name"], required=True).groupBy("r_name").agg(F.count("*").alias("n"))


@query(
    "latest_order_of_customer",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_order_of_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return X.latest_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "perturbed_parts",
    "SELECT count(*) AS n, CAST(sum(least(greatest(p_size + 10, 0), 45)) AS BIGINT) AS total FROM part WHERE p_size IS NOT NULL",
)
def perturbed_parts(spark, sf_dir):
    return X.perturb(table(spark, sf_dir, "part"), "p_size", 10, 0, 45).agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"))


# Decoding -------------------------------------------------------------------------------

_G = [0, 0, 1, 1, 2, 2, 3, 3, 4, -1]


def _cells(spark, sf_dir):
    """Two cells of each embedding: ten child and five parent classes, by the logits in the vector."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) >= 15")
    logits = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    out = e.select("vec_id", "label", logits(1, 10).alias("c"), logits(11, 5).alias("p"))
    return out.withColumns({"log_child": F.expr(L.log_softmax("c")), "log_parent": F.expr(L.log_softmax("p"))}).drop("c", "p")


_CELLS = """e AS (SELECT vec_id, label, embedding[1:10]::DOUBLE[] AS c, embedding[11:15]::DOUBLE[] AS p FROM embeddings WHERE len(embedding) >= 15),
    q AS (SELECT vec_id, label, list_transform(c, lambda z: z - ln(list_sum(list_transform(c, lambda y: exp(y))))) AS lc, list_transform(p, lambda z: z - ln(list_sum(list_transform(p, lambda y: exp(y))))) AS lp FROM e)"""


@query(
    "ccd_group_agreement",
    f"""WITH {_CELLS}, s AS (SELECT label, k, sum(l) AS l FROM (SELECT label, unnest(lc) AS l, unnest(range(10)) AS k FROM q) GROUP BY 1, 2), m AS (SELECT label, max(l) AS m FROM s GROUP BY 1)
        SELECT label, round(any_value(m) + ln(sum(exp(l - m))), 6) AS log_qc, CAST(arg_max(k, l) AS INT) AS map FROM s JOIN m USING (label) GROUP BY 1""",
)
def ccd_group_agreement(spark, sf_dir):
    return D.group_agreement(_cells(spark, sf_dir), "label", "log_child").select("label", F.round("log_qc", 6).alias("log_qc"), "map")


@query(
    "ccd_item_fd",
    f"""WITH {_CELLS}, g AS (SELECT unnest({_G}) AS g, unnest(range(10)) AS k), s AS (SELECT vec_id, k, g, lc[k + 1] + lp[g + 1] AS l FROM q, g WHERE g >= 0),
        n AS (SELECT vec_id, k, b, lc[k + 1] + lp[b + 1] AS l FROM q, g, (SELECT unnest(range(5)) AS b) WHERE b <> g)
        SELECT vec_id, log_qc, map_child, map_parent, log_q_incoherent FROM (SELECT vec_id, round(ln(sum(exp(l))), 6) AS log_qc, CAST(arg_max(k, l) AS INT) AS map_child, CAST(arg_max(g, l) AS INT) AS map_parent FROM s GROUP BY 1)
        JOIN (SELECT vec_id, round(max(l), 6) AS log_q_incoherent FROM n GROUP BY 1) USING (vec_id)""",
)
def ccd_item_fd(spark, sf_dir):
    out = I.item_fd(_cells(spark, sf_dir), _G)
    return out.select("vec_id", F.round("log_qc", 6).alias("log_qc"), "map_child", "map_parent", F.round("log_q_incoherent", 6).alias("log_q_incoherent"))


@query(
    "ccd_order_fd",
    f"""WITH {_CELLS}, g AS (SELECT unnest({_G}) AS g, unnest(range(10)) AS k), o AS (SELECT *, vec_id // 3 AS order_id FROM q),
        i AS (SELECT order_id, vec_id, g, any_value(lp[g + 1]) + ln(sum(exp(lc[k + 1]))) AS l, any_value(lp[g + 1]) + max(lc[k + 1]) AS m FROM o, g WHERE g >= 0 GROUP BY 1, 2, 3),
        s AS (SELECT order_id, g, sum(l) AS l, sum(m) AS m FROM i GROUP BY 1, 2)
        SELECT order_id, round(max(l) + ln(sum(exp(l - x))), 6) AS log_qc, CAST(arg_max(g, m) AS INT) AS parent, round(max(m), 6) AS log_q_map
        FROM s JOIN (SELECT order_id, max(l) AS x FROM s GROUP BY 1) USING (order_id) GROUP BY 1""",
)
def ccd_order_fd(spark, sf_dir):
    items = _cells(spark, sf_dir).withColumn("order_id", F.expr("vec_id div 3"))
    out = I.order_agreement_fd(items, _G)
    return out.select("order_id", F.round("order_log_qc", 6).alias("log_qc"), F.col("order_parent").alias("parent"), F.round("order_log_q_map", 6).alias("log_q_map"))


@query(
    "ccd_cross_task",
    f"""WITH {_CELLS}, g AS (SELECT unnest({_G}) AS g, unnest(range(10)) AS k)
        SELECT vec_id, round(ln(sum(exp(lc[k + 1] + lp[g + 1]))), 6) AS log_qc, CAST(arg_max(k, lc[k + 1] + lp[g + 1]) AS INT) AS a, CAST(arg_max(g, lc[k + 1] + lp[g + 1]) AS INT) AS b FROM q, g WHERE g >= 0 GROUP BY 1""",
)
def ccd_cross_task(spark, sf_dir):
    e = "transform({0}, x -> exp(x))"
    cells = _cells(spark, sf_dir).select("vec_id", F.expr(e.format("log_child")).alias("qa"), F.expr(e.format("log_parent")).alias("qb"))
    out = D.relation(cells, "qa", "qb", [[p == b for b in range(5)] for p in _G])
    return out.select("vec_id", F.round("log_qc", 6).alias("log_qc"), F.col("map")[0].alias("a"), F.col("map")[1].alias("b"))


@query(
    "ccd_temper",
    f"""WITH {_CELLS}, t AS (SELECT vec_id, list_transform(lp, lambda x: x / 2) AS z FROM q)
        SELECT vec_id, round(list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y)))), 6) AS top FROM t""",
)
def ccd_temper(spark, sf_dir):
    return _cells(spark, sf_dir).select("vec_id", F.round(F.array_max(D.temper("log_parent", 2.0)), 6).alias("top"))


@query(
    "ccd_cardinality",
    """WITH p AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: 1 / (1 + exp(-4 * x::DOUBLE))) AS p FROM embeddings WHERE len(embedding) >= 8),
       s AS (SELECT unnest(range(256)) AS s), b AS (SELECT list_transform(range(8), lambda k: (s >> k) & 1) AS b FROM s),
       j AS (SELECT vec_id, array_to_string(b, '') AS map, list_product(list_transform(range(1, 9), lambda k: CASE WHEN b[k] = 1 THEN p[k] ELSE 1 - p[k] END)) AS m FROM p, b WHERE list_sum(b) BETWEEN 2 AND 4)
       SELECT vec_id, round(ln(sum(m)), 6) AS log_qc, arg_max(map, m) AS map FROM j GROUP BY 1""",
)
def ccd_cardinality(spark, sf_dir):
    """Conditioned numbers of positives among the first eight entries of each vector: two to four of them."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) >= 8")
    p = F.transform(F.slice("embedding", 1, 8), lambda x: 1 / (1 + F.exp(-4 * x.cast("double"))))
    out = D.cardinality(e.select("vec_id", p.alias("p"), F.lit(2).alias("lo"), F.lit(4).alias("hi")), "p", "lo", "hi")
    return out.select("vec_id", F.round("log_qc", 6).alias("log_qc"), F.concat_ws("", "map").alias("map"))


@query("ccd_evaluate")
def ccd_evaluate(spark, sf_dir):
    """Decoders compared on the embeddings' cells; the label gives the true classes."""
    items = _cells(spark, sf_dir).withColumns({"order_id": F.expr("vec_id div 3"), "true_child": F.expr("cast(pmod(label, 10) AS int)"), "true_parent": F.expr("cast(pmod(label, 10) div 2 AS int)")})
    rate = ["acc_child", "acc_parent", "exact_match", "violation_rate"]
    return I.evaluate(items, _G, calibrate=True).item_table().select("method", "n_violations", *[F.round(c, 6).alias(c) for c in rate])
