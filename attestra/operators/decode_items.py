"""Decoding items and orders so that an item's parent follows from its child and an order shares one parent.

The input is a table of items: order id, the log probabilities of its child and parent classes
(arrays, such as shipping points and plants), and the true classes' indices (-1: unknown to the
model). g gives each child class its parent class's index, -1 for none; it has an entry for
each class, so it is a literal in the plan. Items stay rows; orders are sums over
their items' arrays by parent class, which are combined before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import logs as L
from attestra.operators import decoding as D
from attestra.operators.features import majority
from attestra.operators.metrics import cluster_bootstrap_ci, mcnemar
from attestra.sources.shared import store


def child_to_parent(mapping: DataFrame, child: str, parent: str, child_classes: Sequence[str], parent_classes: Sequence[str]) -> list[int]:
    """g from a mapping with one row for each child value; only rows of known classes reach the driver."""
    position = {p: k for k, p in enumerate(parent_classes)}
    rows = mapping.where(F.col(child).isin(list(child_classes))).select(child, parent).collect()
    parent_of = {r[0]: r[1] for r in rows}
    return [position.get(parent_of.get(c), -1) for c in child_classes]


def learn_mapping(train: DataFrame, child: str, parent: str) -> DataFrame:
    """Each child value's commonest parent among training rows, with its support and share."""
    return majority(train, child, parent)


def class_index(df: DataFrame, label: str, classes: Sequence[str], out: str) -> DataFrame:
    """df with the label's index among the classes, -1 for any other."""
    return df.withColumn(out, F.coalesce(F.array_position(F.lit(list(classes)), F.col(label)), F.lit(0)).cast("int") - 1)


def pick(log_q: str, index: str):
    """The log probability at an index, -Infinity at -1."""
    return F.expr(f"CASE WHEN {index} < 0 THEN {L.NEG_INF} ELSE element_at({log_q}, {index} + 1) END")


def _g(g: Sequence[int]) -> str:
    return "array(" + ", ".join(map(str, g)) + ")"


def admissible(child: str, parent: str, g: Sequence[int]) -> str:
    return f"({child} >= 0 AND {parent} >= 0 AND element_at({_g(g)}, greatest({child}, 0) + 1) = {parent})"


def item_fd(items: DataFrame, g: Sequence[int], lc: str = "log_child", lp: str = "log_parent") -> DataFrame:
    """items with log_qc, the likeliest coherent pair (map_child, map_parent, log_q_map) and the likeliest incoherent one."""
    n, gs = len(g), _g(g)
    other = f"array_max(filter({lp}, (x, k) -> k <> _top))"
    out = items.withColumn("_top", F.expr(L.arg_max(lp))).withColumn("_best", F.expr(f"array_max({lp})")).withColumn("_next", F.expr(other))
    out = out.withColumn("_second", F.expr(f"cast(element_at(filter(transform({lp}, (x, k) -> CASE WHEN k <> _top AND x = _next THEN k END), k -> k IS NOT NULL), 1) AS int)"))
    each = f"sequence(0, {n - 1})"
    out = out.withColumn("_coherent", F.expr(f"transform({each}, s -> CASE WHEN element_at({gs}, s + 1) < 0 THEN {L.NEG_INF} ELSE element_at({lc}, s + 1) + element_at({lp}, element_at({gs}, s + 1) + 1) END)"))
    out = out.withColumn("_incoherent", F.expr(f"transform({each}, s -> element_at({lc}, s + 1) + CASE WHEN element_at({gs}, s + 1) = _top THEN coalesce(_next, {L.NEG_INF}) ELSE _best END)"))
    out = out.withColumns({"map_child": F.expr(L.arg_max("_coherent")), "incoherent_child": F.expr(L.arg_max("_incoherent"))})
    return out.withColumns({
        "log_qc": F.expr(L.lse("_coherent")), "log_q_map": F.expr("array_max(_coherent)"), "map_parent": F.expr(f"element_at({gs}, map_child + 1)"),
        "log_q_incoherent": F.expr("array_max(_incoherent)"),
        "incoherent_parent": F.expr(f"CASE WHEN element_at({gs}, incoherent_child + 1) = _top THEN _second ELSE _top END"),
    }).drop("_top", "_best", "_next", "_second", "_coherent", "_incoherent")


def order_agreement_fd(items: DataFrame, g: Sequence[int], order: str = "order_id", lc: str = "log_child", lp: str = "log_parent") -> DataFrame:
    """(order, order_log_qc, order_parent, order_log_q_map, order_log_parent): all items share one parent, and each child belongs to it."""
    gs = _g(g)
    own = f"transform({lp}, (x, c) -> filter({lc}, (y, s) -> element_at({gs}, s + 1) = c))"
    rows = items.withColumn("_own", F.expr(own))
    rows = rows.withColumn("_sum", F.expr(f"zip_with({lp}, transform(_own, ys -> {L.lse('ys')}), (x, y) -> x + y)"))
    rows = rows.withColumn("_top", F.expr(f"zip_with({lp}, transform(_own, ys -> coalesce(array_max(ys), {L.NEG_INF})), (x, y) -> x + y)"))
    sums = D.sum_by_scope(rows.select(order, "_sum", "_top"), order, "_sum", "_top")
    return sums.select(
        order, F.expr(L.lse("_sum")).alias("order_log_qc"), F.expr(L.arg_max("_top")).alias("order_parent"), F.expr("array_max(_top)").alias("order_log_q_map"),
        F.col("_sum").alias("order_log_parent"),
    )


def order_child_marginals(items: DataFrame, orders: DataFrame, g: Sequence[int], order: str = "order_id", lc: str = "log_child", lp: str = "log_parent") -> DataFrame:
    """items with child_marginal: each child's probability, given that the order's items share one parent and fit it.

    orders: what order_agreement_fd gives for the items. All zero where no joint values are coherent.
    """
    gs = _g(g)
    own = f"transform({lp}, (x, c) -> x + {L.lse(f'filter({lc}, (y, s) -> element_at({gs}, s + 1) = c)')})"
    rows = items.join(orders.select(order, "order_log_qc", "order_log_parent"), order).withColumn("_own", F.expr(own))
    rest = f"zip_with(order_log_parent, _own, (t, x) -> CASE WHEN t > {L.NEG_INF} THEN t - x - order_log_qc END)"  # of the other items
    p = f"coalesce(exp(y + element_at({lp}, greatest(element_at({gs}, s + 1), 0) + 1) + element_at(_rest, greatest(element_at({gs}, s + 1), 0) + 1)), 0D)"
    rows = rows.withColumn("_rest", F.expr(rest)).withColumn("child_marginal", F.expr(f"transform({lc}, (y, s) -> CASE WHEN element_at({gs}, s + 1) < 0 THEN 0D ELSE {p} END)"))
    return rows.select(*items.columns, "child_marginal")


def best_child_of(parent: str, g: Sequence[int], lc: str = "log_child"):
    """The likeliest child class that belongs to a parent class."""
    return F.expr(L.arg_max(f"transform({lc}, (x, s) -> CASE WHEN element_at({_g(g)}, s + 1) = {parent} THEN x ELSE {L.NEG_INF} END)"))


def greedy_repair(items: DataFrame, g: Sequence[int], child: str, parent: str, lc: str = "log_child", lp: str = "log_parent") -> DataFrame:
    """items with greedy_child, greedy_parent: of an inadmissible pair the less sure cell changes, or the other if it can't."""
    gs = _g(g)
    out = items.withColumn("_ok", F.expr(admissible(child, parent, g))).withColumn("_to", F.expr(f"element_at({gs}, {child} + 1)"))
    out = out.withColumn("_of", F.expr(f"transform({lc}, (x, s) -> CASE WHEN element_at({gs}, s + 1) = {parent} THEN x ELSE {L.NEG_INF} END)"))
    out = out.withColumns({"_alt": F.expr(L.arg_max("_of")), "_has": F.expr(f"array_max(_of) > {L.NEG_INF}")})
    unsure = f"element_at({lp}, {parent} + 1) <= element_at({lc}, {child} + 1)"
    out = out.withColumn("_parent_moves", F.expr(f"NOT _ok AND _to >= 0 AND ({unsure} OR NOT _has)"))
    out = out.withColumns({
        "greedy_child": F.expr(f"CASE WHEN NOT _ok AND NOT _parent_moves AND _has THEN _alt ELSE {child} END"),
        "greedy_parent": F.expr(f"CASE WHEN _parent_moves THEN _to ELSE {parent} END"),
    })
    return out.drop("_ok", "_to", "_of", "_alt", "_has", "_parent_moves")


def hamming_repair(items: DataFrame, g: Sequence[int], child: str, parent: str) -> DataFrame:
    """items with hamming_child, hamming_parent: the child stays and the parent follows."""
    to = f"element_at({_g(g)}, {child} + 1)"
    return items.withColumns({"hamming_child": F.col(child), "hamming_parent": F.expr(f"CASE WHEN NOT {admissible(child, parent, g)} AND {to} >= 0 THEN {to} ELSE {parent} END")})


def order_facts(items: DataFrame, g: Sequence[int], child: str, parent: str, order: str = "order_id") -> DataFrame:
    """(order, order_ok, all_correct): all pairs admissible with one parent; all as in truth."""
    right = F.expr(f"{child} = true_child AND {parent} = true_parent")
    ok = F.bool_and(F.expr(admissible(child, parent, g))) & (F.min(parent) == F.max(parent))
    return items.groupBy(order).agg(ok.alias("order_ok"), F.bool_and(right).alias("all_correct"))


ITEM_METHODS = {"raw": "raw", "greedy repair": "greedy", "nearest repair": "hamming", "conditioned": "map", "softly conditioned": "soft"}
ORDER_METHODS = {"raw": "raw", "conditioned by item": "map", "conditioned": "order", "softly conditioned": "order_soft"}
_NLL = {"raw": "raw", "greedy": "raw", "hamming": "raw", "map": "hard", "soft": "soft", "order": "hard", "order_soft": "soft"}


@dataclass
class Evaluation:
    """Decoded items and orders (stored), and the parameters fitted for each half."""

    items: DataFrame
    orders: DataFrame
    g: list[int]
    folds: list[dict] = field(default_factory=list)

    def item_table(self) -> DataFrame:
        """A row for each item method: accuracies, violations and mean losses."""
        rows, good = self.items, "isfinite_raw AND NOT violated"
        parts = []
        for name, m in ITEM_METHODS.items():
            c, p, nll = f"{m}_child", f"{m}_parent", f"nll_{_NLL[m]}"
            ok = admissible(c, p, self.g)
            mean = lambda e: F.avg(F.expr(f"cast({e} AS int)"))
            parts.append(rows.agg(
                F.lit(name).alias("method"), mean(f"{c} = true_child").alias("acc_child"), mean(f"{p} = true_parent").alias("acc_parent"),
                mean(f"{c} = true_child AND {p} = true_parent").alias("exact_match"), mean(f"NOT {ok}").alias("violation_rate"), F.count_if(F.expr(f"NOT {ok}")).alias("n_violations"),
                F.avg(F.expr(f"CASE WHEN {good} THEN {nll} END")).alias("nll_coherent_truth"), F.avg(F.expr(f"CASE WHEN isfinite_raw THEN {nll} END")).alias("nll_all"),
            ))
        return _union(parts)

    def order_table(self) -> DataFrame:
        parts = []
        for name, m in ORDER_METHODS.items():
            facts = order_facts(self.items, self.g, f"{m}_child", f"{m}_parent")
            nll = "nll_item_hard" if name == "conditioned by item" else f"nll_{_NLL[m]}"
            both = facts.join(self.orders, "order_id")
            mean = lambda e: F.avg(F.expr(f"cast({e} AS int)"))
            parts.append(both.agg(
                F.lit(name).alias("method"), mean("all_correct").alias("exact_match"), mean("NOT order_ok").alias("violation_rate"), F.count_if(F.expr("NOT order_ok")).alias("n_violations"),
                F.avg(F.expr(f"CASE WHEN isfinite_raw AND NOT violated THEN {nll} END")).alias("nll_coherent_truth"), F.avg(F.expr(f"CASE WHEN isfinite_raw THEN {nll} END")).alias("nll_all"),
            ))
        return _union(parts)

    def significance(self, n_boot: int = 2000, seed: int = 0) -> list[dict]:
        """Paired differences with intervals from resampled orders; exact tests where both are right or wrong."""
        rows = []
        both = lambda m: F.expr(f"{m}_child = true_child AND {m}_parent = true_parent")

        def add(scope, metric, names, df, a, b, tested):
            pairs = df.select("order_id", a.alias("a"), b.alias("b"))
            ci = cluster_bootstrap_ci(pairs.withColumn("d", F.col("a").cast("double") - F.col("b").cast("double")), "d", "order_id", n_boot, seed)
            row = {"scope": scope, "metric": metric, "comparison": names, "difference": ci.estimate, "ci_low": ci.low, "ci_high": ci.high}
            if tested:
                test = mcnemar(pairs, "a", "b")
                row |= {"a_only": test.a_only, "b_only": test.b_only, "p": test.p}
            rows.append(row)

        for name, m in list(ITEM_METHODS.items())[:3]:
            add("item", "both correct", f"conditioned vs {name}", self.items, both("map"), both(m), True)
        add("item", "parent correct", "conditioned vs raw", self.items, F.expr("map_parent = true_parent"), F.expr("raw_parent = true_parent"), True)
        exact = {m: order_facts(self.items, self.g, f"{m}_child", f"{m}_parent").select("order_id", F.col("all_correct").alias(m)) for m in ("order", "raw", "map")}
        for m, name in (("raw", "raw"), ("map", "conditioned by item")):
            add("order", "all items correct", f"conditioned vs {name}", exact["order"].join(exact[m], "order_id"), F.col("order"), F.col(m), True)
        for scope, df in (("item", self.items), ("order", self.orders)):
            add(scope, "log-loss, truth coherent", "conditioned vs raw", df.where("isfinite_raw AND NOT violated"), F.col("nll_hard"), F.col("nll_raw"), False)
            add(scope, "log-loss, all scored", "softly conditioned vs raw", df.where("isfinite_raw"), F.col("nll_soft"), F.col("nll_raw"), False)
        return rows


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate(items: DataFrame, g: Sequence[int], calibrate: bool, seed: int = 0) -> Evaluation:
    """Decode every item and order, each half of the orders with parameters fitted on the other half.

    items: order_id, log_child, log_parent, true_child, true_parent. The half goes by a hash of the order.
    """
    g = list(g)
    base = items.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "order_id"), F.lit(2)).cast("int"))
    base = base.withColumns({"raw_child": F.expr(L.arg_max("log_child")), "raw_parent": F.expr(L.arg_max("log_parent")), "violated": F.expr(f"NOT {admissible('true_child', 'true_parent', g)}")})
    base = store(base, "items")
    done_items, done_orders, folds = [], [], []
    for k in (0, 1):
        fit = base.where(F.col("fold") != k)
        t_child = D.fit_temperature(fit, "log_child", "true_child") if calibrate else 1.0
        t_parent = D.fit_temperature(fit, "log_parent", "true_parent") if calibrate else 1.0
        now = base.withColumns({"log_child": D.temper("log_child", t_child), "log_parent": D.temper("log_parent", t_parent)}) if calibrate else base
        now = item_fd(now, g).withColumn("nll_raw", -(pick("log_child", "true_child") + pick("log_parent", "true_parent")))
        now = greedy_repair(hamming_repair(now, g, "raw_child", "raw_parent"), g, "raw_child", "raw_parent")
        now = now.withColumn("log_raw", pick("log_child", "raw_child") + pick("log_parent", "raw_parent"))
        now = store(now.withColumn("isfinite_raw", F.expr("nll_raw < double('infinity')")), "decoded")
        truth = order_facts(now, g, "true_child", "true_parent").select("order_id", (~F.col("order_ok")).alias("violated"))
        raw = order_facts(now, g, "raw_child", "raw_parent").select("order_id", F.col("order_ok").alias("raw_ok"))
        sums = now.groupBy("order_id").agg(F.first("fold").alias("fold"), F.sum("nll_raw").alias("nll_raw"), F.sum("log_raw").alias("log_raw"))
        orders = order_agreement_fd(now, g).join(truth, "order_id").join(raw, "order_id").join(sums, "order_id")
        orders = store(orders.withColumn("isfinite_raw", F.expr("nll_raw < double('infinity')")), "orders")
        other = (F.col("fold") != k) & F.col("isfinite_raw")
        d_item = D.fit_log_strength(now.where(other), "violated", "log_qc")
        d_order = D.fit_log_strength(orders.where(other), "violated", "order_log_qc")
        folds.append({"fold": k, "t_child": t_child, "t_parent": t_parent, "log_delta_item": d_item, "log_delta_order": d_order})

        # For strengths up to 1 the likeliest incoherent order is the raw one, where that is incoherent.
        keeps = D.prefers_incoherent("order_log_q_map", f"(CASE WHEN raw_ok THEN {L.NEG_INF} ELSE log_raw END)", d_order)
        orders = orders.withColumn("keeps_raw", F.coalesce(keeps, F.lit(False)))
        half = now.where(F.col("fold") == k).join(orders.select("order_id", "order_parent", "keeps_raw"), "order_id")
        half = half.withColumn("_soft", F.coalesce(D.prefers_incoherent("log_q_map", "log_q_incoherent", d_item), F.lit(False)))
        half = half.withColumn("order_child", best_child_of("order_parent", g))
        half = half.withColumns({
            "soft_child": F.expr("CASE WHEN _soft THEN incoherent_child ELSE map_child END"), "soft_parent": F.expr("CASE WHEN _soft THEN incoherent_parent ELSE map_parent END"),
            "order_soft_child": F.expr("CASE WHEN keeps_raw THEN raw_child ELSE order_child END"), "order_soft_parent": F.expr("CASE WHEN keeps_raw THEN raw_parent ELSE order_parent END"),
            "nll_hard": D.joint_nll("nll_raw", "violated", "log_qc", -math.inf), "nll_soft": D.joint_nll("nll_raw", "violated", "log_qc", d_item), "deficit": -F.col("log_qc"),
        }).drop("_soft", "keeps_raw")
        half = store(half, "half")
        hard = half.groupBy("order_id").agg(F.sum("nll_hard").alias("nll_item_hard"))
        done_orders.append(orders.where(F.col("fold") == k).withColumns({
            "nll_hard": D.joint_nll("nll_raw", "violated", "order_log_qc", -math.inf), "nll_soft": D.joint_nll("nll_raw", "violated", "order_log_qc", d_order), "deficit": -F.col("order_log_qc"),
        }).join(hard, "order_id"))
        done_items.append(half)
    return Evaluation(_union(done_items), store(_union(done_orders), "orders"), g, folds)
