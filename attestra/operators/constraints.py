"""Integrity constraints as lazy DataFrames.

A constraint names its tables; check() turns a mapping of names to DataFrames into a result
that holds what was checked and what violates, unevaluated. Counting both is one job
over one plan. Missing keys match each other, NaN is missing, and a comparison with a
missing value is false, so that negated comparisons count it as a violation.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions.hot import tasks_for
from attestra.functions.nulls import Condition, as_list, condition, holds, join_same, nan_to_null
from attestra.operators.pairs import order_denial_counts, tiled_pairs
from attestra.operators.reducers import Reducer, reduce_by

Tables = Mapping[str, DataFrame]
#: The boolean column that tells violations from the rest of what is checked.
VIOLATES = "_violates"
SUMMARY = ["name", "kind", "n_checked", "n_violations", "violation_rate"]


@dataclass(frozen=True)
class ViolationResult:
    """violations and counts (one row: n_checked, n_violations) are lazy; the numbers run the job once."""

    name: str
    kind: str
    violations: DataFrame
    counts: DataFrame

    @property
    def summary(self) -> DataFrame:
        rate = F.when(F.col("n_checked") > 0, F.col("n_violations") / F.col("n_checked")).otherwise(F.lit(float("nan")))
        return self.counts.select(
            F.lit(self.name).alias("name"), F.lit(self.kind).alias("kind"), "n_checked", "n_violations", rate.alias("violation_rate")
        )

    @cached_property
    def _numbers(self):
        return self.summary.first()

    @property
    def n_checked(self) -> int:
        return self._numbers.n_checked

    @property
    def n_violations(self) -> int:
        return self._numbers.n_violations

    @property
    def rate(self) -> float:
        return self._numbers.violation_rate


class Constraint(ABC):
    """Subclasses set kind and give checked(): what is checked, with the column VIOLATES."""

    kind = ""

    def __init__(self, name: str):
        self.name = name

    @abstractmethod
    def checked(self, tables: Tables) -> DataFrame: ...

    def violations(self, tables: Tables) -> DataFrame:
        return self.checked(tables).where(VIOLATES).drop(VIOLATES)

    def counts(self, tables: Tables) -> DataFrame:
        return self.checked(tables).agg(F.count("*").alias("n_checked"), F.count_if(VIOLATES).alias("n_violations"))

    def check(self, tables: Tables) -> ViolationResult:
        return ViolationResult(self.name, self.kind, self.violations(tables), self.counts(tables))


class ReferentialIntegrity(Constraint):
    """Every child row's key stands in the parent. With nullable, keys with a missing part aren't checked."""

    kind = "referential_integrity"

    def __init__(self, name: str, child: str, fk_cols, parent: str, pk_cols, nullable: bool = False):
        super().__init__(name)
        self.child, self.parent, self.nullable = child, parent, nullable
        self.fk_cols, self.pk_cols = as_list(fk_cols), as_list(pk_cols)
        if len(self.fk_cols) != len(self.pk_cols):
            raise ValueError(f"{name}: {len(self.fk_cols)} key columns refer to {len(self.pk_cols)}")

    def _sides(self, tables: Tables) -> tuple[DataFrame, DataFrame]:
        child = nan_to_null(tables[self.child], self.fk_cols)
        child = child.na.drop(subset=self.fk_cols) if self.nullable else child
        return child, nan_to_null(tables[self.parent].select(*self.pk_cols), self.pk_cols).distinct()

    def checked(self, tables: Tables) -> DataFrame:
        child, keys = self._sides(tables)
        out = join_same(child, keys.withColumn("_found", F.lit(True)), self.fk_cols, self.pk_cols)
        return out.withColumn(VIOLATES, F.col("_found").isNull()).drop("_found")

    def violations(self, tables: Tables) -> DataFrame:
        child, keys = self._sides(tables)
        return join_same(child, keys, self.fk_cols, self.pk_cols, "left_anti")

    def counts(self, tables: Tables) -> DataFrame:
        """Of the child's rows only their number for each key is joined, so a hot key costs one row."""
        child, keys = self._sides(tables)
        per_key = child.groupBy(*self.fk_cols).agg(F.count("*").alias("_n"))
        out = join_same(per_key, keys.withColumn("_found", F.lit(True)), self.fk_cols, self.pk_cols)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return out.agg(total(F.col("_n")).alias("n_checked"), total(F.when(F.col("_found").isNull(), F.col("_n"))).alias("n_violations"))


class Cardinality(Constraint):
    """The number of rows in each group keeps within bounds.

    Groups are those of universe_table, or of the table before row_filter; a group without
    rows counts zero. Bounds are the same for all groups, or come from bounds_table, whose
    columns exact, min and max hold where they aren't missing; groups without a row
    there aren't checked.
    """

    kind = "cardinality"

    def __init__(self, name: str, table: str, group_cols, exact: int | None = None, min: int | None = None, max: int | None = None,
                 row_filter: Condition | None = None, universe_table: str | None = None, bounds_table: str | None = None):
        super().__init__(name)
        self.table, self.group_cols = table, as_list(group_cols)
        self.bounds = {"exact": exact} if exact is not None else {"min": min, "max": max}
        self.bounds = {k: v for k, v in self.bounds.items() if v is not None}
        self.row_filter, self.universe_table, self.bounds_table = row_filter, universe_table, bounds_table
        if bool(self.bounds) == (bounds_table is not None):
            raise ValueError(f"{name}: give either exact, min or max, or a bounds_table")

    def checked(self, tables: Tables) -> DataFrame:
        g = self.group_cols
        table = nan_to_null(tables[self.table], g)
        rows = table if self.row_filter is None else table.where(holds(condition(table, self.row_filter)))
        counts = rows.groupBy(*g).agg(F.count("*").alias("_n"))
        universe = nan_to_null(tables[self.universe_table], g) if self.universe_table else table
        groups = universe.select(*g).distinct()
        if self.row_filter is None and self.universe_table is None:
            out = counts  # the groups are the counted ones
        else:
            out = join_same(groups, counts, g)
        out = out.withColumn("count", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
        if self.bounds_table:
            limits = nan_to_null(tables[self.bounds_table])
            held = [c for c in ("exact", "min", "max") if c in limits.columns]
            out = join_same(out, limits.select(*g, *held), g, how="inner")
            bound = {c: F.col(c) for c in held}
        else:
            bound = {k: F.lit(v) for k, v in self.bounds.items()}
        broken = {"exact": lambda n, b: n != b, "min": lambda n, b: n < b, "max": lambda n, b: n > b}
        tests = [holds(broken[k](F.col("count"), b)) for k, b in bound.items()]
        return out.withColumn(VIOLATES, reduce(lambda a, b: a | b, tests, F.lit(False)))


class FunctionalDependency(Constraint):
    """Within a determinant's group the dependent has one value: rows that differ from the commonest violate.

    Of equally common values the least counts. A missing dependent always violates, also
    where the whole group has none.
    """

    kind = "functional_dependency"

    def __init__(self, name: str, table: str, determinant, dependent: str):
        super().__init__(name)
        self.table, self.determinant, self.dependent = table, as_list(determinant), dependent
        if not isinstance(dependent, str):
            raise ValueError(f"{name}: the dependent is one column")

    def _rows(self, tables: Tables) -> DataFrame:
        return nan_to_null(tables[self.table], [*self.determinant, self.dependent])

    def _counts(self, tables: Tables) -> DataFrame:
        return self._rows(tables).groupBy(*self.determinant, F.col(self.dependent).alias("_value")).agg(F.count("*").alias("_n"))

    def modes(self, tables: Tables) -> DataFrame:
        """The commonest value of each determinant as _mode; groups without any value are missing."""
        best = F.min(F.struct((-F.col("_n")).alias("less"), F.col("_value").alias("value")))
        return self._counts(tables).where(F.col("_value").isNotNull()).groupBy(*self.determinant).agg(best["value"].alias("_mode"))

    def checked(self, tables: Tables) -> DataFrame:
        out = join_same(self._rows(tables), self.modes(tables), self.determinant)
        return out.withColumn(VIOLATES, ~holds(F.col(self.dependent) == F.col("_mode"))).drop("_mode")

    def violations(self, tables: Tables) -> DataFrame:
        """Rows that don't stand in the table of modes: keyed by value too, so a hot group is spread over its values."""
        rows = self._rows(tables)
        modes = self.modes(tables).withColumnRenamed("_mode", "_value")
        on = [rows[c].eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(self.determinant)] + [rows[self.dependent] == F.col("_value")]
        right = modes.withColumnsRenamed({c: f"_key{k}" for k, c in enumerate(self.determinant)})
        return rows.join(right, reduce(lambda a, b: a & b, on), "left_anti")

    def counts(self, tables: Tables) -> DataFrame:
        """Counts of values only: a row that doesn't violate is one of its group's commonest value."""
        counts = self._counts(tables)
        best = counts.groupBy(*self.determinant).agg(
            F.sum("_n").alias("_all"), F.coalesce(F.max(F.when(F.col("_value").isNotNull(), F.col("_n"))), F.lit(0)).alias("_best")
        )
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return best.agg(total(F.col("_all")).alias("n_checked"), total(F.col("_all") - F.col("_best")).alias("n_violations"))


#: Aggregates by the names that data frames commonly know them by.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "size": lambda c: F.count("*"),
    "nunique": F.countDistinct, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "prod": F.product, "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


class AggregateConsistency(Constraint):
    """A parent's value equals an aggregate of its children, within a tolerance.

    A parent key given more than once counts with its least value; children without a key
    don't count; a parent without children is compared with zero. The aggregate is one of AGGREGATES by name, or a
    Reducer of one's own.
    """

    kind = "aggregate_consistency"

    def __init__(self, name: str, parent: str, parent_key, parent_val: str, child: str, child_key, child_val: str,
                 agg: str | Reducer = "sum", tol: float = 1e-6, child_filter: Condition | None = None):
        super().__init__(name)
        self.parent, self.parent_key, self.parent_val = parent, as_list(parent_key), parent_val
        self.child, self.child_key, self.child_val = child, as_list(child_key), child_val
        self.agg, self.tol, self.child_filter = agg, tol, child_filter
        if len(self.parent_key) != len(self.child_key):
            raise ValueError(f"{name}: the keys differ in their number of columns")
        if not isinstance(agg, Reducer) and agg not in AGGREGATES:
            raise ValueError(f"{name}: unknown aggregate {agg}")

    def checked(self, tables: Tables) -> DataFrame:
        parent = nan_to_null(tables[self.parent].select(*self.parent_key, self.parent_val))
        parent = parent.groupBy(*self.parent_key).agg(F.min(self.parent_val).alias(self.parent_val))
        child = nan_to_null(tables[self.child], [*self.child_key, self.child_val])
        child = child if self.child_filter is None else child.where(holds(condition(child, self.child_filter)))
        child = child.na.drop(subset=self.child_key)
        if isinstance(self.agg, Reducer):
            sums = reduce_by(child, self.child_key, self.child_val, self.agg, "agg_value")
        else:
            sums = child.groupBy(*self.child_key).agg(AGGREGATES[self.agg](self.child_val).alias("agg_value"))
        out = join_same(parent, sums, self.parent_key, self.child_key).withColumn("agg_value", F.coalesce("agg_value", F.lit(0)))
        return out.withColumn(VIOLATES, holds(F.abs(F.col(self.parent_val) - F.col("agg_value")) > self.tol))


_RELATIONS: dict[str, Callable[[Column, Column], Column]] = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}


class TemporalOrder(Constraint):
    """In rows joined on their keys the left time stands in a relation to the right one; a missing time violates."""

    kind = "temporal_order"

    def __init__(self, name: str, left_table: str, left_time_col: str, right_table: str, right_time_col: str, join_on, relation: str = "<="):
        super().__init__(name)
        if relation not in _RELATIONS:
            raise ValueError(f"{name}: the relation is one of {', '.join(_RELATIONS)}")
        self.left, self.left_time, self.right, self.right_time = left_table, left_time_col, right_table, right_time_col
        self.join_on, self.relation = as_list(join_on), relation

    def checked(self, tables: Tables) -> DataFrame:
        right_time = self.right_time + "__right" if self.right_time == self.left_time else self.right_time
        left = tables[self.left].select(*self.join_on, self.left_time)
        right = tables[self.right].select(*self.join_on, F.col(self.right_time).alias(right_time))
        out = join_same(left, right, self.join_on, how="inner")
        return out.withColumn(VIOLATES, ~holds(_RELATIONS[self.relation](F.col(self.left_time), F.col(right_time))))


class DenialConstraint(Constraint):
    """No row, or no pair of joined rows, fulfils the predicate.

    With right and join_on, pairs are checked; columns of both sides besides the keys get the
    suffixes. dedupe_cols names the two id columns (with suffixes) of which the left one is less, for
    pairs within one table; a large group's pairs are then spread over tiles. columns limits what the pairs carry.
    """

    kind = "denial"

    def __init__(self, name: str, left: str, predicate: Condition, right: str | None = None, join_on=None, suffixes: tuple[str, str] = ("_l", "_r"),
                 dedupe_cols: tuple[str, str] | None = None, columns: Sequence[str] | None = None):
        super().__init__(name)
        if right is not None and join_on is None:
            raise ValueError(f"{name}: pairs need join_on")
        self.left, self.predicate, self.right, self.suffixes = left, predicate, right, suffixes
        self.join_on = as_list(join_on) if join_on is not None else []
        self.dedupe_cols, self.columns = dedupe_cols, columns

    def _own_id(self) -> str | None:
        """The id column of pairs within one table, if their columns get suffixes by the plain rule."""
        if self.left != self.right or not self.dedupe_cols:
            return None
        a, b = (c.removesuffix(s) for c, s in zip(self.dedupe_cols, self.suffixes))
        whole = (a + self.suffixes[0], b + self.suffixes[1]) == tuple(self.dedupe_cols)
        return a if a == b and whole and a not in self.join_on else None

    def checked(self, tables: Tables) -> DataFrame:
        left = nan_to_null(tables[self.left])
        if self.right is None:
            return left.withColumn(VIOLATES, holds(condition(left, self.predicate)))
        if i := self._own_id():
            columns = left.columns if self.columns is None else [*self.join_on, *self.columns]
            pairs = tiled_pairs(left.select(*dict.fromkeys([*columns, i])), self.join_on, i, self.suffixes)
            return pairs.withColumn(VIOLATES, holds(condition(pairs, self.predicate)))
        right = nan_to_null(tables[self.right])
        if self.columns is not None:
            kept = lambda df: df.select(*dict.fromkeys([*self.join_on, *(c for c in self.columns if c in df.columns)]))
            left, right = kept(left), kept(right)
        shared = (set(left.columns) & set(right.columns)) - set(self.join_on)
        named = lambda df, s: df.withColumnsRenamed({c: c + s for c in df.columns if c in shared})
        pairs = join_same(named(left, self.suffixes[0]), named(right, self.suffixes[1]), self.join_on, how="inner")
        if self.dedupe_cols:
            a, b = self.dedupe_cols
            pairs = pairs.where(F.col(a) < F.col(b))
        return pairs.withColumn(VIOLATES, holds(condition(pairs, self.predicate)))


class PairDisagreement(Constraint):
    """Pairs of rows of one group with different ids may not differ in a value.

    It counts what a DenialConstraint over the pairs (id_l < id_r, value_l <> value_r) counts,
    but from counts of values, in time linear in the rows; a missing value differs from all.
    violations() gives the pairs themselves.
    """

    kind = "denial"

    def __init__(self, name: str, table: str, group_cols, id_col: str, value_col: str):
        super().__init__(name)
        self.table, self.group_cols, self.id_col, self.value_col = table, as_list(group_cols), id_col, value_col

    def pairs(self) -> DenialConstraint:
        i, v = self.id_col, self.value_col
        return DenialConstraint(
            self.name, self.table, lambda df: ~holds(F.col(f"{v}_l") == F.col(f"{v}_r")), right=self.table, join_on=self.group_cols,
            dedupe_cols=(f"{i}_l", f"{i}_r"), columns=[i, v],
        )

    def checked(self, tables: Tables) -> DataFrame:
        return self.pairs().checked(tables)

    def group_counts(self, tables: Tables) -> DataFrame:
        """A row for each group: its pairs (n_checked) and those that differ (n_violations).

        Rows are dealt by buckets of group and id, then the counts of values by buckets of group and value; what meets
        by group alone are sums, one from each bucket, so a hot group is small there. The buckets are so many that each holds a bounded
        number of rows, which are counted for that at once.
        """
        g, i, v = self.group_cols, self.id_col, self.value_col
        rows = nan_to_null(tables[self.table].select(*dict.fromkeys([*g, i, v])), [i, v]).where(F.col(i).isNotNull())
        two = lambda n: n * (n - 1) / 2
        n = tasks_for(tables[self.table])
        bucket = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(64 * n)).cast("int")  # noqa: E731  many for each task, so that all have as much
        # The bucket stays a key, so all counts within it are made where it lies.
        dealt = rows.withColumn("_d", bucket(*g, i)).repartition(n, "_d").groupBy("_d", *g, i, v).agg(F.count("*").alias("_n"))
        # The pairs in a set of rows, less those of one id: in each group, and for each value in it.
        by_id = dealt.groupBy("_d", *g, i).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col(v).isNotNull(), two(F.col("_n")))).alias("_own"))
        by_id = by_id.groupBy("_d", *g).agg(F.sum(two(F.col("_n"))).alias("_less"), F.sum(-F.coalesce("_own", F.lit(0))).alias("_same"))
        by_value = dealt.groupBy("_d", *g, v).agg(F.sum("_n").alias("_n")).withColumn("_d", bucket(*g, v)).repartition(n, "_d").groupBy("_d", *g, v).agg(F.sum("_n").alias("_n"))
        by_value = by_value.groupBy("_d", *g).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col(v).isNotNull(), two(F.col("_n"))).otherwise(0)).alias("_same"))
        parts = by_id.select(*g, F.lit(0).alias("_n"), "_less", "_same").union(by_value.select(*g, "_n", F.lit(0), "_same"))
        sums = parts.repartition(n, *g).groupBy(*g).agg(*[F.sum(c).alias(c) for c in ("_n", "_less", "_same")])
        pairs = two(F.col("_n")) - F.col("_less")
        return sums.select(*g, pairs.cast("long").alias("n_checked"), (pairs - F.col("_same")).cast("long").alias("n_violations"))

    def counts(self, tables: Tables) -> DataFrame:
        return self.group_counts(tables).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_checked", "n_violations")])


class OrderDenial(Constraint):
    """In no pair of rows of one group with order_l < order_r stands value_l in the relation to value_r.

    It counts what a DenialConstraint over the pairs counts, but by two sorts, without making them; a
    missing value is in no relation. violations() gives the pairs themselves.
    """

    kind = "denial"

    def __init__(self, name: str, table: str, group_cols, order_col: str, value_col: str, relation: str = ">"):
        super().__init__(name)
        if relation not in _RELATIONS:
            raise ValueError(f"{name}: the relation is one of {', '.join(_RELATIONS)}")
        self.table, self.group_cols, self.order_col, self.value_col, self.relation = table, as_list(group_cols), order_col, value_col, relation

    def pairs(self) -> DenialConstraint:
        o, v = self.order_col, self.value_col
        return DenialConstraint(
            self.name, self.table, lambda df: _RELATIONS[self.relation](F.col(f"{v}_l"), F.col(f"{v}_r")), right=self.table, join_on=self.group_cols,
            dedupe_cols=(f"{o}_l", f"{o}_r"), columns=[o, v],
        )

    def checked(self, tables: Tables) -> DataFrame:
        return self.pairs().checked(tables)

    def counts(self, tables: Tables) -> DataFrame:
        return order_denial_counts(tables[self.table], self.group_cols, self.order_col, self.value_col, self.relation)


class MonotonicityConstraint(Constraint):
    """y_pred of the table perturbed moves in one direction from that of original, within a tolerance."""

    kind = "monotonicity"

    def __init__(self, name: str, id_col: str, direction: str = "non_decreasing", tolerance: float = 1e-9):
        super().__init__(name)
        if direction not in ("non_decreasing", "non_increasing"):
            raise ValueError(f"{name}: the direction is non_decreasing or non_increasing")
        self.id_col, self.direction, self.tolerance = id_col, direction, tolerance

    def checked(self, tables: Tables) -> DataFrame:
        side = lambda t, c: nan_to_null(tables[t].select(self.id_col, F.col("y_pred").alias(c)))
        out = join_same(side("original", "y_pred_orig"), side("perturbed", "y_pred_pert"), [self.id_col], how="inner")
        out = out.withColumn("delta", F.col("y_pred_pert") - F.col("y_pred_orig"))
        broken = F.col("delta") < -self.tolerance if self.direction == "non_decreasing" else F.col("delta") > self.tolerance
        return out.withColumn(VIOLATES, holds(broken))


def run_constraints(constraints: Iterable[Constraint], tables: Tables, progress: Callable[[str], None] | None = None) -> list[ViolationResult]:
    """Results in the order given. With progress they are evaluated one by one and timed."""
    results = []
    for c in constraints:
        began = time.monotonic()
        result = c.check(tables)
        if progress:
            progress(f"{c.name}: {result.n_violations:,} of {result.n_checked:,} ({time.monotonic() - began:.1f} s)")
        results.append(result)
    return results


def summarize(results: Sequence[ViolationResult]) -> DataFrame:
    """One row for each result, in order, as one lazy union."""
    rows = [r.summary.withColumn("_order", F.lit(k)) for k, r in enumerate(results)]
    return reduce(DataFrame.unionByName, rows).orderBy("_order").select(*SUMMARY)


def one_pass(table: DataFrame, predicates: Mapping[str, Condition]) -> DataFrame:
    """The summary of unary denial constraints over one table, from a single scan: one row for each."""
    df = nan_to_null(table)
    named = list(predicates.items())
    row = df.agg(F.count("*").alias("n"), *[F.count_if(holds(condition(df, p))).alias(f"v{k}") for k, (_, p) in enumerate(named)])
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.col(f"v{k}").alias("v")) for k, (name, _) in enumerate(named)])
    rate = F.when(F.col("n") > 0, F.col("e.v") / F.col("n")).otherwise(F.lit(float("nan")))
    out = row.select("n", F.explode(entries).alias("e"))
    return out.select("e.name", F.lit("denial").alias("kind"), F.col("n").alias("n_checked"), F.col("e.v").alias("n_violations"), rate.alias("violation_rate"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order that leaves no ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
