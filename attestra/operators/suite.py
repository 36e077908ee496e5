"""A suite of constraints as one plan: each table's rows are scanned once, and all counts come from one aggregate.

Most constraints are decided on counts of groups. Constraints over the same table and keys share a set
of groups; sets that have keys in common form a family with these as its root. A row makes one entry for each
family, and the entries are dealt to tasks by the root, so a task holds all groups of its roots: it tells the
sets of the family apart, counts their groups and sums by constraint without another shuffle. An entry
carries flags, the conditions that the constraints count by. Rows of a parent or a universe are
entries of the same families, as flags without a count, so referential integrity and universes need no join:
a child's key without the parent's flag violates. Denials of rows need no groups and are flags of any set.

Roots are first counted in hashed buckets, which scans the root columns once more. A bucket of more than a task's
rows holds a root of many rows, or many rows of few roots: its rows make one entry for each set, and these are
counted by set and keys before the shuffle, as are the entries of families without a root. No root is
so taken whole into a task, however many rows it has.

Shared: referential integrity, cardinality without a table of bounds, functional
dependencies, denials of rows, and pair disagreement, whose pairs follow from the counts by its four sets of keys. Other
constraints keep their own plans; the summary is the union of both. Empty tables count zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.hot import TASK_ROWS
from attestra.functions.nulls import condition, holds, nan_to_null
from attestra.operators import constraints as K

#: Whole numbers that may share a key are compared as bigint.
_WHOLE = ("tinyint", "smallint", "int", "bigint")


#: Types that a hash doesn't take; keys of these are no roots.
_UNHASHED = ("map<", "variant", "collate")
#: Hashed buckets that the roots of a family are counted in.
BUCKETS = 1 << 14

#: A column, and how often the keys named it before.
_Key = tuple[str, int]


@dataclass
class _Set:
    """One set of keys: those of its own table, and of others whose rows are flags in it."""

    number: int
    table: str
    keys: list[_Key]
    types: list[str]
    #: The keys that all it tells is taken within.
    anchor: list[_Key]
    #: (table, its key columns, whether its rows are counted, the flags that its rows set).
    feeds: list[tuple[str, list[str], bool, dict[int, Callable[[DataFrame], Column]]]] = field(default_factory=list)
    flags: int = 0

    @property
    def slots(self) -> list[str]:
        return [f"_s{self.number}_{k}" for k in range(len(self.keys))]

    def flag(self, table: str, cols: Sequence[str], when: Callable[[DataFrame], Column], counted: bool) -> Column:
        """A new flag that rows of the table set; given back is how many did in a group."""
        k, self.flags = self.flags, self.flags + 1
        for name, found, own, flags in self.feeds:
            if (name, found, own) == (table, list(cols), counted):
                flags[k] = when
                break
        else:
            self.feeds.append((table, list(cols), counted, {k: when}))
        return F.col(f"_f{self.number}_{k}")

    @property
    def known(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in self.slots], F.lit(True))


@dataclass
class _Feed:
    """Rows of a table as entries of a family: the columns of its keys, the sets they are for, the flags they set."""

    table: str
    cols: dict[_Key, str]
    counted: bool
    sets: list[_Set]
    flags: dict[int, Callable[[DataFrame], Column]]


class _Family:
    """Sets of one table with a root in common; their entries share slots and flags."""

    def __init__(self, number: int, sets: Sequence[_Set], root: Sequence[_Key]):
        self.number, self.sets, self.root = number, list(sets), list(root)
        self.types = {k: t for s in sets for k, t in zip(s.keys, s.types)}
        rest = [k for k in self.types if k not in self.root]
        self.slots = _named("r", self.root, self.types) | _named("k", rest, self.types)
        own = _Feed(sets[0].table, {k: k[0] for k in self.types}, True, self.sets, {})
        self.feeds = [own]
        #: By the names that the sets know them by: the entry's flags.
        self.flags: dict[str, str] = {}
        n = 0
        for s in sets:
            for table, cols, counted, flags in s.feeds:
                feed = own if counted else _Feed(table, dict(zip(s.keys, cols)), False, [s], {})
                if not counted:
                    self.feeds.append(feed)
                for k, when in flags.items():
                    same = [j for j, w in feed.flags.items() if w is when]
                    at, n = (same[0], n) if same else (n, n + 1)
                    feed.flags[at] = when
                    self.flags[f"_f{s.number}_{k}"] = f"_f{at}"
        self.width = n

    def typed(self, part: str) -> dict[str, str]:
        """Slots of the root ("r") or of the rest ("k"), with their types."""
        return {n: self.types[k] for k, n in self.slots.items() if n.startswith(f"_{part}")}


def _named(prefix: str, keys: Sequence[_Key], types: dict[_Key, str]) -> dict[_Key, str]:
    of = [types[k] for k in keys]
    return {k: f"_{prefix}{of[:i].count(of[i])}_" + "".join(ch if ch.isalnum() else "_" for ch in of[i]) for i, k in enumerate(keys)}


class Suite:
    """The constraints that share, collected by constraint; then `counts()`."""

    def __init__(self, constraints: Sequence[K.Constraint], tables: K.Tables):
        self.names = list(dict.fromkeys(n for c in constraints for n in _tables_of(c)))
        self.tables = {n: nan_to_null(tables[n]) for n in self.names}
        self.sets: dict[tuple, _Set] = {}
        #: By set: what its groups add to a constraint: (number, checked, violations, best, the keys that best is taken within).
        self.adds: dict[int, list[tuple[int, Column, Column, Column, list[_Key]]]] = {}
        self.rows: list[tuple[int, K.DenialConstraint]] = []
        self.own: list[int] = []
        self.shared: list[int] = []
        for k, c in enumerate(constraints):
            take = getattr(self, f"_take_{type(c).__name__}", None)
            (self.shared if take and take(k, c) else self.own).append(k)
        for k, c in self.rows:  # they add up over the groups of any set
            s = min((s for s in self.sets.values() if s.table == c.left), key=lambda s: (not s.keys, len(s.keys)), default=None) or self._set(c.left, [])
            self._add(s, k, F.col("_n"), s.flag(c.left, [n for n, _ in s.keys], lambda df, c=c: holds(condition(df, c.predicate)), True))

    # Sets and what their groups tell -----------------------------------------------

    def _type(self, table: str, col: str) -> str:
        found = self.tables[table].schema[col].dataType.simpleString()
        return "bigint" if found in _WHOLE else found

    def _set(self, table: str, cols: Sequence[str]) -> _Set:
        found = (table, tuple(cols))
        if found not in self.sets:
            keys = [(c, list(cols[:k]).count(c)) for k, c in enumerate(cols)]
            self.sets[found] = _Set(len(self.sets), table, keys, [self._type(table, c) for c in cols], keys, [(table, list(cols), True, {})])
        return self.sets[found]

    def _add(self, s: _Set, k: int, checked: Column, violations: Column, best: Column | None = None, within: Sequence[_Key] = ()) -> None:
        whole = lambda c: c.cast("bigint")
        self.adds.setdefault(s.number, []).append((k, whole(checked), whole(violations), whole(F.lit(None) if best is None else best), list(within)))

    def _take_DenialConstraint(self, k: int, c: K.DenialConstraint) -> bool:
        if c.right is not None:
            return False
        self.rows.append((k, c))
        return True

    def _take_Cardinality(self, k: int, c: K.Cardinality) -> bool:
        if c.bounds_table or (c.universe_table and [self._type(c.universe_table, g) for g in c.group_cols] != [self._type(c.table, g) for g in c.group_cols]):
            return False
        s = self._set(c.table, c.group_cols)
        n = F.col("_n") if c.row_filter is None else s.flag(c.table, c.group_cols, lambda df: holds(condition(df, c.row_filter)), True)
        there = (F.col("_n") if c.universe_table is None else s.flag(c.universe_table, c.group_cols, lambda df: F.lit(True), False)) > 0
        tests = {"exact": lambda b: n != b, "min": lambda b: n < b, "max": lambda b: n > b}
        broken = reduce(lambda a, b: a | b, [tests[t](b) for t, b in c.bounds.items()])
        self._add(s, k, there, there & broken)
        return True

    def _take_ReferentialIntegrity(self, k: int, c: K.ReferentialIntegrity) -> bool:
        if [self._type(c.child, a) for a in c.fk_cols] != [self._type(c.parent, b) for b in c.pk_cols]:
            return False
        s = self._set(c.child, c.fk_cols)
        found = s.flag(c.parent, c.pk_cols, lambda df: F.lit(True), False) > 0
        n = F.when(s.known, F.col("_n")).otherwise(0) if c.nullable else F.col("_n")
        self._add(s, k, n, F.when(found, 0).otherwise(n))
        return True

    def _take_FunctionalDependency(self, k: int, c: K.FunctionalDependency) -> bool:
        if c.dependent in c.determinant:
            return False
        s = self._set(c.table, [*c.determinant, c.dependent])
        *within, _ = s.keys
        value = s.slots[-1]
        s.anchor = [k for k in s.anchor if k in within]
        # Violations: all rows of a determinant but those of its commonest value; `best` is subtracted at the end.
        self._add(s, k, F.col("_n"), F.col("_n"), F.when(F.col(value).isNotNull(), F.col("_n")), within)
        return True

    def _take_PairDisagreement(self, k: int, c: K.PairDisagreement) -> bool:
        g, i, v = c.group_cols, c.id_col, c.value_col
        if i in g or v in g or i == v:
            return False
        two = lambda n: n * (n - 1) / 2
        named = lambda df: df[f"`{i}`"].isNotNull()
        # All pairs, less those of one id, are checked; less those of one value, but for one id's, they violate.
        for cols, sign, value in (([*g], 1, False), ([*g, i], -1, False), ([*g, v], -1, True), ([*g, i, v], 1, True)):
            s = self._set(c.table, cols)
            pairs = two(s.flag(c.table, cols, named, True)) * sign
            if value:
                self._add(s, k, F.lit(0), F.when(F.col(s.slots[-1]).isNotNull(), pairs).otherwise(0))
            else:
                self._add(s, k, pairs, pairs)
        return True

    # The plan ----------------------------------------------------------------------

    def _families(self) -> list[_Family]:
        """Each set in the first family whose root all it tells is taken within; those without a root alone."""
        hashed = lambda s: all(not any(u in s.types[s.keys.index(k)] for u in _UNHASHED) for k in s.anchor)
        dealt: list[tuple[str, list[_Key], list[_Set]]] = []
        for s in sorted(self.sets.values(), key=lambda s: len(s.anchor)):
            home = next((sets for table, root, sets in dealt if table == s.table and root and set(root) <= set(s.anchor)), None)
            if home is None:
                dealt.append((s.table, s.anchor if hashed(s) else [], [s]))
            else:
                home.append(s)
        return [_Family(k, sets, root) for k, (_, root, sets) in enumerate(dealt)]

    def _entries(self, families: Sequence[_Family], slots: dict[str, str], flags: int | None, by_set: bool) -> DataFrame:
        """The tables' rows, each once for every family, or set of it, that it is in; of these slots, without counts if flags is None."""
        parts = []
        for table, df in self.tables.items():
            out = []
            for f in families:
                for feed in (x for x in f.feeds if x.table == table):
                    for s in feed.sets if by_set else [None]:
                        own = {f.slots[k]: c for k, c in feed.cols.items() if s is None or k in s.keys}
                        keys = [(df[f"`{own[n]}`"].cast(t) if n in own else F.lit(None).cast(t)).alias(n) for n, t in slots.items()]
                        counts = [] if flags is None else [F.lit(int(feed.counted)).cast("bigint").alias("_n")]
                        counts += [(feed.flags[k](df).cast("bigint") if k in feed.flags else F.lit(0).cast("bigint")).alias(f"_f{k}") for k in range(flags or 0)]
                        number = [F.lit(s.number).alias("_set")] if s else []
                        out.append(F.struct(F.lit(f.number).alias("_family"), *number, *keys, *counts))
            if out:
                parts.append(df.select(F.inline(F.array(*out))))
        return reduce(DataFrame.unionByName, parts)

    def counts(self) -> DataFrame:
        """(number, n_checked, n_violations) of the constraints that share. Counts entries by buckets of roots at once."""
        families = self._families()
        rooted = [f for f in families if f.root]
        roots = {n: t for f in rooted for n, t in f.typed("r").items()}
        rests = {n: t for f in families for n, t in f.typed("k").items()}
        flags = max(f.width for f in families)
        sums = [F.sum(c).alias(c) for c in ["_n", *[f"_f{k}" for k in range(flags)]]]
        within = {f.slots[k] for f in families for s in f.sets for *_, keys in self.adds[s.number] for k in keys}
        bucket = F.pmod(F.xxhash64(*roots), F.lit(BUCKETS)) if roots else None
        hot: dict[int, list[int]] = {}
        parts = []
        if rooted:
            sizes = self._entries(rooted, roots, None, False).groupBy("_family", bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
            large = F.collect_list(F.when(F.col("_rows") > TASK_ROWS, F.struct("_family", "_bucket")))
            total, found = sizes.agg(F.sum("_rows"), large).first()
            for number, b in found:
                hot.setdefault(number, []).append(b)
            is_hot = reduce(lambda a, b: a | b, [(F.col("_family") == k) & bucket.isin(bs) for k, bs in hot.items()], F.lit(False))
            tasks = max(int(next(iter(self.tables.values())).sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_ROWS))
            dealt = self._entries(rooted, roots | rests, flags, False).where(~is_hot).repartition(tasks, "_family", *roots)
            told_apart = {f.number: F.array(*[F.struct(F.lit(s.number).alias("_set"), *_kept(rests, {f.slots[k] for k in s.keys})) for s in f.sets]) for f in rooted}
            each = dealt.select("_family", *roots, "_n", *[f"_f{k}" for k in range(flags)], F.inline(_case("_family", told_apart)))
            groups = each.groupBy("_family", *roots, "_set", *rests).agg(*sums)
            kept = {n: t for n, t in rests.items() if n in within}
            parts.append(self._sums(groups, rooted, kept, ["_family", *roots]))
        counted_first = [f for f in families if not f.root or f.number in hot]
        if counted_first:
            entries = self._entries(counted_first, roots | rests, flags, True)
            if hot:
                entries = entries.where(is_hot | F.col("_family").isin([f.number for f in families if not f.root]))
            groups = entries.groupBy("_set", *roots, *rests).agg(*sums)
            kept = {n: t for n, t in (roots | rests).items() if n in within}
            parts.append(self._sums(groups, counted_first, kept, []))
        return reduce(DataFrame.unionByName, parts).groupBy("number").agg(F.sum("n_checked").alias("n_checked"), F.sum("n_violations").alias("n_violations"))

    def _sums(self, groups: DataFrame, families: Sequence[_Family], kept: dict[str, str], by: Sequence[str]) -> DataFrame:
        """What the groups tell of each constraint, summed; `best` is taken within the kept slots and those in `by`."""
        names = {slot: f.slots[k] for f in families for s in f.sets for k, slot in zip(s.keys, s.slots)} | {a: b for f in families for a, b in f.flags.items()}
        adds = {
            s.number: F.array(*[
                F.struct(F.lit(k).alias("number"), *_kept(kept, {f.slots[x] for x in within}), checked.alias("checked"), violations.alias("violations"), best.alias("best"))
                for k, checked, violations, best, within in self.adds[s.number]
            ])
            for f in families for s in f.sets
        }
        told = groups.select("*", *[F.col(b).alias(a) for a, b in names.items()]).select(*by, F.inline(_case("_set", adds)))
        sums = told.groupBy(*by, "number", *kept).agg(F.sum("checked").alias("n_checked"), F.sum("violations").alias("violations"), F.max("best").alias("best"))
        return sums.select("number", "n_checked", (F.col("violations") - F.coalesce("best", F.lit(0))).alias("n_violations"))


def _kept(slots: dict[str, str], which: set[str]) -> list[Column]:
    return [(F.col(n) if n in which else F.lit(None).cast(t)).alias(n) for n, t in slots.items()]


def _case(name: str, values: dict[int, Column]) -> Column:
    cases = [(F.col(name) == k, v) for k, v in values.items()]
    return reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0]))


def _tables_of(c: K.Constraint) -> list[str]:
    named = {"DenialConstraint": ("left",), "Cardinality": ("table", "universe_table"), "ReferentialIntegrity": ("child", "parent"), "FunctionalDependency": ("table",), "PairDisagreement": ("table",)}
    return [n for a in named.get(type(c).__name__, ()) if (n := getattr(c, a))]


def summarize_suite(constraints: Sequence[K.Constraint], tables: K.Tables) -> DataFrame:
    """What summarize(run_constraints(...)) gives, from one scan of each table's rows for the constraints that can share."""
    constraints = list(constraints)
    suite = Suite(constraints, tables)
    parts = []
    if suite.shared:
        listed = F.array(*[F.struct(F.lit(k).alias("number"), F.lit(constraints[k].name).alias("name"), F.lit(constraints[k].kind).alias("kind")) for k in suite.shared])
        all_of_them = next(iter(tables.values())).sparkSession.range(1).select(F.inline(listed))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        parts.append(all_of_them.join(F.broadcast(suite.counts()), "number", "left").select("number", "name", "kind", zero("n_checked"), zero("n_violations")))  # a row for each constraint
    parts += [constraints[k].counts(tables).select(F.lit(k).alias("number"), F.lit(constraints[k].name).alias("name"), F.lit(constraints[k].kind).alias("kind"), "n_checked", "n_violations") for k in suite.own]
    whole = reduce(DataFrame.unionByName, parts)
    rate = F.when(F.col("n_checked") > 0, F.col("n_violations") / F.col("n_checked")).otherwise(F.lit(float("nan")))
    return whole.withColumn("violation_rate", rate).orderBy("number").select(*K.SUMMARY)
