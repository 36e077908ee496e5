"""Audits: constraints over a database, their summary, and a report."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.nulls import as_list, join_same
from attestra.operators.constraints import Constraint, Tables, ViolationResult, run_constraints, summarize
from attestra.operators.metrics import instance_violation_flags, violation_error_correlation
from attestra.sources.tables import write_csv


def run_audit(constraints: Iterable[Constraint], tables: Tables, folder: str | None = None, label: str = "violation rates") -> tuple[list[ViolationResult], DataFrame]:
    """The results and their summary, which goes to a CSV in the folder if one is given."""
    results = run_constraints(constraints, tables)
    summary = summarize(results)
    if folder:
        write_csv(summary, folder, label)
    return results, summary


def tier_of(name: str, second_tier: Iterable[str]) -> int:
    """1: rules that hold by definition of the data; 2: conventions of a trade, listed by name."""
    return 2 if name in set(second_tier) else 1


def tier1_only(constraints: Iterable[Constraint], second_tier: Iterable[str]) -> list[Constraint]:
    second = set(second_tier)
    return [c for c in constraints if c.name not in second]


def _cell(x) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "n/a"
    if isinstance(x, float):
        return f"{x:.4%}"
    return f"{x:,}" if isinstance(x, int) else str(x)


def markdown_table(rows: Sequence[Mapping]) -> str:
    if not rows:
        return "not run"
    names = list(dict.fromkeys(n for r in rows for n in r))
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r.get(n)) for n in names) + " |" for r in rows])


def findings(title: str, sections: Mapping[str, DataFrame | None]) -> str:
    """A report of small tables: one section each, "not run" where there is none."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        parts += [f"## {name}", markdown_table([r.asDict() for r in df.collect()] if df is not None else [])]
    return "\n\n".join(parts) + "\n"


def audit_predictions(checks: Mapping[str, tuple[Constraint, Tables, Sequence[str]]], instances: DataFrame, error: Column) -> DataFrame:
    """A row for each check of predictions: name, kind, counts, rate, and the correlation of its flags with the instances' error.

    checks: by name a constraint, its tables, and the columns that lead from its violations to the instances.
    """
    rows = []
    for name, (constraint, tables, keys) in checks.items():
        result = constraint.check(tables)
        flagged = instance_violation_flags(result, instances.withColumn("_error", error), list(keys))
        correlation = violation_error_correlation(flagged, "violates", "_error").withColumn("name", F.lit(name))
        rows.append(result.summary.withColumn("name", F.lit(name)).join(correlation, "name"))
    return reduce(DataFrame.unionByName, rows)


def run_tasks(tasks: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables of the tasks that work, and for each of the others what went wrong."""
    done, failed = {}, {}
    for name, task in tasks.items():
        try:
            done[name] = task()
            done[name].schema  # noqa: B018  analysed now, so a missing column counts as this task's failure
        except Exception as e:  # noqa: BLE001  one task's failure doesn't end the others
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    return done, failed


def write_failed(failed: Mapping[str, str], spark, folder: str) -> str | None:
    """A CSV of the failed tasks, if any failed."""
    if not failed:
        return None
    return write_csv(spark.createDataFrame(sorted(failed.items()), "task string, error string"), folder, "failed tasks")


def compare_runs(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Two runs of one task on their common keys: n, n_changed, a_right, b_right. Runs: the keys, y_true, y_pred."""
    keys = as_list(keys)
    other = b.select(*[F.col(k) for k in keys], F.col("y_pred").alias("_b"))
    both = join_same(a.select(*keys, "y_true", "y_pred"), other, keys, how="inner")
    return both.agg(
        F.count("*").alias("n"), F.count_if(~F.col("y_pred").eqNullSafe(F.col("_b"))).alias("n_changed"),
        F.count_if(F.col("y_pred") == F.col("y_true")).alias("a_right"), F.count_if(F.col("_b") == F.col("y_true")).alias("b_right"),
    )


def tier_report(title: str, summary: DataFrame, second_tier: Iterable[str], provenance: Mapping[str, str], notes: Sequence[str] = ()) -> str:
    """Rules that hold by definition first, conventions apart, with where the data comes from and what to note."""
    rows = [r.asDict() for r in summary.collect()]  # a row for each constraint
    second = set(second_tier)
    parts = [f"# {title}", "## Provenance", "\n".join(f"- {k}: {v}" for k, v in provenance.items())]
    for tier, name in ((1, "Rules by definition"), (2, "Conventions")):
        parts += [f"## {name}", markdown_table([r for r in rows if tier_of(r["name"], second) == tier])]
    return "\n\n".join(parts + (["## Notes", "\n".join(f"- {n}" for n in notes)] if notes else [])) + "\n"


def decoding_report(evaluation, significance: Sequence[Mapping] = ()) -> dict[str, str]:
    """The report of an evaluation of decoders as texts by file name: two tables as CSV, everything as JSON and markdown."""
    tables = {"items": [r.asDict() for r in evaluation.item_table().collect()], "orders": [r.asDict() for r in evaluation.order_table().collect()]}  # a row for each method
    plain = lambda x: None if isinstance(x, float) and not math.isfinite(x) else x
    csv = lambda rows: "\n".join([",".join(rows[0]), *[",".join("" if v is None else str(v) for v in r.values()) for r in rows]]) + "\n"
    whole = {n: [{k: plain(v) for k, v in r.items()} for r in rows] for n, rows in [*tables.items(), ("significance", significance), ("folds", evaluation.folds)]}
    text = "\n\n".join(["# Decoders", "## Items", markdown_table(tables["items"]), "## Orders", markdown_table(tables["orders"]), "## Significance", markdown_table(list(significance))]) + "\n"
    return {"items.csv": csv(tables["items"]), "orders.csv": csv(tables["orders"]), "report.json": json.dumps(whole, indent=1), "report.md": text}
