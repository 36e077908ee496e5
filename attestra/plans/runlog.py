"""The log of a run: what was checked, how much violated, how long it took, from the jobs that run anyway.

Counts are observed while a constraint's violations are written or otherwise used, so no job counts them
once more. Lines go to the driver's output and, if a path is given, to the end of a file of the driver's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from attestra.operators.constraints import VIOLATES, Constraint, Tables


@dataclass(frozen=True)
class Observed:
    """A constraint's violations, and the counts of the first job that reads them through."""

    name: str
    kind: str
    violations: DataFrame
    observation: Observation

    @property
    def counts(self) -> tuple[int, int]:
        """(n_checked, n_violations). Waits for a job over violations; a job that stops early counts what it saw."""
        found = self.observation.get
        return found["n_checked"], found["n_violations"]


def observed(constraint: Constraint, tables: Tables) -> Observed:
    observation = Observation()
    checked = constraint.checked(tables).observe(observation, F.count(F.lit(1)).alias("n_checked"), F.count_if(VIOLATES).alias("n_violations"))
    return Observed(constraint.name, constraint.kind, checked.where(VIOLATES).drop(VIOLATES), observation)


class RunLog:
    def __init__(self, path: str | None = None, echo: Callable[[str], None] = print):
        self.path, self.echo = path, echo

    def line(self, text: str) -> None:
        self.echo(text)
        if self.path:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S} {text}\n")

    @contextmanager
    def timed(self, what: str) -> Iterator[None]:
        """A line before and one after, with the seconds; a failure is logged and goes on."""
        self.line(f"start {what}")
        began = time.monotonic()
        try:
            yield
        except BaseException as e:
            self.line(f"failed {what} after {time.monotonic() - began:.1f} s: {type(e).__name__}")
            raise
        self.line(f"done {what} ({time.monotonic() - began:.1f} s)")

    def write_violations(self, constraints: Iterable[Constraint], tables: Tables, folder: str) -> dict[str, tuple[int, int]]:
        """Each constraint's violations to folder/name, by one job each, which also counts: (n_checked, n_violations) by name."""
        out = {}
        for c in constraints:
            found, began = observed(c, tables), time.monotonic()
            found.violations.write.mode("overwrite").parquet(f"{folder}/{c.name}")
            out[c.name] = found.counts
            self.line(f"{c.name}: {out[c.name][1]:,} of {out[c.name][0]:,} ({time.monotonic() - began:.1f} s)")
        return out
