"""Where queries over the shared tables are registered, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.operators import constraints as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def constraint(c: K.Constraint, names: tuple[str, ...], counts_sql: str) -> None:
    """Register a constraint's counts; the SQL gives n_checked and n_violations."""
    QUERIES[c.name] = lambda spark, sf_dir: c.check(tables(spark, sf_dir, *names)).counts
    ORACLES[c.name] = counts_sql
