"""Missing values, as constraints see them: NaN is missing, and missing keys match each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A condition over a table: a column, an SQL string, or a function from the table to a column.
Condition = Column | str | Callable[[DataFrame], Column]


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """df with NaN as NULL in its float columns, or in those of `cols` that are."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float") and (cols is None or f.name in cols)]
    return df.withColumns({c: F.when(~F.isnan(df[f"`{c}`"]), df[f"`{c}`"]) for c in floats}) if floats else df


def condition(df: DataFrame, c: Condition) -> Column:
    if isinstance(c, str):
        return F.expr(c)
    return c(df) if callable(c) and not isinstance(c, Column) else c


def holds(c: Column) -> Column:
    """The condition, with false where it is unknown."""
    return F.coalesce(c, F.lit(False))


def keyed(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """df with its key columns renamed prefix0, prefix1, ..."""
    return df.withColumnsRenamed({c: f"{prefix}{k}" for k, c in enumerate(cols)})


def same_keys(left: DataFrame, cols: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of left's columns with the ones that keyed() has renamed."""
    return reduce(lambda a, b: a & b, [left[f"`{c}`"].eqNullSafe(F.col(f"{prefix}{k}")) for k, c in enumerate(cols)])


def join_same(left: DataFrame, right: DataFrame, cols: Sequence[str], right_cols: Sequence[str] | None = None, how: str = "left") -> DataFrame:
    """Join on keys of which missing ones match; right's key columns don't come along."""
    right_cols = list(right_cols or cols)
    other = keyed(right, right_cols, "_key")
    out = left.join(other, same_keys(left, cols, "_key"), how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_key{k}" for k in range(len(right_cols))])
