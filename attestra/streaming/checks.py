"""Row checks on a stream: an extension beside the batch constraints.

Unary denial constraints need no state, so they run on each row as it comes; their counts by
event-time window wait for late rows as long as the watermark says.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.nulls import Condition, condition, holds


def violating_rows(stream: DataFrame, checks: Mapping[str, Condition]) -> DataFrame:
    """Each row once for each check that it violates, with the check's name as `violated`."""
    names = F.array(*[F.when(holds(condition(stream, c)), F.lit(n)) for n, c in checks.items()])
    return stream.withColumn("violated", F.explode(F.array_compact(names)))


def windowed_rates(stream: DataFrame, time_col: str, checks: Mapping[str, Condition], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window: n_checked and one count for each check."""
    marked = stream.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    counts = [F.count_if(holds(condition(stream, c))).alias(n) for n, c in checks.items()]
    return marked.groupBy(F.window("_t", width)).agg(F.count("*").alias("n_checked"), *counts).select("window.start", "window.end", "n_checked", *checks)
