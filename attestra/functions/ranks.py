"""Ranks over a whole table without a window over the whole table.

Rows are range-partitioned by the order, stored with the number of their partition, and
numbered within it; the partitions' sizes, one row for each, give where each begins. No
task holds more than its range, and rows of one hot value are spread by the tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.sources.shared import store


def global_rank(df: DataFrame, order: Sequence[str], out: str = "rank", total: str | None = None) -> DataFrame:
    """df with its rows numbered from 1 in ascending order, and how many there are if a column is named for it.

    Rows that agree in all of `order` are numbered anyhow.
    """
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = store(dealt, "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    everything = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), *([F.sum("_n").over(everything).alias(total)] if total else []))
    number = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_number", number).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_number")).drop("_part", "_number", "_before")


def bucket_edges(n: int, k: int) -> list[float]:
    """The k - 1 inner quantiles of the ranks 1 to n, interpolated linearly."""
    return [1 + i / k * (n - 1) for i in range(1, k)]
