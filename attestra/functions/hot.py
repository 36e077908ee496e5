"""Joins with one row for each key, when a key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.nulls import join_same

#: Rows of a task whose hash tables hold most of them.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame) -> int:
    """Shuffle partitions for all rows of df, so many that a task's memory doesn't grow with the table. Counts df at once."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], sizes: DataFrame, how: str = "left") -> DataFrame:
    """rows joined with facts, of which a key has at most one row; missing keys match.

    sizes: (keys, _n) of at least the keys that hold many rows. Keys of more than a share of those are dealt out
    by salts, a hash of the whole row; the list of them has at most 4 * shuffle partitions rows and is broadcast.
    """
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    salts = F.ceil(F.col("_n") * 4 * width / F.lit(max(total, 1))).cast("int")
    hot = sizes.where(F.col("_n") * 4 * width > total).select(*keys, salts.alias("_salts"))
    simple = [f"`{f.name}`" for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    place = F.expr(f"cast(pmod(xxhash64({', '.join(simple)}), coalesce(_salts, 1)) AS int)")
    left = join_same(rows, F.broadcast(hot), keys).withColumn("_salt", place).drop("_salts")
    right = join_same(facts, F.broadcast(hot), keys).withColumn("_salt", F.explode(F.expr("sequence(0, coalesce(_salts, 1) - 1)"))).drop("_salts")
    return join_same(left, right, [*keys, "_salt"], how=how).drop("_salt")
