"""What the text operators share: words, tables in the shared folder, group keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sources.shared import discard, new_path, scratch, shared_dir, store  # noqa: F401  the operators' own use

#: White space that separates words: the ASCII blank and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(*cols: str | Column, into: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(into)).cast("int")


def salted(df: DataFrame, into: int, name: str = "salt") -> DataFrame:
    """Every row once for each salt: the small side of a salted join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(into - 1))))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, by: str, counts: DataFrame) -> DataFrame:
    """rows joined with facts, one for each key; keys of more than a share of the rows are dealt out by salts of `by`.

    counts: (key, n) of at least the frequent keys. The list of hot keys, at most 4 * shuffle
    partitions, is broadcast.
    """
    width = shuffle_width(rows.sparkSession)
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1)
    hot = F.broadcast(counts.where(F.col("n") * 4 * width > total).select(key, F.ceil(F.col("n") * 4 * width / F.lit(total)).cast("int").alias("salts")))
    left = rows.join(hot, key, "left").withColumn("salt", F.expr(f"cast(pmod(xxhash64({by}), coalesce(salts, 1)) AS int)")).drop("salts")
    right = facts.join(hot, key, "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")
