"""Tables and predictions in and out.

A database is a folder with one Parquet file or folder for each table. Predictions are tables
of an entity, a time, the true and the predicted value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StructType

from attestra.functions.nulls import nan_to_null


def read_tables(spark: SparkSession, folder: str, names: Sequence[str], nan_as_null: bool = True) -> dict[str, DataFrame]:
    """The full snapshot: lazy tables by name."""
    found = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    return {n: nan_to_null(df) for n, df in found.items()} if nan_as_null else found


def visible(tables: Mapping[str, DataFrame], time_cols: Mapping[str, str], cutoff) -> dict[str, DataFrame]:
    """What a model may see: rows up to the cut-off, whole tables where no time column is named. The filter reaches the scan."""
    return {n: df.where(F.col(time_cols[n]) <= F.lit(cutoff)) if n in time_cols else df for n, df in tables.items()}


def read_predictions(spark: SparkSession, folder: str, task: str, entity_col: str, time_col: str) -> DataFrame:
    """The task's stored predictions: entity, time, y_true, y_pred; others fail with what is missing."""
    path = f"{folder}/{task}_predictions.parquet"
    df = spark.read.parquet(path)
    expected = [entity_col, time_col, "y_true", "y_pred"]
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}; predictions have {', '.join(expected)}")
    return nan_to_null(df.select(*expected))


def read_split(spark: SparkSession, folder: str, task: str, split: str) -> DataFrame:
    """One split (train, val or test) of a task's instances with their true labels; NaN is missing."""
    return nan_to_null(spark.read.parquet(f"{folder}/{task}/{split}.parquet"))


def read_labelled(df: DataFrame, target: str, positive: str, out: str = "label") -> DataFrame:
    """Numeric features whose negative codes stand for missing values, and the target as 0 or 1 (null if missing)."""
    numeric = [f.name for f in df.schema if f.name != target and isinstance(f.dataType, NumericType)]
    known = df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in numeric})
    return known.withColumn(out, (F.col(target) == positive).cast("int")).drop(*([target] if out != target else []))


def read_log_probabilities(spark: SparkSession, folder: str, task: str, key: str, classes: Sequence[str]) -> DataFrame:
    """(key, log_q as doubles) of a task's stored log probabilities; rows with another number of classes fail the job."""
    path = f"{folder}/{task}_log_proba.parquet"
    df = spark.read.parquet(path)
    missing = [c for c in (key, "log_proba") if c not in df.columns]
    if missing or not isinstance(df.schema["log_proba"].dataType, ArrayType):
        raise ValueError(f"{path} needs {key} and log_proba, an array of numbers")
    wrong = F.size("log_proba") != len(classes)
    checked = df.where(F.when(wrong, F.raise_error(F.lit(f"{path} holds rows without {len(classes)} classes")).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(key, F.col("log_proba").cast("array<double>").alias("log_q"))


def write_log_probabilities(df: DataFrame, folder: str, task: str, key: str, log_q: str = "log_q") -> None:
    df.select(key, F.col(log_q).cast("array<float>").alias("log_proba")).write.mode("overwrite").parquet(f"{folder}/{task}_log_proba.parquet")


def read_nanosecond_times(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Times read as whole nanoseconds (spark.sql.legacy.parquet.nanosAsLong) as timestamps."""
    return df.withColumns({c: F.timestamp_micros(F.expr(f"{c} div 1000")).cast("timestamp_ntz") for c in cols})


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """An earlier result, or None where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.csv(path, header=True, schema=schema)


def write_predictions(df: DataFrame, folder: str, task: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{task}_predictions.parquet")


def write_csv(df: DataFrame, folder: str, label: str) -> str:
    """A summary as one CSV file in a folder named for it, blanks as underscores."""
    path = str(PurePosixPath(folder) / label.replace(" ", "_")) if "://" not in folder else f"{folder}/{label.replace(' ', '_')}"
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)  # summaries have a row for each constraint
    return path
