"""Classifiers behind one interface, fitted and applied by Spark: predictions, log probabilities, counterfactuals.

Categories are indexed by what the training rows hold; others, and missing ones, share a place of their own.
Missing numbers become the training mean beside a column that says so. Predictions come as rows (entity, time,
y_true, y_pred), or with the log probability of each class, taken from the raw scores where these have it, so that
unlikely classes don't round to zero. Original and changed rows are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.nulls import nan_to_null

#: Estimators by name; each gives a score or a probability for every class.
ESTIMATORS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}
_P = "_m_"


@dataclass(frozen=True)
class Adapter:
    """What is fitted: categorical and numeric columns, the target, an estimator by name and its parameters."""

    target: str
    categorical: Sequence[str] = ()
    numeric: Sequence[str] = ()
    estimator: str = "logistic"
    params: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.estimator not in ESTIMATORS:
            raise ValueError(f"the estimator is one of {', '.join(ESTIMATORS)}")
        if not self.categorical and not self.numeric:
            raise ValueError("a model needs features")

    def _inputs(self, df: DataFrame) -> DataFrame:
        """df with the columns that the stages read: categories as text, numbers as doubles and whether they are missing."""
        df = nan_to_null(df)
        texts = {f"{_P}c{k}": F.col(f"`{c}`").cast("string") for k, c in enumerate(self.categorical)}
        numbers = {f"{_P}n{k}": F.col(f"`{c}`").cast("double") for k, c in enumerate(self.numeric)}
        missing = {f"{_P}x{k}": F.col(f"`{c}`").isNull().cast("double") for k, c in enumerate(self.numeric)}
        return df.withColumns(texts | numbers | missing)

    def fit(self, train: DataFrame) -> FittedModel:
        """Rows without a target don't count. An all-missing number is zero."""
        rows = self._inputs(train.where(F.col(f"`{self.target}`").isNotNull())).withColumn(_P + "y", F.col(f"`{self.target}`").cast("string"))
        c, n = [f"{_P}c{k}" for k in range(len(self.categorical))], [f"{_P}n{k}" for k in range(len(self.numeric))]
        stages: list[Any] = []
        features = [f"{_P}x{k}" for k in range(len(self.numeric))]
        if c:
            stages += [StringIndexer(inputCols=c, outputCols=[x + "i" for x in c], handleInvalid="keep"), OneHotEncoder(inputCols=[x + "i" for x in c], outputCols=[x + "v" for x in c], handleInvalid="keep")]
            features += [x + "v" for x in c]
        if n:
            means = rows.agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in n]).first().asDict()
            features += n
        else:
            means = {}
        labels = StringIndexer(inputCol=_P + "y", outputCol=_P + "label", stringOrderType="alphabetAsc").fit(rows)
        stages.append(VectorAssembler(inputCols=features, outputCol=_P + "features"))
        more = {"family": "multinomial"} if self.estimator == "logistic" else {}
        model = ESTIMATORS[self.estimator](featuresCol=_P + "features", labelCol=_P + "label", predictionCol=_P + "at", **{**more, **self.params})
        model.setRawPredictionCol(_P + "raw").setProbabilityCol(_P + "p")
        fitted = Pipeline(stages=[*stages, model]).fit(labels.transform(rows.na.fill(means) if means else rows))
        return FittedModel(self, fitted, tuple(labels.labels), means, rows.schema[self.target].dataType.simpleString())

    def fit_predict(self, train: DataFrame, test: DataFrame, entity: str, time: str) -> DataFrame:
        """(entity, time, y_true, y_pred) for each row of test."""
        return self.fit(train).predict(test).select(entity, time, F.col(f"`{self.target}`").alias("y_true"), "y_pred")


@dataclass(frozen=True)
class FittedModel:
    adapter: Adapter
    stages: PipelineModel
    classes: tuple[str, ...]
    means: dict[str, float]
    target_type: str

    def _log_q(self) -> Column:
        if self.adapter.estimator == "logistic":
            raw = vector_to_array(_P + "raw")
            most = F.array_max(raw)
            total = most + F.log(F.aggregate(raw, F.lit(0.0), lambda s, x: s + F.exp(x - most)))
            return F.transform(raw, lambda x: x - total)
        return F.transform(vector_to_array(_P + "p"), lambda p: F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf"))))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with y_pred, of the target's type, and log_q, the log probabilities of `classes` in their order."""
        names = df.columns
        rows = self.adapter._inputs(df)
        scored = self.stages.transform(rows.na.fill(self.means) if self.means else rows)
        classes = F.array(*[F.lit(c) for c in self.classes])
        # The first of the likeliest classes.
        scored = scored.withColumn("log_q", self._log_q()).withColumn("y_pred", F.element_at(classes, F.array_position("log_q", F.array_max("log_q")).cast("int")).cast(self.target_type))
        return scored.select(*[f"`{n}`" for n in names], "y_pred", "log_q")

    def counterfactuals(self, df: DataFrame, id_col: str, positive: str, changes: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        """(id, variant, y_pred): the probability of a class for each row as it is (variant original) and with each change's columns.

        Each row is expanded and all variants are scored in one pass. A change is taken where all that it sets is known.
        """
        used = list(dict.fromkeys([*self.adapter.categorical, *self.adapter.numeric]))
        if positive not in self.classes:
            raise ValueError(f"the classes are {', '.join(self.classes)}")

        def variant(name: str, new: Mapping[str, Column]) -> Column:
            fields = [new.get(c, F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) for c in used]
            known = F.lit(True)
            for c in new.values():
                known = known & c.isNotNull()
            return F.when(known, F.struct(F.lit(name).alias("variant"), *fields))

        every = [variant("original", {}), *[variant(n, c) for n, c in changes.items()]]
        expanded = df.select(F.col(f"`{id_col}`").alias("_id"), F.explode(F.filter(F.array(*every), lambda v: v.isNotNull())).alias("_v")).select("_id", "_v.*")
        p = F.exp(F.element_at("log_q", self.classes.index(positive) + 1))
        return self.predict(expanded).select(F.col("_id").alias(id_col), "variant", p.alias("y_pred"))
