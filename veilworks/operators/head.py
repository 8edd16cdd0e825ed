"""A linear classifier over given vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine).withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))


def fitted(rows: DataFrame, vector: str, label: str, l2: float = 0.001, steps: int = 200) -> PipelineModel:
    """A softmax head (A21): standardised components, classes weighted to count alike, weights but not the intercept held small by l2.

    label: integers from 0. Rows without a label, or with a null or non-finite component, take no part. All rows
    are read where they are; only gradients reach the driver.
    """
    known = _usable(rows.where(F.col(label).isNotNull()), vector)
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    all_ = Window.partitionBy()  # a row for each class
    weights = counts.select(F.col(label).alias("__label"), (F.sum("__n").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("__n"))).alias("__weight"))
    weighed = known.join(weights, F.col(label) == F.col("__label")).select("__v", F.col(label).cast("double").alias("__y"), "__weight")
    head = LogisticRegression(featuresCol="__z", labelCol="__y", weightCol="__weight", predictionCol="__p", probabilityCol="__ps", rawPredictionCol="__raw", family="multinomial", regParam=l2, standardization=False, maxIter=steps, tol=1e-9)
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=True, inputCol="__v", outputCol="__z"), head]).fit(weighed)


def scored(model: PipelineModel, rows: DataFrame, vector: str) -> DataFrame:
    """rows with predicted and score, the likeliest class and its probability; rows that can't be judged have null in both."""
    judged = model.transform(_usable(rows, vector)).withColumns({"predicted": F.col("__p").cast("int"), "score": F.array_max(vector_to_array("__ps"))})
    rest = rows.where(~F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)))
    none = rest.withColumns({"predicted": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
    return judged.select(*rows.columns, "predicted", "score").unionByName(none)
