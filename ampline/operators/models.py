"""Regression forecasters with strictly temporal splits."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipeline(kind: str, numeric: list[str], category: str | None = None, label: str = "actual", reg: float = 0.0, trees: int = 30, depth: int = 8, bins: int = 24, seed: int = 42) -> Pipeline:
    """Index, encode, assemble, regress. kind: "linear" (ridge with reg > 0) or "forest"; unseen categories have a slot of their own."""
    stages, inputs = [], list(numeric)
    if category:
        stages.append(StringIndexer(inputCol=category, outputCol="__index", handleInvalid="keep"))
        if kind == "linear":
            stages.append(OneHotEncoder(inputCols=["__index"], outputCols=["__hot"]))
        inputs.append("__hot" if kind == "linear" else "__index")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__features"))
    common = {"featuresCol": "__features", "labelCol": label, "predictionCol": "prediction"}
    if kind == "linear":
        stages.append(LinearRegression(regParam=reg, elasticNetParam=0.0, maxIter=100, **common))
    else:
        stages.append(RandomForestRegressor(numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, **common))
    return Pipeline(stages=stages)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions beside all keys and columns."""
    return model.transform(df).drop("__index", "__hot", "__features")


def metrics(predicted: DataFrame, label: str = "actual") -> dict[str, float]:
    return {m: RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=m).evaluate(predicted) for m in ("rmse", "mae", "r2")}


def tune_ridge(train: DataFrame, validation: DataFrame, numeric: list[str], category: str | None, grid: tuple = (0.01, 0.1, 1.0, 10.0), label: str = "actual") -> tuple[float, list[tuple[float, float]]]:
    """The penalty of the least validation RMSE, and all results; a few values, so the loop is on the driver."""
    train.persist()
    results = [(reg, metrics(score(pipeline("linear", numeric, category, label, reg).fit(train), validation), label)["rmse"]) for reg in grid]
    train.unpersist()
    return min(results, key=lambda r: (r[1], r[0]))[0], results


def refit_ridge(train: DataFrame, test: DataFrame, reg: float, numeric: list[str], category: str | None, label: str = "actual") -> tuple[PipelineModel, DataFrame]:
    """The model of a chosen penalty, fitted on the whole training span, and its predictions for the test span."""
    model = pipeline("linear", numeric, category, label, reg).fit(train)
    return model, score(model, test)


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline in a folder that the cluster shares; one that is there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def metrics_frame(predicted: DataFrame, model: str, label: str = "actual", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R² as one row of plain aggregates."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    return predicted.agg(F.lit(model).alias("model"), F.count("*").alias("records"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"))
