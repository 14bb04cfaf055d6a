"""Forecast quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.functions.scalars import improvement_percent


def _sums(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count(error).alias("_n"),
        F.sum(F.abs(error)).alias("_abs"),
        F.sum(error * error).alias("_sq"),
        (F.var_pop(actual) * F.count(actual)).alias("_spread"),
    )


def _r2() -> Column:
    """1 - residual / spread; a constant actual scores 1 if met exactly, else 0."""
    flat = F.when(F.col("_sq") == 0, 1.0).otherwise(0.0)
    score = F.when(F.col("_spread") == 0, flat).otherwise(1 - F.col("_sq") / F.col("_spread"))
    return F.when(F.col("_n") >= 2, score)


def module_metrics(
    df: DataFrame, by: list[str] = ["module"], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """MAE, RMSE and R² of each module."""
    return _sums(df, by, actual, predicted).select(
        *by,
        (F.col("_abs") / F.col("_n")).alias("mae"),
        F.sqrt(F.col("_sq") / F.col("_n")).alias("rmse"),
        _r2().alias("r2"),
    )


def regression_metrics(
    df: DataFrame, by: list[str] = ["module"], within: list[str] = [],
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    """Pooled MAE and RMSE, and the plain mean of the modules' R².

    ``within`` names groups scored separately, such as the model.
    """
    per_module = _sums(df, [*within, *by], actual, predicted).withColumn("_r2", _r2())
    return per_module.groupBy(*within).agg(
        (F.sum("_abs") / F.sum("_n")).alias("mae"),
        F.sqrt(F.sum("_sq") / F.sum("_n")).alias("rmse"),
        F.avg("_r2").alias("r2"),
    )


def compare_models(scores: DataFrame, baseline: str = "Persistence") -> DataFrame:
    """Scores per model against the baseline, best MAE first."""
    base = F.max(F.when(F.col("model") == baseline, F.col("mae"))).over(Window.partitionBy())
    return (
        scores.withColumn("_base", base)
        .filter(F.col("_base").isNotNull())
        .select(
            "model", "mae", "rmse", "r2",
            improvement_percent(F.col("_base"), F.col("mae")).alias("improvement_percent"),
            (F.col("mae") < F.col("_base")).alias("beats_baseline"),
        )
        .orderBy("mae", "model")
    )


def forecast_scores(df: DataFrame, predicted: dict[str, str], actual: str = "actual") -> DataFrame:
    """Score the forecasts of several models that stand side by side, in one scan.

    ``predicted`` maps a model's name to its column.
    """
    rows = [
        F.struct(F.lit(name).alias("model"), F.col(actual).alias("actual"), F.col(c).alias("predicted"))
        for name, c in predicted.items()
    ]
    return regression_metrics(df.select("module", F.inline(F.array(*rows))), within=["model"])


def model_scores(pairs_by_model: dict[str, DataFrame]) -> DataFrame:
    """The same for models whose ``module, actual, predicted`` rows are tables of their own."""
    rows = [df.withColumn("model", F.lit(name)) for name, df in pairs_by_model.items()]
    return regression_metrics(reduce(DataFrame.unionByName, rows), within=["model"])


def missing_values(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """A19."""
    def missing(columns: list[str]) -> Column:
        return sum((F.count_if(F.col(c).isNull() | F.isnan(c)) for c in columns), F.lit(0))

    return df.agg(
        missing(features).alias("missing_features"), missing(targets).alias("missing_targets")
    )
