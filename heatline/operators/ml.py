"""One regressor per module on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.operators.metrics import model_scores
from heatline.operators.scale import evenly, stored
from heatline.schema import CADENCE_SECONDS, HORIZON_SECONDS, MODULES, TARGETS
from heatline.session import shared_folder

_VECTOR = "_features"
_BIN = "_bin_"
_FAR = float("inf")
#: Bins of a binned input: as many as Spark's trees tell apart by default.
BINS = 32
#: Fits that run side by side; each keeps a copy of the binned rows on the executors.
SIDE_BY_SIDE = 8
#: Rows a fit reads per part: scanning them should outweigh what a part costs in every job.
ROWS_PER_PART = 50_000


def linear_regression() -> LinearRegression:
    """M3: ordinary least squares."""
    return LinearRegression(regParam=0.0, standardization=True)


def boosted_trees(iterations: int = 250) -> GBTRegressor:
    """M4: 250 small steps on rows and columns sampled at 85 %."""
    return GBTRegressor(
        maxIter=iterations, stepSize=0.05, maxDepth=6, minInstancesPerNode=3,
        subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=42,
    )


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Cut points of every input at its quantiles, open at both ends, from one scan.

    Quantiles are off by a tenth of a bin at most. NULL and NaN have no part in them; an
    input without any is cut at 0.
    """
    shares = [k / bins for k in range(1, bins)]
    names = [f"c{j}" for j in range(len(features))]
    known = [F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None)).alias(n) for f, n in zip(features, names)]
    cuts = df.select(*known).approxQuantile(names, shares, 1 / (10 * bins))
    inside = [sorted({c + 0.0 for c in found if abs(c) < _FAR}) for found in cuts]
    return [[-_FAR, *(found or [0.0]), _FAR] for found in inside]


def binning(df: DataFrame, features: list[str], bins: int = BINS) -> Bucketizer:
    """A stage that replaces every input by the number of its bin; NaN has a bin of its own."""
    return Bucketizer(
        splitsArray=bin_edges(df, features, bins), inputCols=features,
        outputCols=[f"{_BIN}{j}" for j in range(len(features))], handleInvalid="keep",
    )


def fit_per_target(
    df: DataFrame, features: list[str], targets: list[str] = TARGETS,
    modules: list[str] = MODULES, estimator: Callable[[], Estimator] = linear_regression,
    bins: int | None = None, side_by_side: int = SIDE_BY_SIDE,
) -> PipelineModel:
    """M3, M4, M6: one pipeline adding ``Predicted_<module>`` for every target.

    The rows are assembled, and with ``bins`` binned, once for all targets, and kept
    in the shared folder. The fits then run side by side over that one table: a round of
    trees is a row of short jobs, so one fit alone leaves most of a cluster idle. For the
    same reason the table has as many parts as its rows call for, none of them empty.
    """
    stages = [binning(df, features, bins)] if bins else []
    inputs = stages[0].getOutputCols() if bins else features
    stages.append(VectorAssembler(inputCols=inputs, outputCol=_VECTOR))
    # Boosting cuts its lineage every few rounds where there is a checkpoint folder.
    shared_folder(df.sparkSession)
    rows = PipelineModel(stages=stages).transform(df).select(
        _VECTOR, *[F.col(f"`{t}`").cast("double").alias(t) for t in targets]
    )
    # Kept by partition, so that every fit, and every rerun, samples the same rows.
    rows = stored(evenly(rows, ROWS_PER_PART))

    def fit(module: str, target: str) -> Transformer:
        return (
            estimator()
            .setFeaturesCol(_VECTOR)
            .setLabelCol(target)
            .setPredictionCol(f"Predicted_{module}")
            .fit(rows)
        )

    with ThreadPoolExecutor(side_by_side) as pool:
        # Each fit takes the session's local properties along; results stay in order.
        started = [
            pool.submit(inheritable_thread_target(df.sparkSession)(fit), module, target)
            for module, target in zip(modules, targets)
        ]
        fitted = [one.result() for one in started]
    return PipelineModel(stages=[*stages, *fitted])


def inputs_of(model: PipelineModel) -> list[str]:
    """Input columns of a pipeline, in order."""
    return list(model.stages[0].getInputCols())


def _regressors(model: PipelineModel) -> list[Transformer]:
    return [s for s in model.stages if s.hasParam("predictionCol")]


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Forecasts beside the input; works on a stream too."""
    made = [c for s in model.stages if isinstance(s, Bucketizer) for c in s.getOutputCols()]
    return model.transform(df).drop(_VECTOR, *made)


def module_forecasts(
    scored: DataFrame, keep: list[str], modules: list[str] = MODULES
) -> DataFrame:
    """One scored row to one forecast row per module."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("module"),
                F.col(m).cast("double").alias("current_temperature"),
                F.col(f"Predicted_{m}").cast("double").alias("predicted_temperature"),
            )
            for m in modules
        ]
    )
    return scored.select(*keep, F.inline(rows))


def importances(
    spark: SparkSession, model: PipelineModel, module: str = MODULES[0], n: int | None = None
) -> DataFrame:
    """Features of one module's trees by importance; all, or the first ``n``."""
    trees = next(s for s in _regressors(model) if s.getPredictionCol() == f"Predicted_{module}")
    pairs = [(f, float(v)) for f, v in zip(inputs_of(model), trees.featureImportances.toArray())]
    ranked = spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
    return ranked.limit(n) if n else ranked


def metadata(
    features: list[str], scores: dict[str, float], targets: list[str] = TARGETS,
    cadence_seconds: int = CADENCE_SECONDS, horizon_seconds: int = HORIZON_SECONDS,
    name: str = "GBTRegressor",
) -> dict:
    """M8: what a scorer must know about the model."""
    return {
        "model": name,
        "sampling_seconds": cadence_seconds,
        "prediction_horizon_seconds": horizon_seconds,
        "prediction_horizon_minutes": horizon_seconds / 60,
        "targets": targets,
        "feature_count": len(features),
        "feature_columns": features,
        **scores,
    }


def save_model(spark: SparkSession, model: PipelineModel, facts: dict, path: str) -> None:
    """Model and metadata side by side."""
    model.write().overwrite().save(f"{path}/model")
    row = spark.createDataFrame([(json.dumps(facts),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """S14."""
    facts = json.loads(spark.read.text(f"{path}/metadata").head()[0])
    return PipelineModel.load(f"{path}/model"), facts


def check_model(
    model: PipelineModel, facts: dict, sample: DataFrame, original: PipelineModel | None = None
) -> None:
    """M9: a reloaded model agrees with its metadata and scores every row, as the original does if given."""
    features = inputs_of(model)
    if features != list(facts["feature_columns"]) or len(features) != facts["feature_count"]:
        raise ValueError("Model inputs differ from the metadata.")
    if facts["prediction_horizon_seconds"] <= 0 or facts["sampling_seconds"] <= 0:
        raise ValueError("Horizon and cadence must be positive.")
    outputs = [s.getPredictionCol() for s in _regressors(model)]
    if len(outputs) != len(facts["targets"]):
        raise ValueError("Model outputs differ from the metadata.")
    scored = score(sample, model)
    none = F.count_if(F.greatest(*[F.col(c).isNull() for c in [*outputs, outputs[0]]]))
    found = scored.agg(F.count(F.lit(1)).alias("rows"), none.alias("none")).head()
    if not found["rows"] or found["none"]:
        raise ValueError("Model gave no forecast for the sample.")
    if original is not None:
        firsts = [f"_first_{k}" for k in range(len(outputs))]
        both = score(score(sample, original).withColumnsRenamed(dict(zip(outputs, firsts))), model)
        differ = F.greatest(*[~F.col(a).eqNullSafe(F.col(b)) for a, b in zip([*outputs, outputs[0]], [*firsts, firsts[0]])])
        if not both.filter(differ).isEmpty():
            raise ValueError("Reloaded model gives other forecasts than the original.")


def stored_scores(pairs_by_model: dict[str, DataFrame], name: str, baseline: str = "Persistence") -> dict:
    """M8: a model's and the baseline's test figures, as stored with the model."""
    return score_facts(model_scores(pairs_by_model), name, baseline)


def score_facts(scores: DataFrame, name: str, baseline: str = "Persistence") -> dict:
    """The same from scored models."""
    rows = {r["model"]: r for r in scores.collect()}
    mine, base = rows[name], rows[baseline]
    return {
        "test_mae": mine["mae"], "test_rmse": mine["rmse"], "test_r2": mine["r2"],
        "persistence_mae": base["mae"], "persistence_rmse": base["rmse"],
        "improvement_vs_persistence_percent": (base["mae"] - mine["mae"]) / base["mae"] * 100,
    }
