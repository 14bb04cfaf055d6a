"""Baselines, regressors and their scores; and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.functions.scalars import improvement_percent
from heatline.operators import baselines, linear, metrics, ml, split
from heatline.operators.features import REACH, add_series_features
from heatline.operators.scale import written
from heatline.operators.targets import add_future_targets
from heatline.operators.timeline import collapse_duplicates, resample_mean
from heatline.plans.catalog.base import (
    HORIZON,
    HOUR,
    R,
    STEP,
    WIDE,
    events,
    hourly,
    query,
    rounded,
    telemetry,
    wide,
)
from heatline.plans.training import feature_table, split_table
from heatline.schema import (
    CHANGE_ROWS,
    LAGS,
    MEAN_ROWS,
    MODULES,
    SPLIT_FRACTIONS,
    STD_ROWS,
    TARGETS,
    TOTAL_POWER,
    feature_names,
)
from heatline.session import scratch_path

_TARGET = {"value": "target"}
_FEATURES = [
    "value",
    *[f"value_{s}_{n}" for s, ns in (
        ("Lag", LAGS), ("RollingMean", MEAN_ROWS), ("RollingStd", STD_ROWS), ("Change", CHANGE_ROWS)
    ) for n in ns],
]


def _supervised(spark, sf) -> DataFrame:
    """Hourly values with the one five hours later; read by several passes."""
    return written(
        add_future_targets(
            hourly(spark, sf), ["module"], columns=["value"], seconds=HORIZON, names=_TARGET
        )
    )


def _pairs(df: DataFrame, keep: list[str] = []) -> DataFrame:
    return df.select(
        "module", *keep, F.col("target").alias("actual"), F.col("Predicted_value").alias("predicted")
    )


_PAIRS = f"""{R}, pr AS (SELECT a.module, a.event_time, b.value AS actual, a.value AS predicted
  FROM r a JOIN r b ON a.module = b.module AND a.event_time + INTERVAL 5 HOUR = b.event_time)"""
_BY_MODULE = """SELECT module, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2"""


@query("flagship_forecast_error", f"""WITH {_PAIRS}, s AS ({_BY_MODULE} FROM pr GROUP BY module)
  SELECT module, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM s""")
def flagship(spark, sf):
    rows = telemetry(spark, sf).select("module", "event_time", "value")
    once = collapse_duplicates(rows, ["module", "event_time"])
    steps = resample_mean(once, ["module"], "event_time", HOUR, ["value"])
    paired = add_future_targets(steps, ["module"], columns=["value"], seconds=HORIZON, names=_TARGET)
    scores = metrics.module_metrics(_pairs(baselines.persistence(paired, ["value"])))
    return rounded(scores, "mae", "rmse", "r2")


@query("a16_overall_metrics", f"""WITH {_PAIRS}, s AS (SELECT module, sum(abs(actual - predicted)) AS a,
    sum((actual - predicted) ** 2) AS q, count(*) AS n,
    1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2 FROM pr GROUP BY module)
  SELECT round(sum(a) / sum(n), 6) AS mae, round(sqrt(sum(q) / sum(n)), 6) AS rmse, round(avg(r2), 6) AS r2 FROM s""")
def a16(spark, sf):
    pairs = _pairs(baselines.persistence(_supervised(spark, sf), ["value"]))
    return rounded(metrics.regression_metrics(pairs), "mae", "rmse", "r2")


@query("a17_module_metrics", f"""WITH {_PAIRS}, s AS ({_BY_MODULE} FROM pr GROUP BY module)
  SELECT module, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM s""")
def a17(spark, sf):
    pairs = _pairs(baselines.persistence(_supervised(spark, sf), ["value"]))
    return rounded(metrics.module_metrics(pairs), "mae", "rmse", "r2")


@query("m1_persistence", f"WITH {_PAIRS} SELECT module, event_time, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM pr")
def m1(spark, sf):
    rows = baselines.persistence(_supervised(spark, sf), ["value"])
    return rounded(_pairs(rows, ["event_time"]), "actual", "predicted")


_AVERAGED = f"""{R}, pr AS (SELECT a.module, a.event_time, b.value AS actual, a.value AS current
    FROM r a JOIN r b ON a.module = b.module AND a.event_time + INTERVAL 5 HOUR = b.event_time),
  ma AS (SELECT *, avg(current) OVER (PARTITION BY module ORDER BY event_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS average,
    row_number() OVER (ORDER BY event_time) - 1 AS place, count(*) OVER ()::DOUBLE AS n FROM pr),
  cut AS (SELECT max(event_time) FILTER (WHERE place = floor(0.85::DOUBLE * n)) AS test_start FROM ma),
  te AS (SELECT ma.* FROM ma, cut WHERE event_time >= test_start),
  line AS (SELECT regr_slope(actual, current) AS k, regr_intercept(actual, current) AS c FROM ma, cut WHERE event_time < test_start)"""


def _tested(spark, sf):
    """All models but the trees on the last 15 % of times; averages cross the border."""
    rows = baselines.moving_average(
        _supervised(spark, sf), ["module"], columns=["value"], prefix="Average_"
    )
    rows = split.chronological_split(written(rows))
    model = linear.fit_linear(split.production_rows(rows), ["value"], ["target"], ["value"])
    return ml.score(rows.filter("split = 'test'"), model), model


def _test_rows(spark, sf) -> DataFrame:
    return _tested(spark, sf)[0]


@query("m2_moving_average", f"""WITH {_AVERAGED} SELECT module, event_time, round(actual, 6) AS actual,
  round(average, 6) AS predicted FROM te""")
def m2(spark, sf):
    out = _test_rows(spark, sf).select(
        "module", "event_time", F.col("target").alias("actual"), F.col("Average_value").alias("predicted")
    )
    return rounded(out, "actual", "predicted")


_COMPARED = f"""{_AVERAGED}, both_models AS (SELECT 'Persistence' AS model, module, actual, current AS predicted FROM te
    UNION ALL SELECT 'Moving Average', module, actual, average FROM te
    UNION ALL SELECT 'Linear Regression', module, actual, k * current + c FROM te, line),
  per AS (SELECT model, module, sum(abs(actual - predicted)) AS a, sum((actual - predicted) ** 2) AS q, count(*) AS n,
    CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(actual) = 0 THEN (sum((actual - predicted) ** 2) = 0)::INT
    ELSE 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) END AS r2 FROM both_models GROUP BY ALL),
  sc AS (SELECT model, sum(a) / sum(n) AS mae, sqrt(sum(q) / sum(n)) AS rmse, avg(r2) AS r2 FROM per GROUP BY model),
  base AS (SELECT mae AS b FROM sc WHERE model = 'Persistence')"""


def _scores(spark, sf) -> DataFrame:
    models = {"Persistence": "value", "Moving Average": "Average_value", "Linear Regression": "Predicted_value"}
    return metrics.forecast_scores(_test_rows(spark, sf), models, "target")


@query("a18_model_comparison", f"""WITH {_COMPARED} SELECT model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
  round((b - mae) / b * 100, 6) AS improvement_percent FROM sc, base ORDER BY mae, model""")
def a18(spark, sf):
    out = metrics.compare_models(_scores(spark, sf)).drop("beats_baseline")
    return rounded(out, "mae", "rmse", "r2", "improvement_percent")


@query("m10_beats_baseline", f"WITH {_COMPARED} SELECT model, mae < b AS beats_baseline FROM sc, base")
def m10(spark, sf):
    return metrics.compare_models(_scores(spark, sf)).select("model", "beats_baseline")


@query("m8_metadata", f"""WITH {_COMPARED} SELECT sc.model, 3600 AS sampling_seconds, 18000 AS prediction_horizon_seconds,
  1 AS feature_count, round(sc.mae, 6) AS test_mae, round(sc.rmse, 6) AS test_rmse, round(sc.r2, 6) AS test_r2,
  round(p.mae, 6) AS persistence_mae, round((p.mae - sc.mae) / p.mae * 100, 6) AS improvement_vs_persistence_percent
  FROM sc, sc AS p WHERE sc.model = 'Linear Regression' AND p.model = 'Persistence'""")
def m8(spark, sf):
    """What is stored beside a model, saved and read back."""
    rows, model = _tested(spark, sf)
    scores = metrics.forecast_scores(rows, {"Persistence": "value", "Linear Regression": "Predicted_value"}, "target")
    facts = ml.metadata(["value"], ml.score_facts(scores, "Linear Regression"), ["target"], HOUR, HORIZON, "Linear Regression")
    path = scratch_path(spark, "model")
    ml.save_model(spark, model, facts, path)
    _, read = ml.load_model(spark, path)
    names = ["model", "sampling_seconds", "prediction_horizon_seconds", "feature_count", "test_mae", "test_rmse",
             "test_r2", "persistence_mae", "improvement_vs_persistence_percent"]
    layout = "model string, sampling_seconds int, prediction_horizon_seconds int, feature_count int, " + ", ".join(
        f"{n} double" for n in names[4:]
    )
    return rounded(spark.createDataFrame([tuple(read[n] for n in names)], layout), *names[4:])


@query("f10_improvement", """SELECT event_id, round((value - 10) / value * 100, 6) AS improvement FROM events""")
def f10(spark, sf):
    gain = improvement_percent(F.col("value"), F.lit(10.0)).alias("improvement")
    return rounded(events(spark, sf).select("event_id", gain), "improvement")


def _training_rows(spark, sf) -> DataFrame:
    """Series features with a target, split by time; read by several fits.

    Ten-minute means over the whole site, so that the smallest tables still hold
    rows with a full history.
    """
    site = telemetry(spark, sf).withColumn("module", F.lit("Site_Avg_Temp"))
    steps = resample_mean(site, ["module"], "event_time", 600, ["value"])
    paired = written(
        add_future_targets(steps, ["module"], columns=["value"], seconds=3000, names=_TARGET)
    )
    rows = add_series_features(paired, ["module"], "event_time", "value")
    return split.chronological_split(written(rows.dropna(subset=[*_FEATURES, "target"])))


def _fit(rows: DataFrame, estimator):
    return ml.fit_per_target(rows, _FEATURES, ["target"], ["value"], estimator)


def _forecast(rows: DataFrame, model) -> DataFrame:
    return ml.score(rows, model).select(
        "module", "event_time", F.col("target").alias("actual"),
        F.col("Predicted_value").alias("predicted"),
    )


# One input has a closed form SQL knows; the full input set has not.
@query("m3_linear_one_input", f"""WITH {_PAIRS}, fit AS (SELECT regr_slope(actual, predicted) AS k, regr_intercept(actual, predicted) AS c FROM pr)
  SELECT module, event_time, round(k * predicted + c, 4) AS predicted FROM pr, fit""")
def m3_one(spark, sf):
    rows = _supervised(spark, sf)
    model = ml.fit_per_target(rows, ["value"], ["target"], ["value"])
    out = ml.score(rows, model).select(
        "module", "event_time", F.col("Predicted_value").alias("predicted")
    )
    return rounded(out, "predicted", digits=4)


# Two inputs shared by eight targets still have a closed form: the normal equations.
_INPUTS = ["Module_1_Avg_Temp", TOTAL_POWER]
_EIGHT = f"""{WIDE}, pr AS (SELECT a.event_time, a.{_INPUTS[0]} AS x1, a.{_INPUTS[1]} AS x2,
    {', '.join(f'b.{m} AS {t}' for m, t in zip(MODULES, TARGETS))}
    FROM w a JOIN w b ON a.event_time + INTERVAL 30 HOUR = b.event_time
    WHERE {' AND '.join(f'b.{m} IS NOT NULL' for m in MODULES)} AND a.{_INPUTS[0]} IS NOT NULL),
  c AS (SELECT avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
    {', '.join(f'avg({t}) AS m_{t}, covar_pop(x1, {t}) AS a_{t}, covar_pop(x2, {t}) AS b_{t}' for t in TARGETS)} FROM pr)"""


def _line_sql(t: str) -> str:
    k1 = f"(a_{t} * s22 - b_{t} * s12) / (s11 * s22 - s12 * s12)"
    k2 = f"(b_{t} * s11 - a_{t} * s12) / (s11 * s22 - s12 * s12)"
    return f"round(m_{t} + {k1} * (x1 - m1) + {k2} * (x2 - m2), 4)"


@query("m3_all_targets", f"""WITH {_EIGHT} SELECT event_time,
  {', '.join(f'{_line_sql(t)} AS Predicted_{m}' for m, t in zip(MODULES, TARGETS))} FROM pr, c""")
def m3_all(spark, sf):
    rows = add_future_targets(wide(spark, sf), [], seconds=5 * STEP).dropna(subset=_INPUTS)
    rows = written(rows.select("event_time", *_INPUTS, *TARGETS))
    out = ml.score(rows, linear.fit_linear(rows, _INPUTS))
    names = [f"Predicted_{m}" for m in MODULES]
    return rounded(out.select("event_time", *names), *names, digits=4)


@query("m5_batch_scoring", f"""WITH {_PAIRS}, fit AS (SELECT regr_slope(actual, predicted) AS k, regr_intercept(actual, predicted) AS c FROM pr)
  SELECT module, event_time, round(k * value + c, 4) AS predicted FROM r, fit""")
def m5(spark, sf):
    model = ml.fit_per_target(_supervised(spark, sf), ["value"], ["target"], ["value"])
    out = ml.score(hourly(spark, sf), model).withColumnRenamed("Predicted_value", "predicted")
    return rounded(out.drop("value"), "predicted", digits=4)


@query("m3_linear_regression")
def m3(spark, sf):
    rows = _training_rows(spark, sf)
    return _forecast(rows.filter("split = 'test'"), _fit(rows.filter("split = 'train'"), ml.linear_regression))


@query("m4_boosted_trees")
def m4(spark, sf):
    rows = _training_rows(spark, sf)
    return _forecast(rows.filter("split = 'test'"), _fit(rows.filter("split = 'train'"), ml.boosted_trees))


# Values of trees have no closed form; which rows are learned and scored, and that eight sets
# of trees beat their targets' means on them, SQL knows.
_KNOWN = " AND ".join(
    f"count({m}) OVER (ORDER BY event_time ROWS BETWEEN {REACH} PRECEDING AND CURRENT ROW) = {REACH + 1}"
    for m in MODULES
)


@query("m4_all_targets", f"""WITH {WIDE}, su AS (SELECT a.* FROM w a JOIN w b ON a.event_time + INTERVAL 30 HOUR = b.event_time
    WHERE {' AND '.join(f'b.{m} IS NOT NULL' for m in MODULES)}),
  fe AS (SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS place, count(*) OVER ()::DOUBLE AS n
    FROM (SELECT event_time, {_KNOWN} AS known FROM su) WHERE known),
  cut AS (SELECT {', '.join(f'max(event_time) FILTER (WHERE place = floor({f}::DOUBLE * n)) AS c{i}' for i, f in enumerate(SPLIT_FRACTIONS))} FROM fe),
  sp AS (SELECT CASE WHEN event_time < c0 THEN 'train' WHEN event_time < c1 THEN 'validation' ELSE 'test' END AS split FROM fe, cut)
  SELECT split, module, count(*) AS rows, count(*) AS forecasts, CASE WHEN split = 'train' THEN true END AS beats_mean
  FROM sp CROSS JOIN (SELECT unnest([{', '.join(f"'{m}'" for m in MODULES)}]) AS module) GROUP BY split, module""")
def m4_all(spark, sf):
    """Eight targets from all 131 inputs, 250 rounds each; what they forecast on every split."""
    rows = written(split_table(feature_table(wide(spark, sf), horizon_seconds=5 * STEP)))
    train = rows.filter("split = 'train'")
    scored = rows
    if train.isEmpty():
        scored = rows.withColumns({f"Predicted_{m}": F.lit(None).cast("double") for m in MODULES})
    else:
        inputs = feature_names(MODULES, TOTAL_POWER)
        scored = ml.score(rows, ml.fit_per_target(train, inputs, estimator=ml.boosted_trees, bins=ml.BINS))
    pairs = baselines.forecast_pairs(scored, keep=["split"])
    finite = F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < float("inf"))
    better = F.avg((F.col("actual") - F.col("predicted")) ** 2) < F.var_pop("actual")
    return pairs.groupBy("split", "module").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(finite).alias("forecasts"),
        F.when(F.col("split") == "train", better).alias("beats_mean"),
    )


@query("m6_production_refit")
def m6(spark, sf):
    rows = _training_rows(spark, sf)
    return _forecast(rows.filter("split = 'test'"), _fit(split.production_rows(rows), ml.boosted_trees))


@query("m7_feature_importance")
def m7(spark, sf):
    model = _fit(_training_rows(spark, sf).filter("split = 'train'"), ml.boosted_trees)
    return ml.importances(spark, model, "value")


@query("m9_reloaded_model")
def m9(spark, sf):
    """Save with metadata, load, verify, and score with the copy."""
    rows = _training_rows(spark, sf)
    test = rows.filter("split = 'test'")
    model = _fit(rows.filter("split = 'train'"), ml.linear_regression)
    pairs = _forecast(test, model)
    base = test.select("module", F.col("target").alias("actual"), F.col("value").alias("predicted"))
    scores = ml.stored_scores(
        {"Linear Regression": pairs.drop("event_time"), "Persistence": base}, "Linear Regression"
    )
    facts = ml.metadata(_FEATURES, scores, ["target"], 600, 3000, "LinearRegression")
    path = scratch_path(spark, "model")
    ml.save_model(spark, model, facts, path)
    copy, read = ml.load_model(spark, path)
    ml.check_model(copy, read, test, model)
    return _forecast(test, copy)
