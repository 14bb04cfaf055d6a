"""Raw CSV to a saved model, on a small made-up site."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from heatline.operators import baselines, linear, metrics, ml, split
from heatline.operators.scale import evenly
from heatline.plans.training import feature_table, modules_from_raw, persistence_by_module, split_table
from heatline.schema import MODULES, SOURCE_TIME, TARGETS, TOTAL_POWER, feature_names, raw_telemetry
from heatline.sources.sinks import write_csv, write_dataset
from heatline.sources.telemetry import read_telemetry


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """About 40 minutes at 1 Hz with a gap, a repeated second and a bad clock."""
    generator = np.random.default_rng(8)
    seconds = np.r_[0:1500, 1600:2600]
    times = pd.Timestamp("2024-09-16 16:58:30") + pd.to_timedelta(seconds, unit="s")
    frame = pd.DataFrame({SOURCE_TIME: times.strftime("%Y-%m-%d %H:%M:%S")})
    for c in (1, 2, 3):
        frame[f"Power Ch {c} (W)"] = 300 + 10 * np.sin(seconds / 90) + c
    for m in range(1, 9):
        for c in (1, 2):
            frame[f"Temperature mod {m} ch {c}"] = 20 + m + np.sin(seconds / 200 + m) + generator.normal(0, 0.05, len(frame))
    frame.loc[5, "Temperature mod 1 ch 1"] = np.nan
    frame = pd.concat([frame, frame.iloc[[7]]], ignore_index=True)
    frame.loc[9, SOURCE_TIME] = "broken"
    path = tmp_path_factory.mktemp("raw") / "raw.csv"
    frame.to_csv(path, index=False)
    layout = raw_telemetry({m: 2 for m in range(1, 9)})
    return frame, read_telemetry(spark, str(path), layout)


def test_all_targets_at_once_equal_single_fits(spark):
    """Weights of one Gram matrix are those of one least squares fit per target."""
    generator = np.random.default_rng(4)
    frame = pd.DataFrame(generator.normal(25, 3, (300, 6)), columns=[f"x {i}" for i in range(6)])
    for j in range(4):
        frame[f"y{j}"] = frame @ generator.normal(0, 1, frame.shape[1]) + generator.normal(0, 0.1, 300) + 5 * j
        frame = frame[[c for c in frame if c.startswith("x")] + [c for c in frame if c.startswith("y")]]
    frame["flat"] = 7.0
    inputs, targets = [f"x {i}" for i in range(6)], [f"y{j}" for j in range(4)]
    df = spark.createDataFrame(frame).repartition(5)
    weights, intercepts = linear.coefficients(df, inputs, targets)
    model = ml.fit_per_target(df, inputs, targets, targets)
    for j, stage in enumerate(model.stages[1:]):
        assert weights[:, j] == pytest.approx(stage.coefficients.toArray(), rel=1e-7)
        assert intercepts[j] == pytest.approx(stage.intercept, rel=1e-7)
    # A repeated and a constant input change no forecast; rows with holes are left out.
    more = df.withColumn("again", F.col("x 0") * 2).unionByName(
        df.limit(1).withColumns({"again": F.lit(1.0), "x 1": F.lit(None).cast("double")})
    )
    for rows, columns in ((df, inputs), (more, [*inputs, "again", "flat"])):
        out = ml.score(df.withColumn("again", F.col("x 0") * 2), linear.fit_linear(rows, columns, targets, targets)).toPandas()
        same = ml.score(df, model).toPandas()
        for t in targets:
            assert sorted(out[f"Predicted_{t}"]) == pytest.approx(sorted(same[f"Predicted_{t}"]), rel=1e-7)
    empty, _ = linear.coefficients(df.limit(0), inputs, targets)
    assert not empty.any()


def by_hand(frame):
    f = frame.copy()
    f[SOURCE_TIME] = pd.to_datetime(f[SOURCE_TIME], errors="coerce")
    f = f.dropna(subset=[SOURCE_TIME]).groupby(SOURCE_TIME, as_index=False).mean()
    for m in range(1, 9):
        f[f"Module_{m}_Avg_Temp"] = f[[f"Temperature mod {m} ch {c}" for c in (1, 2)]].mean(axis=1)
    f[TOTAL_POWER] = f[[f"Power Ch {c} (W)" for c in (1, 2, 3)]].sum(axis=1)
    f = f.set_index(SOURCE_TIME)[[*MODULES, TOTAL_POWER]].resample("10s").mean()
    return f.dropna(subset=MODULES, how="all")


def test_module_table_equals_pandas(raw):
    frame, df = raw
    wanted = by_hand(frame)
    got = modules_from_raw(df).toPandas().sort_values("event_time").set_index("event_time")
    assert list(got.index) == list(wanted.index)
    assert np.allclose(got[wanted.columns], wanted)


@pytest.fixture(scope="module")
def features(raw):
    return feature_table(modules_from_raw(raw[1])).persist()


def test_feature_rows(raw, features):
    wanted = by_hand(raw[0])
    later = wanted[MODULES].rename(columns=dict(zip(MODULES, TARGETS)))
    later.index = later.index - pd.Timedelta("300s")
    joined = wanted.join(later, how="inner").dropna()
    got = features.toPandas().sort_values("event_time", ignore_index=True)
    assert len(got) == len(joined) - 30
    assert list(got["event_time"]) == list(joined.index[30:])
    assert got["Module_1_Avg_Temp_Lag_30"].tolist() == pytest.approx(joined["Module_1_Avg_Temp"][:-30].tolist(), rel=1e-6)
    gaps = (got["target_time"] - got["event_time"]).dt.total_seconds()
    assert (gaps == 300).all()
    missing = metrics.missing_values(features, feature_names(), TARGETS).head()
    assert tuple(missing) == (0, 0)
    assert dict(features.dtypes)["Hour"] == "float"


@pytest.mark.parametrize("limit", [None, 10])
def test_split(features, limit):
    rows = split_table(features, limit)
    n = features.count()
    sizes = {r["split"]: r["rows"] for r in split.split_report(rows).collect()}
    assert sizes == {
        "train": int(0.70 * n), "validation": int(0.85 * n) - int(0.70 * n), "test": n - int(0.85 * n)}
    split.check_split(rows)
    with pytest.raises(ValueError, match="overlaps"):
        split.check_split(rows.withColumn("split", F.when(F.minute("event_time") % 2 == 0, "train").otherwise("test")))


def sklearn_scores(actual, predicted):
    error = actual - predicted
    r2 = 1 - (error**2).sum(axis=0) / ((actual - actual.mean(axis=0)) ** 2).sum(axis=0)
    return np.abs(error).mean(), np.sqrt((error**2).mean()), r2.mean()


def test_metrics_equal_numpy(features):
    rows = baselines.persistence(features)
    pairs = baselines.forecast_pairs(rows)
    frame = features.toPandas()
    wanted = sklearn_scores(frame[TARGETS].to_numpy(float), frame[MODULES].to_numpy(float))
    assert tuple(metrics.regression_metrics(pairs).head()) == pytest.approx(wanted)


def test_constant_target_scores(spark):
    rows = [("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "module string, actual double, predicted double")
    got = {r["module"]: r["r2"] for r in metrics.module_metrics(df).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": None}


def test_persistence_plan(raw):
    assert persistence_by_module(modules_from_raw(raw[1])).count() == 8


def test_models(spark, features, tmp_path):
    rows = split_table(features)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    names = feature_names()[:24]
    linear = ml.fit_per_target(train, names)
    trees = ml.fit_per_target(train, names, TARGETS[:1], MODULES[:1], lambda: ml.boosted_trees(5))

    def pairs(df):
        return baselines.forecast_pairs(df)

    scored = ml.score(test, linear)
    by_model = {
        "Persistence": pairs(baselines.persistence(test)),
        "Moving Average": pairs(baselines.moving_average(rows, []).filter("split = 'test'")),
        "Linear Regression": pairs(scored),
    }
    compared = metrics.compare_models(metrics.model_scores(by_model)).collect()
    assert [r["mae"] for r in compared] == sorted(r["mae"] for r in compared)
    base = next(r for r in compared if r["model"] == "Persistence")
    assert base["improvement_percent"] == 0.0 and base["beats_baseline"] is False

    x = np.c_[np.ones(train.count()), train.toPandas()[names].to_numpy(float)]
    weights = np.linalg.lstsq(x, train.toPandas()[TARGETS[0]].to_numpy(float), rcond=None)[0]
    out = scored.toPandas()
    wanted = np.c_[np.ones(len(out)), out[names].to_numpy(float)] @ weights
    assert np.allclose(out[f"Predicted_{MODULES[0]}"], wanted, atol=1e-2)

    ranked = ml.importances(spark, trees).collect()
    assert len(ranked) == len(names)
    assert [r["importance"] for r in ranked] == sorted((r["importance"] for r in ranked), reverse=True)

    scores = ml.stored_scores(by_model, "Linear Regression")
    facts = ml.metadata(names, scores)
    ml.save_model(spark, linear, facts, str(tmp_path / "m"))
    copy, read = ml.load_model(spark, str(tmp_path / "m"))
    assert read == json.loads(json.dumps(facts))
    assert (read["prediction_horizon_seconds"], read["sampling_seconds"], read["feature_count"]) == (300, 10, 24)
    ml.check_model(copy, read, test)
    with pytest.raises(ValueError, match="inputs"):
        ml.check_model(copy, {**read, "feature_count": 23}, test)
    forecasts = ml.module_forecasts(ml.score(test, copy), ["event_time"])
    assert forecasts.count() == 8 * test.count()


@pytest.mark.parametrize("name", ["m4_boosted_trees", "m6_production_refit", "m7_feature_importance"])
def test_tree_queries_take_every_round(spark, monkeypatch, name):
    from heatline.plans.catalog import models

    class Fitted(Exception):
        pass

    def fit(df, features, targets, modules, estimator):
        raise Fitted(estimator().getMaxIter())

    rows = spark.createDataFrame([("train",)], "split string")
    monkeypatch.setattr(models, "_training_rows", lambda spark, sf: rows)
    monkeypatch.setattr(models.split, "production_rows", lambda df: df)
    monkeypatch.setattr(ml, "fit_per_target", fit)
    query = {"m4": models.m4, "m6": models.m6, "m7": models.m7}[name[:2]]
    with pytest.raises(Fitted, match="^250$"):
        query(spark, "")


def test_targets_are_fitted_side_by_side_from_one_binned_table(spark, tmp_path):
    rows = [(float(k), float(k % 7), 1.0, float(2 * k), float(k % 7 > 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "x double, `y z` double, flat double, t0 double, t1 double")
    inputs, targets = ["x", "y z", "flat"], ["t0", "t1"]
    for few in (ml.BINS, 4):
        edges = ml.bin_edges(df, inputs, few)
        for name, cuts in zip(inputs, edges):
            assert cuts == sorted(set(cuts)) and cuts[0] == -np.inf and cuts[-1] == np.inf
            assert 3 <= len(cuts) <= few + 1
        filled = np.histogram(range(300), [0, *edges[0][1:-1], 300])[0]
        assert abs(filled - 300 / few).max() <= 0.2 * 300 / few + 1
    holes = df.withColumns({"x": F.when(F.col("x") > 9, F.lit(float("nan"))).otherwise(F.col("x")), "flat": F.lit(None).cast("double")})
    assert max(c for c in ml.bin_edges(holes, inputs)[0] if c < np.inf) <= 9
    assert ml.bin_edges(holes, inputs)[2] == [-np.inf, 0.0, np.inf]

    model = ml.fit_per_target(df, inputs, targets, targets, lambda: ml.boosted_trees(8), bins=ml.BINS)
    one = ml.fit_per_target(df, inputs, targets, targets, lambda: ml.boosted_trees(8), bins=ml.BINS, side_by_side=1)
    assert ml.inputs_of(model) == inputs
    scored = ml.score(df, model)
    assert scored.columns == [*df.columns, "Predicted_t0", "Predicted_t1"]
    order = ["t0", "Predicted_t0", "Predicted_t1"]
    assert scored.select(order).orderBy("t0").collect() == ml.score(df, one).select(order).orderBy("t0").collect()
    # Steps of 0.05 take a share of the way from the mean in eight rounds.
    assert scored.select(F.corr("t0", "Predicted_t0")).head()[0] > 0.99
    assert scored.select(F.corr("t1", "Predicted_t1")).head()[0] > 0.99
    assert [r["feature"] for r in ml.importances(spark, model, "t1", 1).collect()] == ["y z"]
    facts = ml.metadata(inputs, {}, targets)
    ml.save_model(spark, model, facts, str(tmp_path / "m"))
    again, read = ml.load_model(spark, str(tmp_path / "m"))
    ml.check_model(again, read, df, model)


@pytest.mark.parametrize("most, parts", [(ml.ROWS_PER_PART, 1), (40, 3)])
def test_fits_read_as_few_parts_as_their_rows_call_for(spark, monkeypatch, most, parts):
    """Rows in four of twelve parts: the empty ones are not carried into every job of a fit."""
    seen = []

    class Watched(LinearRegression):
        def fit(self, rows):
            seen.append([len(part) for part in rows.rdd.glom().collect()])
            return super().fit(rows)

    monkeypatch.setattr(ml, "ROWS_PER_PART", most)
    df = spark.range(0, 300, 1, 12).filter("id < 90").selectExpr("cast(id as double) x", "2D * id + 1 y", "3D * id z")
    model = ml.fit_per_target(df, ["x"], ["y", "z"], ["y", "z"], Watched)
    assert [(len(sizes), sum(sizes), min(sizes) > 0) for sizes in seen] == [(parts, 90, True)] * 2
    out = ml.score(df, model).toPandas()
    assert len(out) == 90 and np.allclose(out[["Predicted_y", "Predicted_z"]], out[["y", "z"]])
    empty = evenly(df.filter("x < 0"), most)
    assert empty.rdd.getNumPartitions() == 1 and empty.count() == 0


def test_all_importances(spark):
    names = [f"x{k}" for k in range(60)]
    rows = [(*[float((k * j) % 7) for j in range(60)], float(k % 5)) for k in range(1, 40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"]))
    trees = ml.fit_per_target(df, names, ["y"], ["m"], lambda: ml.boosted_trees(1))
    assert sorted(r["feature"] for r in ml.importances(spark, trees, "m").collect()) == sorted(names)
    assert ml.importances(spark, trees, "m", 3).count() == 3
    assert spark.sparkContext.getCheckpointDir()


def test_reloaded_model_is_checked_on_every_row(spark):
    rows = spark.createDataFrame([(float(k), 2.0 * k) for k in range(40)], "x double, y double").coalesce(1)
    late = rows.withColumn("y", F.when(F.col("x") > 30, 0.0).otherwise(F.col("y")))
    model, other = (ml.fit_per_target(d, ["x"], ["y"], ["m"]) for d in (rows, late))
    facts = ml.metadata(["x"], {}, ["y"])
    ml.check_model(model, facts, rows, model)
    with pytest.raises(ValueError, match="other forecasts"):
        ml.check_model(model, facts, rows, other)

    class LateGap:
        stages = model.stages

        def transform(self, df):
            out = model.transform(df)
            return out.withColumn("Predicted_m", F.when(F.col("x") < 20, F.col("Predicted_m")))

    with pytest.raises(ValueError, match="no forecast"):
        ml.check_model(LateGap(), facts, rows)


def test_sinks(spark, raw, features, tmp_path):
    modules = modules_from_raw(raw[1])
    write_dataset(modules, str(tmp_path / "modules"))
    back = spark.read.parquet(str(tmp_path / "modules"))
    assert "event_date" in back.columns and back.count() == modules.count()
    write_csv(modules, str(tmp_path / "csv"))
    from heatline.schema import MODULE_TABLE

    again = read_telemetry(spark, str(tmp_path / "csv"), MODULE_TABLE)
    assert again.exceptAll(modules.select(*again.columns)).count() == 0
