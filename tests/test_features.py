import numpy as np
import pandas as pd
import pytest

from heatline.operators.features import add_features
from heatline.schema import MODULES, TOTAL_POWER, feature_names


def frame(n=90):
    generator = np.random.default_rng(5)
    data = {m: generator.normal(25, 1, n) for m in MODULES}
    data[TOTAL_POWER] = generator.normal(1000, 50, n)
    # A gap in time: features go by row, not by clock.
    times = pd.date_range("2024-09-20 23:55", periods=n, freq="10s").to_series()
    times[times.index[40:]] += pd.Timedelta("3h")
    return pd.DataFrame({"event_time": times.values, **data})


def training_by_hand(f):
    out = {}
    for m in MODULES:
        s = f[m]
        out.update({f"{m}_Lag_{n}": s.shift(n) for n in (1, 3, 6, 18, 30)})
        out.update({f"{m}_RollingMean_{n}": s.rolling(n, n).mean() for n in (3, 6, 30)})
        out.update({f"{m}_RollingStd_{n}": s.rolling(n, n).std() for n in (6, 30)})
        out.update({f"{m}_Change_{n}": s - s.shift(n) for n in (1, 3, 6, 30)})
    p = f[TOTAL_POWER]
    out[f"{TOTAL_POWER}_Lag_6"], out[f"{TOTAL_POWER}_Change_6"] = p.shift(6), p - p.shift(6)
    out["Module_Temp_STD"] = f[MODULES].std(axis=1)
    return out


def serving_by_hand(f):
    out = {}
    for m in MODULES:
        s = f[m]
        out.update({f"{m}_Lag_{n}": s.shift(n).fillna(s) for n in (1, 3, 6, 18, 30)})
        out.update({f"{m}_RollingMean_{n}": s.rolling(n, 1).mean() for n in (3, 6, 30)})
        out.update({f"{m}_RollingStd_{n}": s.rolling(n, 1).std(ddof=0) for n in (6, 30)})
        out.update({f"{m}_Change_{n}": s.diff(n).fillna(0.0) for n in (1, 3, 6, 30)})
    p = f[TOTAL_POWER]
    out[f"{TOTAL_POWER}_Lag_6"] = p.shift(6).fillna(p)
    out[f"{TOTAL_POWER}_Change_6"] = p.diff(6).fillna(0.0)
    out["Module_Temp_STD"] = f[MODULES].std(axis=1, ddof=0)
    return out


@pytest.mark.parametrize("mode, by_hand", [("training", training_by_hand), ("serving", serving_by_hand)])
@pytest.mark.parametrize("limit", [None, 35])
def test_features_equal_pandas(spark, mode, by_hand, limit):
    f = frame()
    wanted = by_hand(f)
    common = {
        "Module_Temp_Mean": f[MODULES].mean(axis=1), "Module_Temp_Max": f[MODULES].max(axis=1),
        "Module_Temp_Min": f[MODULES].min(axis=1), "Hour": f.event_time.dt.hour,
        "Minute": f.event_time.dt.minute, "Weekday": f.event_time.dt.weekday,
        "Is_Weekend": (f.event_time.dt.weekday >= 5).astype(float),
    }
    out = add_features(spark.createDataFrame(f), [], mode=mode, limit=limit)
    got = out.toPandas().sort_values("event_time", ignore_index=True)
    assert out.columns == ["event_time", *feature_names()]
    for name, values in {**wanted, **common}.items():
        assert np.allclose(got[name].astype(float), values.astype(float), equal_nan=True, atol=1e-9), name


def test_series_are_apart(spark):
    f = frame(40)
    two = pd.concat([f.assign(site="a"), f.assign(site="b")])
    got = add_features(spark.createDataFrame(two), ["site"]).toPandas()
    assert got[f"{MODULES[0]}_Lag_1"].isna().sum() == 2
    assert got[f"{MODULES[0]}_Lag_30"].notna().sum() == 20


def test_names():
    names = feature_names()
    assert len(names) == len(set(names)) == 131
    assert names[8] == "Module_1_Avg_Temp_Lag_1" and names[-1] == "Is_Weekend"


def test_mode_is_checked(spark):
    with pytest.raises(ValueError, match="mode"):
        add_features(spark.createDataFrame(frame(3)), [], mode="other")
