import numpy as np
import pandas as pd
import pytest

from heatline.operators.asof import asof_nearest
from heatline.operators.monitor import forecast_performance, status_with_performance

SCHEMA = "module string, event_time timestamp, current_temperature double, predicted_temperature double"


@pytest.mark.parametrize(
    "readings, matched",
    [([290, 320], 290), ([290, 310], 290), ([270], 270), ([269], None), ([], None), ([330], 330), ([300, 301], 300)],
)
def test_truth_table(spark, ts, readings, matched):
    left = spark.createDataFrame([("m", ts(300))], "module string, target_time timestamp")
    right = spark.createDataFrame(
        [("m", ts(s), float(s)) for s in readings] + [("n", ts(300), 1.0)],
        "module string, event_time timestamp, v double",
    )
    row = asof_nearest(left, right, ["module"], "target_time", "event_time", "v", 30).head()
    assert row["matched_value"] == matched
    assert row["matched_time"] == (None if matched is None else ts(matched))


@pytest.mark.parametrize("limit", [None, 5])
def test_equals_pandas(spark, limit):
    generator = np.random.default_rng(2)
    base = pd.Timestamp("2024-09-16")

    def times(n):
        return base + pd.to_timedelta(generator.integers(0, 20_000, n), unit="s")

    right = pd.DataFrame({"t": times(400), "v": generator.normal(25, 1, 400)}).drop_duplicates("t")
    left = pd.DataFrame({"target": times(500), "i": range(500)})
    left.loc[:60, "target"] = base + pd.Timedelta("5000s")  # one hot time
    wanted = pd.merge_asof(
        left.sort_values("target"), right.sort_values("t"), left_on="target", right_on="t",
        direction="nearest", tolerance=pd.Timedelta("30s"),
    ).set_index("i")["v"]
    out = asof_nearest(
        spark.createDataFrame(left), spark.createDataFrame(right), [], "target", "t", "v", 30, limit=limit
    )
    got = out.toPandas().set_index("i")["matched_value"].reindex(wanted.index)
    assert len(out.toPandas()) == 500
    assert np.allclose(got.astype(float), wanted.astype(float), equal_nan=True)


def test_repeated_readings_follow_order(spark, ts):
    right = spark.createDataFrame(
        [("m", ts(10), 1.0, 1), ("m", ts(10), 2.0, 2), ("m", ts(30), 3.0, 1), ("m", ts(30), 4.0, 2)],
        "module string, t timestamp, v double, seq int",
    )
    left = spark.createDataFrame([("m", ts(11)), ("m", ts(29)), ("m", None)], "module string, at timestamp")
    out = asof_nearest(left, right, ["module"], "at", "t", "v", 5, ["seq"]).collect()
    assert {r["at"]: r["matched_value"] for r in out} == {ts(11): 2.0, ts(29): 3.0, None: None}


@pytest.mark.parametrize("ties", [["seq"], ["seq", "part"]])
def test_null_ties_on_both_sides_of_the_limit(spark, ts, ties):
    right = spark.createDataFrame(
        [
            ("m", ts(10), 1.0, None, None), ("m", ts(10), 2.0, 2, None),
            ("m", ts(30), 3.0, None, None),
            ("m", ts(50), 5.0, None, 2), ("m", ts(50), 6.0, None, None),
        ],
        "module string, t timestamp, v double, seq int, part int",
    )
    # Of ties that are wholly equal, any may win.
    right = right.filter("v != 6.0") if len(ties) == 1 else right
    left = spark.createDataFrame([("m", ts(s)) for s in (9, 11, 29, 31, 49, 51)], "module string, at timestamp")

    def matched(limit):
        out = asof_nearest(left, right, ["module"], "at", "t", "v", 5, ties, limit=limit)
        return [r["matched_value"] for r in out.orderBy("at").collect()]

    assert matched(1) == matched(None) == [1.0, 2.0, 3.0, 3.0, 6.0 if len(ties) == 2 else 5.0, 5.0]


def test_cut_stretches_repeat_few_readings(spark, ts, monkeypatch):
    """A busy stretch and a busy time of it: what is moved grows with the rows, not their product."""
    moved, right_t = [], [*range(0, 800, 4), *[900] * 150]
    left_t = [*range(1, 801, 4), *[900] * 150]
    right = spark.createDataFrame([("m", ts(s), float(i)) for i, s in enumerate(right_t)], "module string, t timestamp, v double")
    left = spark.createDataFrame([("m", ts(s), i) for i, s in enumerate(left_t)], "module string, at timestamp, i int")
    union = type(left).unionByName

    def counted(self, other, *options, **named):
        out = union(self, other, *options, **named)
        if "_side" in out.columns:
            moved.append(out.count())
        return out

    monkeypatch.setattr(type(left), "unionByName", counted)
    out = asof_nearest(left, right, ["module"], "at", "t", "v", 100, limit=5).collect()
    assert {r["i"]: r["matched_value"] for r in out} == {i: float(min(i, 199)) if i < 200 else 349.0 for i in range(350)}
    assert moved[0] < 3 * (len(left_t) + len(right_t))


def test_performance_pools_errors(spark, ts):
    rows = [
        ("a", ts(0), 20.0, 21.0), ("a", ts(300), 22.0, 30.0), ("b", ts(0), 10.0, 14.0),
        ("b", ts(10), 10.0, 12.0), ("b", ts(305), 10.0, None), ("b", ts(310), 10.0, None),
    ]
    out = {r["module"]: tuple(r)[1:] for r in forecast_performance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["a"] == (1, 1, 1.0, 1.0, 1, 0)
    assert out["b"] == (2, 0, 3.0, pytest.approx(10**0.5), 0, 0)
    assert out["overall"] == (3, 1, pytest.approx(7 / 3), pytest.approx((21 / 3) ** 0.5), 1, 0)


def test_a_gap_is_missed_and_the_end_not_due(spark, ts):
    rows = [("a", ts(0), 1.0, 1.0), ("a", ts(900), 1.0, 1.0), ("b", ts(0), None, 1.0), ("a", ts(1150), 1.0, None)]
    out = {r["module"]: (r["pending"], r["not_due"], r["missed"])
           for r in forecast_performance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {"a": (2, 1, 1), "b": (1, 1, 0), "overall": (3, 2, 1)}


def test_performance_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in forecast_performance(empty).collect()] == [("overall", 0, 0, None, None, 0, 0)]


def test_status_without_scores(spark, ts):
    status = spark.createDataFrame([("a",), ("z",)], "module string")
    scores = forecast_performance(spark.createDataFrame([("a", ts(0), 1.0, 1.0)], SCHEMA))
    out = {r["module"]: (r["evaluated"], r["pending"], r["accuracy"]) for r in status_with_performance(status, scores).collect()}
    assert out == {"a": (0, 1, None), "z": (0, 0, None)}
