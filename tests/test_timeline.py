import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatline.operators import project, timeline
from heatline.operators.targets import add_future_targets
from heatline.operators.validate import check_horizon, check_unique


def test_resample_equals_pandas_with_gaps_and_nan(spark):
    generator = np.random.default_rng(1)
    start = dt.datetime(2024, 9, 16, 16, 58, 33)
    times = [start + dt.timedelta(seconds=int(s)) for s in np.sort(generator.choice(4000, 900, False))]
    values = generator.normal(25, 1, 900)
    values[::17] = np.nan
    frame = pd.DataFrame({"t": times, "v": values})
    for seconds in (10, 7):
        wanted = frame.set_index("t").resample(f"{seconds}s").mean().dropna()
        df = spark.createDataFrame(frame)
        out = timeline.resample_mean(df, [], "t", seconds, ["v"], origin=start).dropna()
        got = out.toPandas().sort_values("t").set_index("t")
        assert list(got.index) == list(wanted.index)
        assert np.allclose(got["v"], wanted["v"])


def test_collapse_keeps_first_known_text(spark, ts):
    rows = [(ts(0), 1.0, None, 2), (ts(0), 3.0, "b", 1), (ts(0), float("nan"), "c", 3), (ts(1), None, None, 4)]
    df = spark.createDataFrame(rows, "t timestamp, v double, name string, seq int")
    out = {r["t"]: (r["v"], r["name"]) for r in timeline.collapse_duplicates(df, ["t"], ["seq"]).collect()}
    assert out == {ts(0): (2.0, "b"), ts(1): (None, None)}


def test_total_power(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, None), (2.0, 3.0)], "`Power Ch 1 (W)` double, `Power Ch 2 (W)` double"
    )
    assert [r[0] for r in df.select(timeline.total_power(df)).collect()] == [1.0, 0.0, 5.0]
    assert spark.range(1).select(timeline.total_power(spark.range(1))).head()[0] == 0.0


def test_module_means_skip_missing_probes(spark, ts):
    columns = ", ".join(f"`Temperature mod 1 ch {c}` double" for c in (1, 2, 3))
    df = spark.createDataFrame(
        [(ts(0), 1.0, None, 3.0), (ts(1), None, float("nan"), None)], f"event_time timestamp, {columns}"
    )
    wide = timeline.module_table(df, ["event_time"], modules=[1]).orderBy("event_time").collect()
    assert [r["Module_1_Avg_Temp"] for r in wide] == [2.0, None]
    long = timeline.module_means(
        project.probes_long(df, ["event_time"], modules=[1]), ["module", "event_time"]
    )
    assert [r["value"] for r in long.orderBy("event_time").collect()] == [2.0, None]
    with pytest.raises(ValueError, match="Module 2"):
        project.probes_long(df, ["event_time"], modules=[2])


def test_cadence_counts_the_first_row_as_a_break(spark, ts):
    df = spark.createDataFrame([(ts(s),) for s in (0, 10, 20, 20, 45, 55)], "t timestamp")
    row = timeline.cadence(df, [], "t", 10).head()
    assert (row["intervals"], row["exact_ratio"], row["gap_rows"], row["is_regular"]) == (4, 0.75, 2, False)
    counts = [tuple(r) for r in timeline.interval_counts(df, [], "t").collect()]
    assert counts == [(10.0, 3), (25.0, 1)]


def test_target_crosses_no_gap(spark, ts):
    # Row shifts would pair 0 with 310; only exact offsets count.
    df = spark.createDataFrame([(ts(s), float(s)) for s in (0, 10, 300, 311)], "event_time timestamp, v double")
    out = add_future_targets(df, [], columns=["v"], seconds=300, names={"v": "y"})
    assert [(r["v"], r["y"]) for r in check_horizon(out).collect()] == [(0.0, 300.0)]
    with pytest.raises(ValueError, match="300"):
        check_horizon(out.withColumn("target_time", F.col("event_time")))


def test_repeated_times_have_no_target(spark, ts):
    df = spark.createDataFrame([(ts(0), 1.0), (ts(0), 2.0), (ts(5), 3.0)], "event_time timestamp, v double")
    with pytest.raises(Exception, match="more than one row"):
        add_future_targets(df, [], columns=["v"], seconds=5, names={"v": "y"}).collect()
    holes = spark.createDataFrame(
        [(ts(0), None, "a"), (ts(5), float("nan"), None), (None, 1.0, "x"), (ts(10), 4.0, "z")],
        "event_time timestamp, v double, note string",
    )
    out = add_future_targets(holes, [], columns=["v"], seconds=5, names={"v": "y"})
    assert out.columns == ["event_time", "v", "note", "target_time", "y"]
    assert [(r["note"], r["y"]) for r in out.collect()] == [(None, 4.0)]


def test_keys_of_targets_may_be_null(spark, ts):
    rows = [(None, ts(0), 1.0), (None, ts(5), 2.0), ("a", ts(5), 9.0)]
    df = spark.createDataFrame(rows, "site string, event_time timestamp, v double")
    out = add_future_targets(df, ["site"], columns=["v"], seconds=5, names={"v": "y"}).collect()
    assert [(r["site"], r["v"], r["y"]) for r in out] == [(None, 1.0, 2.0)]


def test_checks(spark, ts):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    with pytest.raises(ValueError, match="unique"):
        check_unique(df, ["k"])
    assert check_unique(df, ["k", "n"]) is df
    with pytest.raises(ValueError, match="Missing required columns: x, y"):
        project.require_columns(df, ["k", "x", "y"])
    text = spark.createDataFrame([("2024-09-16 16:58:30",), ("junk",)], "c string")
    assert project.prepare_time(text, "c").count() == 1
    with pytest.raises(ValueError, match="Found 1 invalid"):
        project.prepare_time(text, "c", on_invalid="fail")


def test_empty_rows_and_profile(spark, ts):
    df = spark.createDataFrame([(ts(0),), (ts(0),), (None,), (ts(3),)], "t timestamp")
    row = timeline.profile(df, "t").head()
    assert tuple(row) == (4, 1, 2, 1, ts(0), ts(3))
    assert tuple(timeline.profile(df.limit(0), "t").head())[:4] == (0, 0, 0, 0)


def test_many_rows_are_grouped_in_small_parts(spark):
    """Tasks hold a chunk's groups however many rows there are, and the result is the same."""
    df = spark.range(2000).selectExpr("id % 400 AS k", "timestamp_seconds(id div 400) AS t", "double(id) AS v")
    twice = df.union(df)

    def paired(n):
        once = timeline.collapse_duplicates(twice, ["k", "t"], rows=n)
        return add_future_targets(once, ["k"], "t", ["v"], 1, {"v": "y"}, rows=n)

    wanted = sorted(map(tuple, paired(None).collect()))
    spark.conf.set("spark.heatline.rowsPerChunk", "200")
    try:
        out = paired(4000)
        assert out.rdd.getNumPartitions() == 40
        assert sorted(map(tuple, out.collect())) == wanted and len(wanted) == 1600
    finally:
        spark.conf.unset("spark.heatline.rowsPerChunk")
