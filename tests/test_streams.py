"""Streams over several micro-batches against their batch twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatline.functions.scalars import parse_time
from heatline.operators import alerts, features as feature_ops, monitor
from heatline.operators.timeline import resample_mean
from heatline.plans.catalog.streams import carried, finished
from heatline.schema import ENVELOPE, MODULES, PREDICTIONS, SYSTEM_EVENTS
from heatline.sources.sinks import append_records
from heatline.sources.telemetry import file_messages, replay_stream
from heatline.streaming.alerts import alert_stream
from heatline.streaming.carried import carried_rows, carried_stream
from heatline.streaming.features import feature_stream
from heatline.streaming.ingest import deduplicated, scoring_stream
from heatline.streaming.lifecycle import LifecycleListener
from heatline.streaming.store import BatchStore, Commits
from heatline.streaming.timeline import matured_forecasts, nearest, resample_stream
from test_features import frame
from test_risk import NAMES, decisions


def in_batches(spark, df, path, parts, time="event_time"):
    """A table as files in time order, one file per micro-batch."""
    rows = df.orderBy(time).collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return replay_stream(spark, str(path), df.schema, files_per_batch=1)


def as_set(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


def test_alerts_over_batches(spark, ts, tmp_path):
    df = decisions(spark, ts, [NAMES[c] for c in "NWWCWCNW"]).unionByName(
        decisions(spark, ts, [NAMES[c] for c in "CCNNWNCN"], "n")
    )
    streamed = carried(in_batches(spark, df, tmp_path / "d", 5), alert_stream)
    assert as_set(streamed) == as_set(alerts.alert_events(df))


def test_carried_batches_are_stored_once(spark, ts, tmp_path):
    """A batch that failed shows nothing; one that was committed is not run again."""
    df = decisions(spark, ts, [NAMES[c] for c in "NWWCWCNW"])
    in_batches(spark, df, tmp_path / "d", 4)
    failing, runs = iter([False, True, False, False, False]), []

    def step(batch, before):
        if next(failing):
            raise OSError("stopped")
        total = batch.count() + (before.head()[0] if before is not None else 0)
        runs.append(total)
        return batch, spark.createDataFrame([(total,)], "total long")

    def run(checkpoint):
        source = replay_stream(spark, str(tmp_path / "d"), df.schema, files_per_batch=1)
        carried_stream(source, str(tmp_path / "r"), str(tmp_path / checkpoint), step).trigger(
            availableNow=True
        ).start().awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        run("c")
    assert carried_rows(spark, str(tmp_path / "r")).count() == 2
    run("c")
    assert runs == [2, 4, 6, 8] and as_set(carried_rows(spark, str(tmp_path / "r"))) == as_set(df)
    commits = Commits(spark, str(tmp_path / "r"))
    assert commits.done(str(tmp_path / "c"), 3) and not commits.done(str(tmp_path / "c"), 4)
    assert not commits.done(str(tmp_path / "other"), 0)


def test_features_over_batches(spark, tmp_path):
    df = spark.createDataFrame(frame(80))
    holes = {m: F.when(F.minute("event_time") % 3 != 1, F.col(m)) for m in MODULES[:2]}
    df = df.withColumn("site", F.lit("s")).unionByName(df.withColumns(holes).withColumn("site", F.lit(None).cast("string")))
    streamed = carried(in_batches(spark, df, tmp_path / "f", 4), feature_stream, keys=["site"]).toPandas()
    batch = feature_ops.add_features(df, ["site"], mode="serving").toPandas()
    streamed, batch = (f.sort_values(["site", "event_time"], ignore_index=True) for f in (streamed, batch))
    pd.testing.assert_frame_equal(streamed[batch.columns], batch, check_exact=False, rtol=1e-9)


def test_duplicates_across_batches(spark, ts, tmp_path):
    rows = [(0, i % 6, "m", ts(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "kafka_partition int, kafka_offset long, module string, event_time timestamp")
    out = finished(deduplicated(in_batches(spark, df, tmp_path / "x", 4), "1 hour"))
    assert out.count() == 6
    rows += [(None, 1, "m", ts(3)), (0, None, "m", ts(3)), (0, None, "m", ts(9))]
    df = spark.createDataFrame(rows, df.schema)
    streamed = finished(deduplicated(in_batches(spark, df, tmp_path / "y", 4), "1 hour"))
    assert streamed.count() == 9 == monitor.new_records(df).count()


def test_maturation_over_batches(spark, ts, tmp_path):
    rows = [("m", ts(10 * i), 20.0 + i % 7, 21.0 + i % 5) for i in range(100) if i not in (45, 46, 47, 48, 49, 50, 51, 52, 53)]
    # Equal forecasts, readings that are none, and two readings at one time.
    rows += [rows[3], rows[3], ("m", ts(35), float("nan"), 21.0), ("m", ts(320), None, float("nan")), ("m", ts(600), 3.0, None)]
    rows += [("n", ts(10 * i + 3), 30.0 + i % 4, 31.0) for i in range(0, 100, 7)]
    df = spark.createDataFrame(rows, "module string, event_time timestamp, current_temperature double, predicted_temperature double")
    source = in_batches(spark, df, tmp_path / "p", 6)
    again = replay_stream(spark, str(tmp_path / "p"), df.schema, files_per_batch=1)
    out = finished(matured_forecasts(source, again))
    wanted = monitor.scored_forecasts(df).select(*out.columns)
    due = wanted.filter(F.col("target_time") < F.lit(ts(990 - 60 - 30)))
    assert as_set(out) == as_set(due)
    assert out.filter("matched_time IS NULL").count() > 0


def test_maturation_forms_no_pairs(spark, ts, tmp_path):
    """Forecasts look their reading up; a join by bucket would make all pairs of a busy one."""
    df = spark.createDataFrame([("m", ts(0), 1.0, 1.0)], "module string, event_time timestamp, current_temperature double, predicted_temperature double")
    df.write.parquet(str(tmp_path / "p"))
    source, again = (replay_stream(spark, str(tmp_path / "p"), df.schema) for _ in range(2))
    assert "Join" not in matured_forecasts(source, again)._jdf.queryExecution().analyzed().toString()


def test_nearest_equals_all_pairs():
    generator = np.random.default_rng(4)
    targets, times = generator.integers(0, 500, 300), generator.integers(0, 500, 120)
    values = generator.integers(0, 9, 120) / 4
    for reach, n in ((3, 120), (0, 120), (1000, 120), (3, 1), (3, 0)):
        found = nearest(targets, times[:n], values[:n], reach)
        for target, time, value in zip(targets, *found):
            near = [(abs(t - target), t, -v if t <= target else v, v) for t, v in zip(times[:n], values[:n]) if abs(t - target) <= reach]
            assert (time, value) == (min(near)[1], min(near)[3]) if near else np.isnan(value) and time == np.iinfo("i8").min


def test_late_rows_are_left_out(spark, ts, tmp_path):
    schema = "module string, event_time timestamp, value double"
    first = spark.createDataFrame([("m", ts(s), 1.0) for s in (0, 4, 100, 200)], schema)
    path = str(tmp_path / "r")
    first.coalesce(1).write.parquet(path)
    # A row is late once the watermark of the batch before is past its bucket.
    for rows in ([("m", ts(300), 1.0)], [("m", ts(5), 99.0), ("m", ts(400), 1.0)]):
        more = spark.createDataFrame(rows, schema)
        more.coalesce(1).write.mode("append").parquet(path)
    source = replay_stream(spark, path, schema, files_per_batch=1)
    out = finished(resample_stream(source, ["module"], "event_time", 10, ["value"], "30 seconds"))
    kept = first.union(spark.createDataFrame([("m", ts(300), 1.0)], schema))
    assert as_set(out) == as_set(resample_mean(kept, ["module"], "event_time", 10, ["value"]))


LEVELS = "module string, warning double, critical double"


def topic(spark, ts, path, values, start=0, partition=0):
    rows = [("k", v, "t", partition, start + i, ts(start + i)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(str(path))


def score(spark, path, checkpoint, modules=("a", "b")):
    levels = spark.createDataFrame([("a", 27.05, 27.30)], LEVELS)
    scoring_stream(
        file_messages(spark, str(path / "topic"), files_per_batch=1), list(modules),
        lambda d: d.withColumns({f"Predicted_{m}": F.col(m) for m in modules}),
        levels, str(path / "store"), str(path / checkpoint), list(modules),
    ).trigger(availableNow=True).start().awaitTermination()


def shown(spark, path):
    return {t: as_set(BatchStore(spark, str(path / "store")).read(t)) for t in ("predictions", "alerts", "system_events")}


FIRST = ['{"a": 27.14, "b": 1}', '{"a": "x", "b": 1}', '{"a": 26.0, "b": 1}', "[1]", '{"a": 27.2, "b": 1}']
SECOND = ['{"a": 27.2, "b": 1}', '{"a": 27.5, "b": 1}', '{"a": 20, "b": 1}']


def test_scoring_survives_a_repeat(spark, ts, tmp_path):
    topic(spark, ts, tmp_path / "topic", FIRST)
    topic(spark, ts, tmp_path / "topic", SECOND, start=5)
    wanted = None
    for checkpoint in ("c1", "c1", "c2"):  # a restart, then a full redelivery
        score(spark, tmp_path, checkpoint)
        found = shown(spark, tmp_path)
        assert [len(found[t]) for t in ("predictions", "alerts", "system_events")] == [6, 5, 8]
        assert wanted in (None, found)
        wanted = found
    # The alerts of the second batch go on from the first one's risks.
    store = BatchStore(spark, str(tmp_path / "store"))
    levels = [(r.kafka_offset, r.alert_level) for r in store.read("alerts").orderBy("kafka_offset").collect()]
    assert levels == [(0, "WARNING"), (2, "NORMAL"), (4, "WARNING"), (6, "CRITICAL"), (7, "NORMAL")]
    assert as_set(store.marks()) == [("0", "7")] and as_set(store.risks()) == [("a", "NORMAL")]


@pytest.mark.parametrize("step", range(4))
def test_a_batch_that_stops_half_way_shows_nothing(spark, ts, tmp_path, monkeypatch, step):
    topic(spark, ts, tmp_path / "topic", FIRST)
    score(spark, tmp_path, "c")
    before = shown(spark, tmp_path)
    topic(spark, ts, tmp_path / "topic", SECOND, start=5)
    steps = iter(range(9))

    def stopping(method):
        def run(self, *args):
            if next(steps) == step:
                raise OSError("stopped")
            return method(self, *args)

        return run

    with monkeypatch.context() as broken:
        broken.setattr(BatchStore, "_append", stopping(BatchStore._append))
        broken.setattr(Commits, "add", stopping(Commits.add))
        with pytest.raises(Exception, match="stopped"):
            score(spark, tmp_path, "c")
    assert shown(spark, tmp_path) == before
    score(spark, tmp_path, "c")
    other = tmp_path / "whole"
    topic(spark, ts, other / "topic", FIRST)
    topic(spark, ts, other / "topic", SECOND, start=5)
    score(spark, other, "c")
    assert shown(spark, tmp_path) == shown(spark, other)


def test_new_offsets_read_nothing_stored(spark, ts, tmp_path, monkeypatch):
    schema = "event_time timestamp, kafka_partition int, kafka_offset long, module string, risk_level string"

    def rows(offsets, partition=0):
        made = [(ts(o or 0), partition, o, m, "NORMAL") for o in offsets for m in "ab"]
        made = spark.createDataFrame(made, schema)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in PREDICTIONS if f.name not in made.columns}
        return made.withColumns(missing)

    store = BatchStore(spark, str(tmp_path))
    store.write(rows(range(0, 20, 2)))
    with monkeypatch.context() as watched:
        watched.setattr(BatchStore, "_stored_days", lambda *a: pytest.fail("read"))
        store.write(rows(range(20, 30)))
        store.write(rows([3], partition=1))
    assert store.read("predictions").count() == 2 * (10 + 10 + 1)
    # A late offset is new, a repeated one is not, and rows without one all stay.
    BatchStore(spark, str(tmp_path)).write(rows([2, 3, 4, 29, 30, None, None]))
    found = BatchStore(spark, str(tmp_path)).read("predictions")
    assert found.filter("kafka_offset IS NULL").count() == 4
    assert found.filter("kafka_partition = 0 AND kafka_offset IS NOT NULL").count() == 2 * (10 + 10 + 2)
    assert found.distinct().count() == 2 * (10 + 10 + 1 + 2 + 1)


def test_events_at_other_times_are_kept(spark, ts, tmp_path):
    rows = [(ts(s), "WORKER", "OK", "worker started") for s in (0, 0, 10_800)]
    for part in (rows[:2], rows, rows):
        frame = spark.createDataFrame(part, "event_time timestamp, event_type string, status string, message string")
        BatchStore(spark, str(tmp_path)).write(events=frame)
    assert BatchStore(spark, str(tmp_path)).read("system_events").count() == 2


def test_years_beyond_the_calendar(spark):
    found = spark.createDataFrame([("+12024-01-01T00:00:00",), ("2024-01-01T00:00:00",)], "t string")
    assert [r[0] is None for r in found.select(parse_time(F.col("t"))).collect()] == [True, False]


def test_lifecycle(spark, ts, tmp_path):
    import time

    path = str(tmp_path / "events")
    listener = LifecycleListener(spark, lambda df: append_records(df, path))
    spark.streams.addListener(listener)
    try:
        df = decisions(spark, ts, ["NORMAL"])
        finished(in_batches(spark, df, tmp_path / "l", 1))
        for _ in range(60):
            try:
                found = {r["status"] for r in spark.read.parquet(path).collect()}
            except Exception:
                found = set()
            if found >= {"STARTED", "STOPPED"}:
                break
            time.sleep(0.5)
        assert found == {"STARTED", "STOPPED"}
        assert set(SYSTEM_EVENTS.names) <= set(spark.read.parquet(path).columns)
    finally:
        spark.streams.removeListener(listener)
