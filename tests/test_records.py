import pytest
from pyspark.sql import functions as F

from heatline.operators.monitor import new_records
from heatline.operators.validate import checked_requests, rejection_events, split_valid
from heatline.plans.live import decisions
from heatline.schema import ENVELOPE

CASES = [
    ('{"a":25.1,"b":1.5}', None), ('{"a":"25.1","b":1.5}', None), ('{"a":25.1}', "Missing 1 model features: ['b']"),
    ('{"a":"x","b":1}', "Feature a is not numeric"), ('{"a":null,"b":1}', "Feature a is not numeric"),
    ('{"a":NaN,"b":1}', "Feature a must be finite"), ('{"a":1,"b":-Infinity}', "Feature b must be finite"),
    ('{"a":"inf","b":1}', "Feature a must be finite"), ("[1]", "Telemetry payload must be a JSON object"),
    ("{bad", "Telemetry payload is not valid JSON"), ('{"a":true,"b":1}', "Feature a is not numeric"),
    ('{"a":{"x":1},"b":1}', "Feature a is not numeric"), ('{"a":" 1e3 ","b":1}', None),
    ('"text"', "Telemetry payload must be a JSON object"),
]


def envelopes(spark, ts, values):
    rows = [("k", v, "t", 0, i, ts(i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ENVELOPE)


def test_record_rules(spark, ts):
    valid, rejected = split_valid(envelopes(spark, ts, [c[0] for c in CASES]), ["a", "b"])
    reasons = {r["offset"]: r["reject_reason"] for r in rejected.collect()}
    assert reasons == {i: why for i, (_, why) in enumerate(CASES) if why}
    values = {r["offset"]: r["payload"]["a"] for r in valid.collect()}
    assert values == {0: 25.1, 1: 25.1, 12: 1000.0}
    messages = {r["message"] for r in rejection_events(rejected).collect()}
    assert "Rejected telemetry partition=0 offset=2: Missing 1 model features: ['b']" in messages


@pytest.mark.parametrize(
    "clock, seconds",
    [("2024-09-16T16:58:30Z", 0), ("2024-09-16T16:58:30", 0), ("2024-09-16 16:58:30", 0),
     ("09/16/2024 16:58:30", 0), ("2024-09-16T16:58:30.25+0200", -7199.75),
     ("2024-09-16T16:58:30.123456+00:00", 0.123456), (" 2024-9-16T16:58:30 ", 0)],
)
def test_event_time(spark, ts, clock, seconds):
    for field in ("Time [Date/Time]", "timestamp"):
        df = envelopes(spark, ts, [f'{{"a": 1, "{field}": "{clock}"}}']).withColumn(
            "timestamp", F.lit(ts(999))
        )
        row = split_valid(df, ["a"])[0].head()
        assert (row["event_time"], row["time_source"]) == (ts(seconds), "event")


def test_arrival_time_stands_in(spark, ts):
    values = ['{"a": 1, "timestamp": "junk"}', '{"a": 1}', '{"a": 1, "Time [Date/Time]": "", "timestamp": "2024-09-16T16:58:35"}']
    rows = split_valid(envelopes(spark, ts, values), ["a"])[0].orderBy("offset").collect()
    assert [(r["event_time"], r["time_source"]) for r in rows] == [
        (ts(0), "ingest"), (ts(1), "ingest"), (ts(5), "event")]


def test_requests(spark, ts):
    names = [f"f{i}" for i in range(25)]
    full = "{" + ", ".join(f'"{n}": 1' for n in names) + "}"
    df = envelopes(spark, ts, [full, "{}", full.replace('"f3": 1', '"f3": "x"'), full.replace('"f3": 1', '"f3": NaN')])
    rows = checked_requests(df, names).orderBy("offset").collect()
    assert [r["status_code"] for r in rows] == [200, 400, 422, 422]
    assert rows[1]["missing_count"] == 25 and rows[1]["missing_features"] == names[:20]
    assert rows[2]["detail"] == "All model features must be numeric."
    assert rows[3]["detail"] == "All model features must be finite."


def test_requests_keep_every_missing_name(spark, ts):
    names = [f"f{i}" for i in range(25)]
    row = checked_requests(envelopes(spark, ts, ['{"f3": 1}']), names).head()
    assert row["all_missing_features"] == [n for n in names if n != "f3"]


def test_replay_adds_nothing(spark, ts):
    rows = [(0, 10, "a", ts(0)), (0, 10, "a", ts(0)), (0, 10, "b", ts(0)), (None, 1, "a", ts(1)), (None, 1, "a", ts(1))]
    df = spark.createDataFrame(rows, "kafka_partition int, kafka_offset long, module string, event_time timestamp")
    assert new_records(df).count() == 4
    traced = df.filter("kafka_partition IS NOT NULL")
    assert new_records(traced, traced).count() == 0


def test_live_batch(spark, ts):
    levels = spark.createDataFrame([("a", 27.05, 27.30)], "module string, warning double, critical double")
    messages = envelopes(spark, ts, ['{"a": 27.14, "_replay_id": 1}', '{"a": "x"}'])
    rows, rejected = decisions(
        messages, ["a"], lambda d: d.withColumn("Predicted_a", F.col("a") - 0.08), levels, ["a"]
    )
    row = rows.head()
    assert (row["replay_id"], row["kafka_offset"], row["risk_level"]) == (1, 0, "WARNING")
    assert row["temperature_delta"] == pytest.approx(-0.08)
    assert rejected.count() == 1
