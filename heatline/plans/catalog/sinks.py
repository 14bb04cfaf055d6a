"""Sinks written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.operators import alerts, monitor
from heatline.operators.risk import fit_thresholds
from heatline.operators.timeline import probe_counts
from heatline.operators.validate import check_thresholds
from heatline.plans.catalog.base import (
    EVENTS_RAISED,
    MESSAGE,
    PREDICTED,
    THRESHOLDS,
    TL,
    events,
    prediction_table,
    query,
    rounded,
    series,
    telemetry,
)
from heatline.schema import PREDICTIONS
from heatline.session import scratch_path
from heatline.sources import sinks
from heatline.sources.telemetry import read_telemetry, read_thresholds
from heatline.streaming.store import BatchStore


@query("s3_messages", f"""WITH {TL} SELECT module AS key, event_id AS replay_id, value FROM tl""")
def s3(spark, sf):
    rows = telemetry(spark, sf).select("module", "value", "event_id")
    sent = sinks.json_messages(rows, F.col("event_id"), F.col("module"))
    read = F.from_json("value", "value double, _replay_id long")
    return sent.select("key", read.alias("m")).select(
        "key", F.col("m._replay_id").alias("replay_id"), "m.value"
    )


@query("s5_dataset", """SELECT event_id, ts AS event_time, value,
  strftime(ts, '%Y-%m-%d') AS event_date FROM events""")
def s5(spark, sf):
    path = scratch_path(spark, "dataset")
    rows = events(spark, sf).select("event_id", F.col("ts").alias("event_time"), "value")
    sinks.write_dataset(rows, path)
    layout = "event_id long, event_time timestamp, value double, event_date string"
    return spark.read.schema(layout).parquet(path)


@query("s7_report", f"WITH {TL} SELECT module, count(DISTINCT channel) AS channels FROM tl GROUP BY module")
def s7(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_csv(probe_counts(telemetry(spark, sf)), path)
    return read_telemetry(spark, path, "module string, channels long")


@query("s8_thresholds", f"""WITH {THRESHOLDS} SELECT module, round(warning, 6) AS warning, round(critical, 6) AS critical,
  'historical_percentiles' AS source FROM th""")
def s8(spark, sf):
    path = scratch_path(spark, "thresholds")
    sinks.write_thresholds(fit_thresholds(series(spark, sf)), path)
    return rounded(check_thresholds(read_thresholds(spark, path)), "warning", "critical")


_STORED = """event_time, replay_id, kafka_partition, kafka_offset, module, round(current_temperature, 6) AS current_temperature,
  round(predicted_temperature, 6) AS predicted_temperature, risk_level"""


@query("s10_predictions_twice", f"WITH {PREDICTED} SELECT {_STORED} FROM p")
def s10(spark, sf):
    root = scratch_path(spark, "store")
    rows = prediction_table(spark, sf).select(*PREDICTIONS.names)
    for _ in range(2):
        BatchStore(spark, root).write(rows)
    out = BatchStore(spark, root).read("predictions").drop(
        "temperature_delta", "warning_threshold", "critical_threshold"
    )
    return rounded(out, "current_temperature", "predicted_temperature")


@query("s11_alerts", f"""WITH {EVENTS_RAISED} SELECT event_time, kafka_partition, kafka_offset, module,
  risk_level AS alert_level, event_type, {MESSAGE} AS message FROM ev""")
def s11(spark, sf):
    root = scratch_path(spark, "store")
    rows = prediction_table(spark, sf).select(*PREDICTIONS.names)
    store = BatchStore(spark, root)
    store.write(rows)
    store.write(rows)
    return store.read("alerts").select(
        "event_time", "kafka_partition", "kafka_offset", "module", "alert_level", "event_type", "message"
    )


@query("s12_system_events_twice", """SELECT ts AS event_time, upper(event_type) AS event_type, 'SUCCESS' AS status,
  'Event ' || event_id AS message FROM events""")
def s12(spark, sf):
    root = scratch_path(spark, "store")
    rows = events(spark, sf).select(
        F.col("ts").alias("event_time"), F.upper("event_type").alias("event_type"),
        F.lit("SUCCESS").alias("status"),
        F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("message"),
    )
    for _ in range(2):
        BatchStore(spark, root).write(events=rows)
    return BatchStore(spark, root).read("system_events")


@query("s13_json_events", f"""WITH {EVENTS_RAISED} SELECT strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS event_time,
  module, event_type, risk_level AS severity, {MESSAGE} AS message FROM ev""")
def s13(spark, sf):
    path = scratch_path(spark, "alert-log")
    sinks.append_json(alerts.alert_events(prediction_table(spark, sf)), path)
    layout = "event_time string, module string, event_type string, severity string, message string"
    return read_telemetry(spark, path, layout, "json")


@query("t2_latest_system_events", """SELECT ts AS event_time, event_id FROM events WHERE event_type = 'error'
  ORDER BY ts DESC, event_id DESC LIMIT 50""")
def t2(spark, sf):
    rows = events(spark, sf).filter("event_type = 'error'").select(
        F.col("ts").alias("event_time"), "event_id"
    )
    return monitor.latest_n(rows, ["event_time", "event_id"])
