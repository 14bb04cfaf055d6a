"""Streaming operators run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.operators import ml
from heatline.operators.monitor import latest_per_key
from heatline.operators.targets import add_future_targets
from heatline.operators.validate import checked_records
from heatline.plans.catalog.base import (
    EVENTS,
    EVENTS_RAISED,
    HORIZON,
    HOUR,
    MESSAGE,
    TL,
    PREDICTED,
    R,
    TOLERANCE,
    WIDE,
    module_name,
    prediction_table,
    predictions,
    query,
    risk_sql,
    rounded,
    series,
    wide,
    wide_table,
)
from heatline.plans.catalog.features import _feature_sql
from heatline.plans.catalog.monitor import ASOF
from heatline.plans.catalog.records import _KEPT, _KINDS, _REASON_SQL, REQUIRED, messages
from heatline.operators.risk import fit_thresholds
from heatline.schema import MODULES, feature_names
from heatline.session import scratch_path
from heatline.sources.sinks import json_messages
from heatline.sources.telemetry import file_messages, replay_stream
from heatline.streaming.alerts import alert_stream, risk_changes
from heatline.streaming.carried import carried_rows
from heatline.streaming.features import feature_stream
from heatline.streaming.ingest import deduplicated, scoring_stream
from heatline.streaming.store import BatchStore
from heatline.streaming.timeline import matured_forecasts, resample_stream


def _finish(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def finished(stream: DataFrame) -> DataFrame:
    """Run a stream over everything its source holds and read back its table."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    sink = stream.writeStream.format("parquet").option("path", f"{path}/table")
    _finish(sink.option("checkpointLocation", f"{path}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def carried(stream: DataFrame, start, **options) -> DataFrame:
    """The same for a stream that carries a table from batch to batch."""
    root = scratch_path(stream.sparkSession, "carried")
    _finish(start(stream, root, f"{root}/checkpoint", **options))
    return carried_rows(stream.sparkSession, root)


def replayed(df: DataFrame) -> DataFrame:
    """A table written out and read again as a stream."""
    path = scratch_path(df.sparkSession, "replay")
    df.write.parquet(path)
    return replay_stream(df.sparkSession, path, df.schema)


def event_stream(spark, sf) -> DataFrame:
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return source.select(
        "event_id", module_name(F.col("user_id")).alias("module"),
        F.col("ts").alias("event_time"), "value",
    )


def _scored(spark, sf, table: str) -> DataFrame:
    source = scratch_path(spark, "topic")
    messages(spark, sf).write.parquet(source)
    root = scratch_path(spark, "store")
    levels = spark.range(1).selectExpr("'a' AS module", "20.0D AS warning", "50.0D AS critical")
    writer = scoring_stream(
        file_messages(spark, source), REQUIRED,
        lambda rows: rows.withColumn("Predicted_a", F.col("a") + F.col("k") / 100),
        levels, root, scratch_path(spark, "checkpoint"), ["a"],
    )
    _finish(writer)
    return BatchStore(spark, root).read(table)


_A = f"""CASE event_id % {_KINDS} WHEN 1 THEN 25.1::DOUBLE WHEN 11 THEN 1000.0 ELSE value END"""


@query("x1_scoring_stream", f"""WITH m AS (SELECT event_id, ts, {_A} AS a, (props::JSON ->> '$.k')::DOUBLE AS k
    FROM events WHERE {_KEPT}), f AS (SELECT *, a + k / 100 AS p FROM m)
  SELECT ts AS event_time, (event_id % 3)::INT AS kafka_partition, event_id AS kafka_offset, 'a' AS module,
  round(a, 6) AS current_temperature, round(p, 6) AS predicted_temperature,
  {risk_sql('p', '(p - a)', '20.0::DOUBLE', '50.0::DOUBLE')} AS risk_level FROM f""")
def x1(spark, sf):
    out = _scored(spark, sf, "predictions").select(
        "event_time", "kafka_partition", "kafka_offset", "module", "current_temperature",
        "predicted_temperature", "risk_level",
    )
    return rounded(out, "current_temperature", "predicted_temperature")


@query("x2_rejection_stream", f"""SELECT ts AS event_time, 'TELEMETRY_REJECTED' AS event_type, 'ERROR' AS status,
  'Rejected telemetry partition=' || (event_id % 3) || ' offset=' || event_id || ': ' ||
  CASE event_id % {_KINDS} {_REASON_SQL} END AS message FROM events WHERE NOT {_KEPT}""")
def x2(spark, sf):
    return _scored(spark, sf, "system_events")


# Six-hourly rows of all modules as messages; the eighth module has no thresholds.
_MESSAGE_NUMBER = "(epoch(event_time) // 21600)::BIGINT"
_UNKNOWN = MODULES[-1]
_LIVE = f"""{WIDE}, msg AS (SELECT *, {_MESSAGE_NUMBER} AS n,
    concat_ws(', ', {', '.join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in MODULES)}) AS gone FROM w),
  good AS (SELECT * FROM msg WHERE gone = ''), u AS ({' UNION ALL '.join(f"SELECT event_time, n, '{m}' AS module, {m} AS value FROM good" for m in MODULES)}),
  th AS (SELECT module, quantile_cont(value, 0.8::DOUBLE) AS warning, quantile_cont(value, 0.95::DOUBLE) AS critical
    FROM ({' UNION ALL '.join(f"SELECT '{m}' AS module, {m} AS value FROM w" for m in MODULES if m != _UNKNOWN)}) GROUP BY module),
  p AS (SELECT event_time, n AS replay_id, (n % 3)::INTEGER AS kafka_partition, n AS kafka_offset, module,
    value AS current_temperature, value + 0.6::DOUBLE AS predicted_temperature, warning AS warning_threshold,
    critical AS critical_threshold, {risk_sql('(value + 0.6::DOUBLE)', '((value + 0.6::DOUBLE) - value)')} AS risk_level
    FROM u JOIN th USING (module)),
  ch AS (SELECT *, lag(risk_level, 1, 'NORMAL') OVER (PARTITION BY module ORDER BY event_time) AS previous_risk FROM p),
  ev AS (SELECT * FROM (SELECT *,
    CASE WHEN previous_risk = 'NORMAL' AND risk_level <> 'NORMAL' THEN 'TEMPERATURE_ALERT'
         WHEN previous_risk = 'WARNING' AND risk_level = 'CRITICAL' THEN 'TEMPERATURE_ALERT'
         WHEN previous_risk <> 'NORMAL' AND risk_level = 'NORMAL' THEN 'TEMPERATURE_RECOVERY' END AS event_type
    FROM ch) WHERE event_type IS NOT NULL)"""


def _live(spark, sf, table: str) -> DataFrame:
    """The topic run through, delivered again in full to a second run, and read back."""
    rows = wide_table(spark, sf)
    number = F.expr("unix_micros(event_time) div 21600000000")
    source, root = scratch_path(spark, "topic"), scratch_path(spark, "store")
    numbered = rows.select(*MODULES, "event_time", number.alias("_replay_id"))
    sent = json_messages(numbered, F.col("_replay_id"), F.lit("site"))
    number = F.get_json_object("value", "$._replay_id").cast("long")
    sent.select(
        "key", "value", F.lit("telemetry").alias("topic"), (number % 3).cast("int").alias("partition"),
        number.alias("offset"), F.timestamp_micros(number * 21_600_000_000).alias("timestamp"),
    ).write.parquet(source)
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("module"), F.col(m).alias("value")) for m in MODULES if m != _UNKNOWN
    ])).alias("r")).select("r.*")
    levels = fit_thresholds(long, warning=0.8, critical=0.95)
    for _ in range(2):
        _finish(scoring_stream(
            file_messages(spark, source), MODULES,
            lambda d: d.withColumns({f"Predicted_{m}": F.col(m) + 0.6 for m in MODULES}),
            levels, root, scratch_path(spark, "checkpoint"),
        ))
    return BatchStore(spark, root).read(table)


@query("x1_live_predictions", f"""WITH {_LIVE} SELECT event_time, replay_id, kafka_partition, kafka_offset, module,
  round(current_temperature, 6) AS current_temperature, round(predicted_temperature, 6) AS predicted_temperature,
  round(warning_threshold, 6) AS warning_threshold, round(critical_threshold, 6) AS critical_threshold, risk_level FROM p""")
def x1_live(spark, sf):
    out = _live(spark, sf, "predictions").drop("temperature_delta")
    return rounded(out, "current_temperature", "predicted_temperature", "warning_threshold", "critical_threshold")


@query("x5_live_alerts", f"""WITH {_LIVE} SELECT event_time, replay_id, kafka_partition, kafka_offset, module,
  risk_level AS alert_level, event_type, {MESSAGE} AS message FROM ev""")
def x5_live(spark, sf):
    return _live(spark, sf, "alerts").select(
        "event_time", "replay_id", "kafka_partition", "kafka_offset", "module", "alert_level", "event_type", "message"
    )


@query("j5_live_quarantine", f"""WITH {_LIVE}, bad AS (
    SELECT event_time, n, 'Feature ' || split_part(gone, ', ', 1) || ' is not numeric' AS reason FROM msg WHERE gone <> ''
    UNION ALL SELECT event_time, n, 'No threshold found for {_UNKNOWN}' FROM good)
  SELECT event_time, 'TELEMETRY_REJECTED' AS event_type, 'ERROR' AS status,
  'Rejected telemetry partition=' || (n % 3) || ' offset=' || n || ': ' || reason AS message FROM bad""")
def j5_live(spark, sf):
    return _live(spark, sf, "system_events")


@query("x3_module_stream", f"""WITH {TL} SELECT event_id, m AS module, value AS current_temperature,
  value + 1.0::DOUBLE AS predicted_temperature FROM tl, (VALUES ('Module_1_Avg_Temp'), ('Module_2_Avg_Temp')) t(m)""")
def x3(spark, sf):
    names = ["Module_1_Avg_Temp", "Module_2_Avg_Temp"]
    scored = event_stream(spark, sf).withColumns({m: F.col("value") for m in names}).withColumns(
        {f"Predicted_{m}": F.col("value") + 1.0 for m in names}
    )
    return finished(ml.module_forecasts(scored, ["event_id"], names))


@query("x4_deduplicated_stream", f"""WITH {TL} SELECT DISTINCT (event_id % 3)::INT AS kafka_partition,
  event_id // 21 AS kafka_offset, module FROM tl""")
def x4(spark, sf):
    repeated = event_stream(spark, sf).select(
        (F.col("event_id") % 3).cast("int").alias("kafka_partition"),
        F.expr("event_id div 21").alias("kafka_offset"), "module", "event_time",
    )
    return finished(deduplicated(repeated, "40 days")).drop("event_time")


@query("x5_alert_stream", f"""WITH {EVENTS_RAISED} SELECT module, event_time, event_type,
  risk_level AS severity, {MESSAGE} AS message FROM ev""")
def x5(spark, sf):
    decisions = replayed(predictions(spark, sf))
    return carried(decisions, alert_stream).select(
        "module", "event_time", "event_type", "severity", "message"
    )


@query("x6_restored_stream", f"""WITH {PREDICTED}, late AS (SELECT * FROM p WHERE event_time >= TIMESTAMP '2024-01-15'),
  old AS (SELECT module, arg_max(risk_level, event_time) AS risk_level FROM p
    WHERE event_time < TIMESTAMP '2024-01-15' GROUP BY module),
  c AS (SELECT late.module, event_time, late.risk_level,
    coalesce(lag(late.risk_level) OVER (PARTITION BY late.module ORDER BY event_time), old.risk_level, 'NORMAL') AS previous_risk
    FROM late LEFT JOIN old USING (module))
  SELECT * FROM c WHERE risk_level <> previous_risk""")
def x6(spark, sf):
    rows = prediction_table(spark, sf).select("module", "event_time", "risk_level")
    restart = F.lit("2024-01-15").cast("timestamp")
    before = latest_per_key(
        rows.filter(F.col("event_time") < restart), ["module"], ["event_time"]
    ).drop("event_time")
    after = replayed(rows.filter(F.col("event_time") >= restart))
    return carried(after, risk_changes, initial=before)


@query("x12_streaming_inference", f"""WITH {R}, pr AS (SELECT a.module, a.event_time, b.value AS actual, a.value AS predicted
  FROM r a JOIN r b ON a.module = b.module AND a.event_time + INTERVAL 5 HOUR = b.event_time),
  fit AS (SELECT regr_slope(actual, predicted) AS k, regr_intercept(actual, predicted) AS c FROM pr)
  SELECT module, event_time, round(k * value + c, 4) AS predicted FROM r, fit""")
def x12(spark, sf):
    rows = series(spark, sf)
    paired = add_future_targets(
        rows, ["module"], columns=["value"], seconds=HORIZON, names={"value": "target"}
    )
    model = ml.fit_per_target(paired, ["value"], ["target"], ["value"])
    out = finished(ml.score(replayed(rows), model))
    return rounded(out.withColumnRenamed("Predicted_value", "predicted").drop("value"), "predicted", digits=4)


@query("x7_event_time", f"""WITH {TL} SELECT event_id, event_id AS replay_id, event_time FROM tl""")
def x7(spark, sf):
    sent = event_stream(spark, sf).select(
        "event_id",
        F.to_json(F.struct(
            F.lit(1).alias("a"), F.col("event_id").alias("_replay_id"),
            F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        )).alias("value"),
        F.current_timestamp().alias("timestamp"),
    )
    return finished(checked_records(sent, ["a"]).select("event_id", "replay_id", "event_time"))


# A forecast is sent once its tolerance lies behind the watermark, which trails
# the newest reading by the allowed delay.
@query("x8_matured_forecasts", f"""WITH {ASOF} SELECT module, event_time, target_time, predicted AS predicted_temperature,
  matched_time, matched_value FROM m WHERE target_time < (SELECT max(event_time) FROM tl) - INTERVAL 31 MINUTE""")
def x8(spark, sf):
    def source(name):
        return event_stream(spark, sf).select(
            "module", "event_time", F.col("value").alias(name)
        )

    return finished(
        matured_forecasts(
            source("predicted_temperature"), source("current_temperature"),
            horizon_seconds=HORIZON, tolerance_seconds=TOLERANCE,
        )
    )


@query("x9_resample_stream", f"""WITH {TL}, r AS (SELECT module, time_bucket(INTERVAL '1 hour', event_time) AS event_time,
    avg(value) AS value FROM tl GROUP BY ALL)
  SELECT module, event_time, round(value, 6) AS value FROM r
  WHERE event_time + INTERVAL 1 HOUR <= (SELECT max(event_time) FROM tl) - INTERVAL 1 MINUTE""")
def x9(spark, sf):
    out = resample_stream(event_stream(spark, sf), ["module"], "event_time", HOUR, ["value"])
    return rounded(finished(out), "value")


_SERVING = _feature_sql(True)


@query("x11_feature_stream", f"""WITH {WIDE} SELECT event_time,
  {', '.join(f'round(({_SERVING[n]})::DOUBLE, 9) AS {n}' for n in feature_names())} FROM w""")
def x11(spark, sf):
    rows = wide(spark, sf).withColumn("site", F.lit("site"))
    out = carried(replayed(rows), feature_stream, keys=["site"]).drop("site")
    names = feature_names()
    return rounded(out.withColumns({n: F.col(n).cast("double") for n in names}), *names, digits=9)
