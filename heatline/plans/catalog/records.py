"""Messages: validation, time, JSON and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators import ml, monitor
from heatline.operators.features import add_features
from heatline.operators.validate import (
    checked_records,
    checked_requests,
    rejection_events,
    split_valid,
)
from heatline.plans.catalog.base import TL, WIDE, events, module_name, query, wide_table
from heatline.schema import feature_names
from heatline.sources.sinks import json_messages

REQUIRED = ["a", "k"]

# The ways a message can be wrong, by event id, in Spark and in SQL text.
_SHAPES = {
    1: '{"a": "25.1", "k": N}',
    2: '{"k": N}',
    3: '{"a": "x", "k": N}',
    4: '{"a": null, "k": N}',
    5: '{"a": NaN, "k": N}',
    6: '{"a": 1, "k": Infinity}',
    7: "[1]",
    8: "{bad",
    9: '{"a": true, "k": N}',
    10: "{}",
    11: '{"a": "1_000", "k": N}',
    12: '{"a": "1.5f", "k": N}',
}
_REASONS = {
    2: "Missing 1 model features: ['a']",
    3: "Feature a is not numeric",
    4: "Feature a is not numeric",
    5: "Feature a must be finite",
    6: "Feature k must be finite",
    7: "Telemetry payload must be a JSON object",
    8: "Telemetry payload is not valid JSON",
    9: "Feature a is not numeric",
    10: "Missing 2 model features: ['a', 'k']",
    12: "Feature a is not numeric",
}
_KINDS = 16


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def messages(spark, sf):
    """Events as topic messages, some of them malformed."""
    number = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % _KINDS
    value = F.concat(F.lit('{"a": '), F.col("value").cast("string"), F.lit(', "k": '), number, F.lit(', "_replay_id": '), F.col("event_id").cast("string"), F.lit("}"))
    for i, shape in _SHAPES.items():
        head, _, tail = shape.partition("N}")
        made = F.concat(F.lit(head), number, F.lit("}" + tail)) if shape.endswith("N}") else F.lit(shape)
        value = F.when(kind == i, made).otherwise(value)
    return events(spark, sf).select(
        F.lit("site").alias("key"), value.alias("value"), F.lit("telemetry").alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"),
    )


_REASON_SQL = " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in _REASONS.items())
_KEPT = f"event_id % {_KINDS} NOT IN ({', '.join(map(str, _REASONS))})"


@query("p11_valid_records", f"""SELECT event_id AS "offset", ts AS event_time,
  CASE event_id % {_KINDS} WHEN 1 THEN 25.1::DOUBLE WHEN 11 THEN 1000.0 ELSE value END AS a,
  (props::JSON ->> '$.k')::DOUBLE AS k,
  CASE WHEN event_id % {_KINDS} NOT IN (1, 11) THEN event_id END AS replay_id,
  'ingest' AS time_source FROM events WHERE {_KEPT}""")
def p11(spark, sf):
    valid, _ = split_valid(messages(spark, sf), REQUIRED)
    return valid.select("offset", "event_time", "payload.*", "replay_id", "time_source")


@query("p11_rejected_records", f"""SELECT event_id AS "offset",
  CASE event_id % {_KINDS} {_REASON_SQL} END AS reject_reason FROM events WHERE NOT {_KEPT}""")
def p11_rejected(spark, sf):
    _, rejected = split_valid(messages(spark, sf), REQUIRED)
    return rejected.select("offset", "reject_reason")


_ALL = feature_names()


@query("p11_all_features", f"""WITH {WIDE}, m AS (SELECT event_time, (epoch(event_time) // 21600)::BIGINT % 5 AS k FROM w)
  SELECT event_time, CASE k WHEN 1 THEN 'Missing 1 model features: [''{_ALL[0]}'']'
    WHEN 2 THEN 'Feature {_ALL[-1]} is not numeric' WHEN 3 THEN 'Feature {_ALL[60]} must be finite' END AS reject_reason FROM m""")
def p11_all(spark, sf):
    """Every model input of every row, some rows with an input missing, in words or infinite."""
    rows = add_features(wide_table(spark, sf), [], mode="serving").fillna(0.0)
    rows = rows.withColumns({n: F.col(n).cast("double") for n in _ALL})
    kind = F.expr("unix_micros(event_time) div 21600000000 % 5")
    whole = F.to_json(F.struct(*_ALL))
    short = F.to_json(F.struct(*_ALL[1:]))
    wrong = F.to_json(F.struct(*_ALL[:-1], F.lit("much").alias(_ALL[-1])))
    endless = F.to_json(F.struct(*_ALL[:60], F.lit("Infinity").alias(_ALL[60]), *_ALL[61:]))
    value = F.when(kind == 1, short).when(kind == 2, wrong).when(kind == 3, endless).otherwise(whole)
    sent = rows.select("event_time", value.alias("value"), F.col("event_time").alias("timestamp"))
    return checked_records(sent.withColumnRenamed("event_time", "sent"), _ALL).select(
        F.col("sent").alias("event_time"), "reject_reason"
    )


@query("u4_missing_names", f"""SELECT event_id AS "offset", CASE event_id % {_KINDS} WHEN 2 THEN 'a' WHEN 7 THEN 'a,k'
  WHEN 8 THEN 'a,k' WHEN 10 THEN 'a,k' ELSE '' END AS missing FROM events""")
def u4(spark, sf):
    missing = F.array_join("all_missing_features", ",").alias("missing")
    return checked_requests(messages(spark, sf), REQUIRED).select("offset", missing)


@query("x2_rejection_events", f"""SELECT ts AS event_time, 'TELEMETRY_REJECTED' AS event_type, 'ERROR' AS status,
  'Rejected telemetry partition=' || (event_id % 3) || ' offset=' || event_id || ': ' ||
  CASE event_id % {_KINDS} {_REASON_SQL} END AS message FROM events WHERE NOT {_KEPT}""")
def x2(spark, sf):
    return rejection_events(split_valid(messages(spark, sf), REQUIRED)[1])


@query("p12_request_check", f"""SELECT event_id AS "offset",
  CASE WHEN event_id % {_KINDS} IN (7, 8) THEN 422 WHEN event_id % {_KINDS} IN (2, 10) THEN 400
    WHEN NOT {_KEPT} THEN 422 ELSE 200 END AS status_code,
  CASE WHEN event_id % {_KINDS} IN (7, 8) THEN 'Request must be a JSON object.'
    WHEN event_id % {_KINDS} IN (2, 10) THEN 'Missing required features'
    WHEN event_id % {_KINDS} IN (5, 6) THEN 'All model features must be finite.'
    WHEN NOT {_KEPT} THEN 'All model features must be numeric.' END AS detail,
  CASE event_id % {_KINDS} WHEN 2 THEN 1 WHEN 10 THEN 2 WHEN 7 THEN 2 WHEN 8 THEN 2 ELSE 0 END AS missing_count
  FROM events""")
def p12(spark, sf):
    return checked_requests(messages(spark, sf), REQUIRED).select(
        "offset", "status_code", "detail", "missing_count"
    )


@query("f11_finite", """SELECT event_id, event_id % 4 = 0 AS is_finite FROM events""")
def f11(spark, sf):
    kind = F.col("event_id") % 4
    number = (
        F.when(kind == 0, F.col("value")).when(kind == 1, float("nan"))
        .when(kind == 2, float("-inf"))
    )
    return events(spark, sf).select("event_id", S.is_finite(number).alias("is_finite"))


@query("f12_json_round_trip", f"""WITH {TL} SELECT event_id, value, event_id AS replay_id, event_time FROM tl""")
def f12(spark, sf):
    rows = events(spark, sf).select("event_id", "value", F.col("ts").alias("event_time"))
    sent = json_messages(rows, replay_id=F.col("event_id"), key=F.lit("site"))
    layout = "event_id long, value double, event_time string, _replay_id long"
    read = sent.select(F.from_json("value", layout).alias("m")).select("m.*")
    return read.select(
        "event_id", "value", F.col("_replay_id").alias("replay_id"),
        S.parse_time(F.col("event_time")).alias("event_time"),
    )


@query("f13_utc", """SELECT event_id, date_trunc('second', ts) - to_hours((event_id % 5)::INT) AS event_time FROM events""")
def f13(spark, sf):
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0"),
        (F.col("event_id") % 5).cast("string"), F.lit(":00"),
    )
    return events(spark, sf).select("event_id", S.parse_time(text).alias("event_time"))


@query("f15_first_filled", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type
  WHEN event_id % 3 = 1 THEN 'second' END AS name FROM events""")
def f15(spark, sf):
    kind = F.col("event_id") % 3
    return events(spark, sf).select(
        "event_id",
        S.first_filled(
            F.when(kind == 0, F.col("event_type")).when(kind == 1, ""),
            F.when(kind == 1, "second"),
        ).alias("name"),
    )


_MODULES = " UNION ALL ".join(
    f"SELECT event_id, event_time, '{m}' AS module, value + {i}::DOUBLE AS predicted_temperature FROM tl"
    for i, m in enumerate(["Module_1_Avg_Temp", "Module_2_Avg_Temp"], 1)
)


@query("x3_module_rows", f"WITH {TL} {_MODULES}")
def x3(spark, sf):
    rows = events(spark, sf).select("event_id", F.col("ts").alias("event_time"), "value")
    names = ["Module_1_Avg_Temp", "Module_2_Avg_Temp"]
    scored = rows.withColumns({m: F.col("value") for m in names}).withColumns(
        {f"Predicted_{m}": F.col("value") + float(i) for i, m in enumerate(names, 1)}
    )
    out = ml.module_forecasts(scored, ["event_id", "event_time"], names)
    return out.drop("current_temperature")


_RECORDS = f"""{TL}, rec AS (SELECT (event_id % 3)::INT AS kafka_partition,
  CASE WHEN event_id % 101 <> 0 THEN event_id // 7 END AS kafka_offset, module, event_time FROM tl)"""


def _records(spark, sf):
    """Deliveries in which a partition and offset repeat for a module."""
    rows = events(spark, sf)
    return rows.select(
        (F.col("event_id") % 3).cast("int").alias("kafka_partition"),
        F.when(F.col("event_id") % 101 != 0, F.expr("event_id div 7")).alias("kafka_offset"),
        module_name(F.col("user_id")).alias("module"), F.col("ts").alias("event_time"),
    )


@query("j4_new_records", f"""WITH {_RECORDS}, done AS (SELECT * FROM rec WHERE event_time < TIMESTAMP '2024-01-10')
  SELECT DISTINCT kafka_partition, kafka_offset, module FROM rec WHERE kafka_offset IS NOT NULL
    AND (kafka_partition, kafka_offset, module) NOT IN
      (SELECT (kafka_partition, kafka_offset, module) FROM done WHERE kafka_offset IS NOT NULL)
  UNION ALL SELECT kafka_partition, kafka_offset, module FROM rec WHERE kafka_offset IS NULL""")
def j4(spark, sf):
    rows = _records(spark, sf)
    done = rows.filter("event_time < timestamp'2024-01-10'")
    return monitor.new_records(rows, done).drop("event_time")


@query("x4_deduplicated_batch", f"""WITH {_RECORDS} SELECT DISTINCT kafka_partition, kafka_offset, module
  FROM rec WHERE kafka_offset IS NOT NULL
  UNION ALL SELECT kafka_partition, kafka_offset, module FROM rec WHERE kafka_offset IS NULL""")
def x4(spark, sf):
    return monitor.new_records(_records(spark, sf)).drop("event_time")
