"""Scans, cleaning, collapsing, cadence and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators import project, timeline
from heatline.operators.scale import with_position
from heatline.operators.targets import add_future_targets
from heatline.operators.validate import duplicate_keys, horizon_report
from heatline.plans.catalog.base import (
    HORIZON,
    HOUR,
    R,
    STEP,
    TL,
    WIDE,
    events,
    hourly,
    lineitem,
    query,
    rounded,
    telemetry,
    wide,
    wide_rows,
)
from heatline.plans.training import persistence_by_module
from heatline.schema import MODULES, PROBE_PREFIX, TARGETS, TOTAL_POWER

_KEYS = ["l_suppkey", "l_shipdate"]
_ROUNDED_WIDE = ", ".join(f"round({c}, 6) AS {c}" for c in [*MODULES, TOTAL_POWER])


@query("s1_scan", "SELECT event_id, ts AS event_time, event_type, value FROM events WHERE value > 20")
def s1(spark, sf):
    return events(spark, sf).filter("value > 20").select(
        "event_id", F.col("ts").alias("event_time"), "event_type", "value"
    )


@query("s4_replay_order", """SELECT event_id, ts AS event_time,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS replay_id FROM events""")
def s4(spark, sf):
    rows = events(spark, sf).select("event_id", F.col("ts").alias("event_time"))
    return with_position(rows, [], ["event_time", "event_id"], "replay_id")


@query("s6_replay_projection", f"WITH {WIDE} SELECT event_time, {_ROUNDED_WIDE} FROM w")
def s6(spark, sf):
    return rounded(project.replay_table(wide(spark, sf)), *MODULES, TOTAL_POWER)


@query("p1_required_columns", "SELECT event_id, ts, value FROM events")
def p1(spark, sf):
    needed = ["event_id", "ts", "value"]
    return project.require_columns(events(spark, sf), needed).select(*needed)


_TEXT_TIME = """CASE WHEN event_id % 11 = 0 THEN 'not a time' WHEN event_id % 13 = 0 THEN NULL
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"""


@query("p2_prepare_time", f"""SELECT event_id, t AS event_time FROM (
  SELECT event_id, try_strptime({_TEXT_TIME}, '%Y-%m-%d %H:%M:%S') AS t FROM events) WHERE t IS NOT NULL""")
def p2(spark, sf):
    text = (
        F.when(F.col("event_id") % 11 == 0, "not a time")
        .when(F.col("event_id") % 13 == 0, None)
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    rows = events(spark, sf).select("event_id", text.alias("clock"))
    return project.prepare_time(rows, "clock").drop("clock")


@query("p3_event_time", """SELECT event_id, CASE event_id % 8
    WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
    WHEN 2 THEN ts WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('second', ts)
    WHEN 5 THEN date_trunc('second', ts) ELSE TIMESTAMP '2024-03-01 00:00:00' END AS event_time,
  CASE WHEN event_id % 8 < 6 THEN 'event' ELSE 'ingest' END AS time_source FROM events""")
def p3(spark, sf):
    kind = F.col("event_id") % 8
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(kind == 0, F.concat(micros, F.lit("Z")))
        .when(kind == 1, F.concat(seconds, F.lit("+0200")))
        .when(kind == 2, micros)
        .when(kind == 3, seconds)
        .when(kind == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 5, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
        .when(kind == 6, "junk")
    )
    even = F.col("event_id") % 2 == 0
    rows = events(spark, sf).select(
        "event_id",
        F.when(even, text).otherwise("").alias("first"),
        F.when(~even, text).alias("second"),
        F.to_timestamp(F.lit("2024-03-01 00:00:00")).alias("arrived"),
    )
    return project.event_time(rows, ["first", "second"], "arrived").select(
        "event_id", "event_time", "time_source"
    )


@query("p4_drop_targets", f"WITH {R} SELECT module, event_time, round(value, 6) AS value FROM r")
def p4(spark, sf):
    rows = hourly(spark, sf).withColumns({t: F.col("value") + 1 for t in TARGETS})
    return rounded(project.drop_targets(rows), "value")


@query("p5_numeric_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax FROM lineitem""")
def p5(spark, sf):
    rows = lineitem(spark, sf)
    return rows.select(*project.numeric_columns(rows))


_CHANNELS = ["click", "error", "purchase", "signup", "view"]


def _probe_rows(spark, sf):
    """Events as raw wide telemetry: one probe column per module and channel."""
    rows = telemetry(spark, sf)
    columns = []
    for m, name in enumerate(MODULES, 1):
        for c, channel in enumerate(_CHANNELS, 1):
            hit = (F.col("module") == name) & (F.col("channel") == channel)
            columns.append(
                F.when(hit, F.col("value")).alias(PROBE_PREFIX.format(module=m) + str(c))
            )
    return rows.select(F.date_trunc("hour", "event_time").alias("event_time"), *columns)


@query("p6_probe_rows", f"""WITH {TL} SELECT time_bucket(INTERVAL '1 hour', event_time) AS event_time,
  substr(module, 8, 1)::INTEGER AS module,
  list_position(['click','error','purchase','signup','view'], channel)::INTEGER AS channel,
  count(*) AS readings, round(sum(value), 6) AS total FROM tl GROUP BY ALL""")
def p6(spark, sf):
    probes = project.probes_long(_probe_rows(spark, sf), ["event_time"])
    return rounded(
        probes.filter("value IS NOT NULL")
        .groupBy("event_time", "module", "channel")
        .agg(F.count("value").alias("readings"), F.sum("value").alias("total")),
        "total",
    )


@query("p7_target_names", f"""WITH {WIDE} SELECT event_time,
  {', '.join(f'round({m}, 6) AS {t}' for m, t in zip(MODULES, TARGETS))} FROM w""")
def p7(spark, sf):
    rows = wide(spark, sf).select("event_time", *MODULES)
    return rounded(rows.withColumnsRenamed(project.target_names(MODULES)), *TARGETS)


_GAPPY = ", ".join(
    f"CASE WHEN (epoch(event_time) // {STEP}) % {i + 3} <> 0 THEN {m} END AS {m}"
    for i, m in enumerate(MODULES)
)


def _gappy(spark, sf):
    slot = F.expr(f"unix_seconds(event_time) div {STEP}")
    return wide(spark, sf).withColumns(
        {m: F.when(slot % (i + 3) != 0, F.col(m)) for i, m in enumerate(MODULES)}
    )


@query("p8_complete_targets", f"""WITH {WIDE}, g AS (SELECT event_time, {_GAPPY} FROM w)
  SELECT event_time, round({MODULES[0]}, 6) AS Target_Module_1 FROM g
  WHERE {' AND '.join(f'{m} IS NOT NULL' for m in MODULES)}""")
def p8(spark, sf):
    rows = _gappy(spark, sf).withColumnsRenamed(project.target_names(MODULES))
    return rounded(project.with_all_targets(rows).select("event_time", TARGETS[0]), TARGETS[0])


@query("p9_any_module", f"""WITH {WIDE}, g AS (SELECT event_time, {_GAPPY} FROM w)
  SELECT event_time, round({MODULES[1]}, 6) AS {MODULES[1]} FROM g
  WHERE coalesce({MODULES[0]}, {MODULES[1]}) IS NOT NULL""")
def p9(spark, sf):
    rows = project.with_any_module(_gappy(spark, sf), MODULES[:2])
    return rounded(rows.select("event_time", MODULES[1]), MODULES[1])


@query("p14_float32", "SELECT event_id, value::FLOAT AS value FROM events")
def p14(spark, sf):
    return project.as_float32(events(spark, sf).select("event_id", "value"), ["value"])


@query("a1_collapse_duplicates", """SELECT l_suppkey, l_shipdate, round(avg(l_quantity), 6) AS l_quantity,
  round(avg(l_extendedprice), 6) AS l_extendedprice,
  arg_min(l_returnflag, (l_orderkey, l_linenumber)) FILTER (WHERE l_returnflag <> 'N') AS flag
  FROM lineitem GROUP BY ALL""")
def a1(spark, sf):
    rows = lineitem(spark, sf).select(
        *_KEYS, "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber",
        F.expr("nullif(l_returnflag, 'N')").alias("flag"),
    )
    out = timeline.collapse_duplicates(rows, _KEYS, ["l_orderkey", "l_linenumber"])
    return rounded(out, "l_quantity", "l_extendedprice")


@query("a2_collapse_numeric", """SELECT l_suppkey, l_shipdate, round(avg(l_quantity), 6) AS l_quantity
  FROM lineitem GROUP BY ALL""")
def a2(spark, sf):
    rows = lineitem(spark, sf).select(*_KEYS, "l_quantity", "l_returnflag")
    return rounded(timeline.collapse_duplicates(rows, _KEYS), "l_quantity")


@query("a3_module_mean", f"""WITH {TL}, probe AS (SELECT module, channel,
    time_bucket(INTERVAL '1 hour', event_time) AS event_time, avg(value) AS value FROM tl GROUP BY ALL)
  SELECT module, event_time, round(avg(value), 6) AS value FROM probe GROUP BY ALL""")
def a3(spark, sf):
    probes = timeline.resample_mean(
        telemetry(spark, sf), ["module", "channel"], "event_time", HOUR, ["value"]
    )
    return rounded(timeline.module_means(probes, ["module", "event_time"]), "value")


@query("a3_module_mean_wide", f"""WITH {TL} SELECT time_bucket(INTERVAL '1 hour', event_time) AS event_time,
  {', '.join(f"round(avg(value) FILTER (WHERE module = '{m}'), 6) AS {m}" for m in MODULES)},
  0.0::DOUBLE AS Total_Power FROM tl GROUP BY 1""")
def a3_wide(spark, sf):
    rows = timeline.module_table(_probe_rows(spark, sf), ["event_time"])
    return rounded(timeline.resampled_modules(rows, [], "event_time", HOUR), *MODULES)


@query("a4_total_power", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag <> 'N' THEN l_quantity
    ELSE 0.0 END + CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END, 6) AS total_power
  FROM lineitem""")
def a4(spark, sf):
    rows = lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber",
        F.expr("CASE WHEN l_returnflag <> 'N' THEN l_quantity END").alias("Power Ch 1 (W)"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN l_extendedprice END").alias("Power Ch 2 (W)"),
    )
    power = timeline.total_power(rows).alias("total_power")
    return rounded(rows.select("l_orderkey", "l_linenumber", power), "total_power")


@query("a5_resample", f"WITH {R} SELECT module, event_time, round(value, 6) AS value FROM r")
def a5(spark, sf):
    return rounded(hourly(spark, sf), "value")


@query("a5_resample_10s", f"""WITH {TL} SELECT module, time_bucket(INTERVAL '10 seconds', event_time) AS event_time,
  round(avg(value), 6) AS value FROM tl GROUP BY ALL""")
def a5_fine(spark, sf):
    rows = telemetry(spark, sf)
    return rounded(timeline.resample_mean(rows, ["module"], "event_time", 10, ["value"]), "value")


_DELTAS = """d AS (SELECT module, event_time, epoch_us(event_time) / 1000000.0::DOUBLE
  - epoch_us(lag(event_time) OVER (PARTITION BY module ORDER BY event_time)) / 1000000.0::DOUBLE AS delta_seconds FROM r)"""


@query("a6_interval_counts", f"""WITH {R}, {_DELTAS} SELECT delta_seconds, count(*) AS n FROM d
  WHERE delta_seconds IS NOT NULL GROUP BY ALL ORDER BY n DESC, delta_seconds LIMIT 10""")
def a6(spark, sf):
    return timeline.interval_counts(hourly(spark, sf), ["module"], "event_time")


@query("t10_frequent_values", f"""WITH {R}, {_DELTAS} SELECT delta_seconds, count(*) AS n FROM d
  WHERE delta_seconds IS NOT NULL GROUP BY ALL ORDER BY n DESC, delta_seconds LIMIT 3""")
def t10(spark, sf):
    return timeline.interval_counts(hourly(spark, sf), ["module"], "event_time", n=3)


@query("a7_cadence", f"""WITH {R}, {_DELTAS} SELECT count(delta_seconds) AS intervals,
  round(avg((delta_seconds = 3600)::INT), 6) AS exact_ratio,
  avg((delta_seconds = 3600)::INT) >= 0.95 AS is_regular FROM d""")
def a7(spark, sf):
    out = timeline.cadence(hourly(spark, sf), ["module"], "event_time", HOUR)
    return rounded(out.drop("gap_rows"), "exact_ratio")


@query("a8_gap_boundaries", f"""WITH {R}, {_DELTAS} SELECT count(*) FILTER
  (WHERE delta_seconds IS NULL OR delta_seconds <> 3600) AS gap_rows FROM d""")
def a8(spark, sf):
    return timeline.cadence(hourly(spark, sf), ["module"], "event_time", HOUR).select("gap_rows")


@query("a9_profile", """WITH s AS (SELECT CASE WHEN l_orderkey % 17 <> 0 THEN l_shipdate END AS t FROM lineitem)
  SELECT count(*) AS rows, count(*) - count(t) AS invalid_rows, count(DISTINCT t) AS unique_times,
  count(t) - count(DISTINCT t) AS duplicate_rows, min(t) AS first_time, max(t) AS last_time FROM s""")
def a9(spark, sf):
    rows = lineitem(spark, sf).select(
        F.expr("CASE WHEN l_orderkey % 17 <> 0 THEN l_shipdate END").alias("t")
    )
    return timeline.profile(rows, "t")


@query("a22_probe_counts", f"""WITH {TL} SELECT module, count(DISTINCT channel) AS channels
  FROM tl GROUP BY module""")
def a22(spark, sf):
    return timeline.probe_counts(telemetry(spark, sf))


@query("a23_distinct_times", "SELECT DISTINCT l_shipdate FROM lineitem WHERE l_shipdate IS NOT NULL")
def a23(spark, sf):
    return timeline.distinct_times(lineitem(spark, sf), "l_shipdate")


@query("w7_intervals", f"""WITH {R}, {_DELTAS} SELECT module, event_time,
  round(delta_seconds, 6) AS delta_seconds FROM d""")
def w7(spark, sf):
    return rounded(timeline.intervals(hourly(spark, sf), ["module"], "event_time"), "delta_seconds")


@query("w13_position", f"""WITH {TL} SELECT event_id, module,
  row_number() OVER (PARTITION BY module ORDER BY event_time, event_id) - 1 AS position FROM tl""")
def w13(spark, sf):
    rows = telemetry(spark, sf).select("event_id", "module", "event_time")
    return with_position(rows, ["module"], ["event_time", "event_id"]).drop("event_time")


@query("j1_future_targets", f"""WITH {R} SELECT a.module, a.event_time, a.event_time + INTERVAL 5 HOUR AS target_time,
  round(a.value, 6) AS value, round(b.value, 6) AS target
  FROM r a JOIN r b ON a.module = b.module AND a.event_time + INTERVAL 5 HOUR = b.event_time""")
def j1(spark, sf):
    out = add_future_targets(
        hourly(spark, sf), ["module"], columns=["value"], seconds=HORIZON, names={"value": "target"}
    )
    return rounded(out, "value", "target")


@query("j1_future_targets_days", """WITH q AS (SELECT l_suppkey, l_shipdate, avg(l_quantity) AS l_quantity
  FROM lineitem GROUP BY ALL) SELECT a.l_suppkey, a.l_shipdate, round(a.l_quantity, 6) AS l_quantity,
  a.l_shipdate + INTERVAL 7 DAY AS target_time, round(b.l_quantity, 6) AS target
  FROM q a JOIN q b ON a.l_suppkey = b.l_suppkey AND a.l_shipdate + INTERVAL 7 DAY = b.l_shipdate""")
def j1_days(spark, sf):
    lines = lineitem(spark, sf).select(*_KEYS, "l_quantity")
    n = lines.count()
    out = add_future_targets(
        timeline.collapse_duplicates(lines, _KEYS, rows=n),
        ["l_suppkey"], "l_shipdate", ["l_quantity"], 7 * 86400, {"l_quantity": "target"}, rows=n,
    )
    return rounded(out, "l_quantity", "target")


@query("j1_future_targets_wide", f"""WITH {WIDE} SELECT a.event_time,
  {', '.join(f'round(b.{m}, 6) AS {t}' for m, t in zip(MODULES, TARGETS))}
  FROM w a JOIN w b ON a.event_time + INTERVAL 30 HOUR = b.event_time
  WHERE {' AND '.join(f'b.{m} IS NOT NULL' for m in MODULES)}""")
def j1_wide(spark, sf):
    out = add_future_targets(wide(spark, sf), [], seconds=5 * STEP)
    return rounded(out.select("event_time", *TARGETS), *TARGETS)


@query("j7_duplicate_keys", """SELECT l_suppkey, l_shipdate, count(*) AS copies FROM lineitem
  GROUP BY ALL HAVING count(*) > 1""")
def j7(spark, sf):
    return duplicate_keys(lineitem(spark, sf), _KEYS)


@query("f2_target_time", f"WITH {TL} SELECT event_id, event_time + INTERVAL 300 SECOND AS target_time FROM tl")
def f2(spark, sf):
    return telemetry(spark, sf).select(
        "event_id", S.shifted(F.col("event_time"), 300).alias("target_time")
    )


@query("f3_horizon_check", f"""WITH {R} SELECT count(*) AS rows, 0.0::DOUBLE AS max_difference_seconds,
  0::BIGINT AS wrong_rows FROM r a JOIN r b
  ON a.module = b.module AND a.event_time + INTERVAL 5 HOUR = b.event_time""")
def f3(spark, sf):
    rows = add_future_targets(
        hourly(spark, sf), ["module"], columns=["value"], seconds=HORIZON, names={"value": "target"}
    )
    return horizon_report(rows, seconds=HORIZON)


@query("m1_persistence_by_module", f"""WITH {WIDE}, pairs AS ({' UNION ALL '.join(
    f"SELECT '{m}' AS module, b.{m} AS actual, a.{m} AS predicted FROM w a JOIN w b ON a.event_time + INTERVAL 30 HOUR = b.event_time"
    f" WHERE {' AND '.join(f'b.{x} IS NOT NULL' for x in MODULES)}" for m in MODULES)})
  SELECT module, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse,
  round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(actual)), 6) AS r2 FROM pairs GROUP BY module""")
def m1(spark, sf):
    return rounded(persistence_by_module(wide(spark, sf), [], 5 * STEP), "mae", "rmse", "r2")


@query("a5_collapse_then_resample", f"""WITH once AS (SELECT l_suppkey, l_shipdate, avg(l_quantity) AS q
  FROM lineitem GROUP BY ALL) SELECT l_suppkey, time_bucket(INTERVAL '7 days', l_shipdate, TIMESTAMP '1970-01-01') AS l_shipdate,
  round(avg(q), 6) AS l_quantity FROM once GROUP BY 1, 2""")
def a5_weeks(spark, sf):
    lines = lineitem(spark, sf).select(*_KEYS, "l_quantity")
    once = timeline.collapse_duplicates(lines, _KEYS, rows=lines.count())
    out = timeline.resample_mean(once, ["l_suppkey"], "l_shipdate", 7 * 86400, ["l_quantity"])
    return rounded(out, "l_quantity")


@query("u2_column_blocks", f"""WITH {WIDE} SELECT event_time, {_ROUNDED_WIDE}, hour(event_time)::FLOAT AS Hour FROM w""")
def u2(spark, sf):
    rows = wide(spark, sf)
    hour = S.time_parts(F.col("event_time"))["Hour"].alias("Hour")
    return rounded(rows.select("event_time", *MODULES, TOTAL_POWER, hour), *MODULES, TOTAL_POWER)


@query("wide_rows_per_bucket", f"WITH {WIDE} SELECT count(*) AS rows, min(event_time) AS first_time FROM w")
def buckets(spark, sf):
    rows = timeline.resampled_modules(wide_rows(spark, sf), [], "event_time", STEP)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min("event_time").alias("first_time"))
