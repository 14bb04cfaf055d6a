"""As-of scoring and reads over stored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators import alerts, monitor, project
from heatline.operators.asof import asof_nearest
from heatline.plans.catalog.base import (
    EVENTS_RAISED,
    HORIZON,
    PREDICTED,
    R,
    TL,
    TOLERANCE,
    events,
    hourly,
    prediction_table,
    predictions,
    query,
    rounded,
    telemetry,
)

ASOF = f"""{TL}, f AS (SELECT event_id, module, event_time, event_time + INTERVAL 5 HOUR AS target_time, value AS predicted FROM tl),
  b AS (SELECT f.*, e.event_time AS before_time, e.value AS before_value
    FROM f ASOF LEFT JOIN tl e ON f.module = e.module AND f.target_time >= e.event_time),
  n AS (SELECT b.*, e.event_time AS after_time, e.value AS after_value
    FROM b ASOF LEFT JOIN tl e ON b.module = e.module AND b.target_time <= e.event_time),
  d AS (SELECT *, epoch_us(target_time) - epoch_us(before_time) AS back, epoch_us(after_time) - epoch_us(target_time) AS ahead FROM n),
  m AS (SELECT event_id, module, event_time, target_time, predicted,
    CASE WHEN back <= 1800000000 AND (ahead IS NULL OR back <= ahead) THEN before_time WHEN ahead <= 1800000000 THEN after_time END AS matched_time,
    CASE WHEN back <= 1800000000 AND (ahead IS NULL OR back <= ahead) THEN before_value WHEN ahead <= 1800000000 THEN after_value END AS matched_value FROM d)"""


@query("j2_asof_nearest", f"WITH {ASOF} SELECT event_id, module, matched_time, matched_value FROM m")
def j2(spark, sf):
    rows = telemetry(spark, sf)
    forecasts = rows.select(
        "event_id", "module", S.shifted(F.col("event_time"), HORIZON).alias("target_time")
    )
    readings = rows.select("event_id", "module", "event_time", "value")
    out = asof_nearest(
        forecasts, readings, ["module"], "target_time", "event_time", "value", TOLERANCE, ["event_id"]
    )
    return out.drop("target_time")


@query("j2_asof_nearest_split", f"WITH {ASOF} SELECT event_id, module, matched_time, matched_value FROM m")
def j2_split(spark, sf):
    # A small bound cuts busy stretches into parts, as a hot module needs.
    rows = telemetry(spark, sf)
    forecasts = rows.select(
        "event_id", "module", S.shifted(F.col("event_time"), HORIZON).alias("target_time")
    )
    out = asof_nearest(
        forecasts, rows.select("module", "event_time", "value"), ["module"],
        "target_time", "event_time", "value", TOLERANCE, limit=10,
    )
    return out.drop("target_time")


def _records(spark, sf):
    return telemetry(spark, sf).select(
        "module", "event_time", F.col("value").alias("current_temperature"),
        F.col("value").alias("predicted_temperature"),
    )


_SCORES = """SELECT module, count(e) AS evaluated, count(*) - count(e) AS pending,
  round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse,
  count(*) FILTER (WHERE early) AS not_due, count(*) FILTER (WHERE e IS NULL AND NOT early) AS missed"""
_ERRORS = """, newest AS (SELECT module, max(event_time) AS newest FROM tl GROUP BY module),
  e AS (SELECT module, matched_value - predicted AS e, matched_value IS NULL AND target_time > newest AS early
    FROM m JOIN newest USING (module))"""


@query("a20_forecast_performance", f"""WITH {ASOF}{_ERRORS}
  {_SCORES} FROM e GROUP BY module
  UNION ALL {_SCORES.replace('SELECT module', "SELECT 'overall' AS module")} FROM e""")
def a20(spark, sf):
    out = monitor.forecast_performance(_records(spark, sf), HORIZON, TOLERANCE)
    return rounded(out, "mae", "rmse")


_OLDEST = ASOF.replace(
    TL, TL.replace("FROM events", "FROM (SELECT * FROM events ORDER BY ts LIMIT 20000)"), 1
)


@query("a20_oldest_rows", f"""WITH {_OLDEST}{_ERRORS}
  {_SCORES} FROM e GROUP BY module
  UNION ALL {_SCORES.replace('SELECT module', "SELECT 'overall' AS module")} FROM e""")
def a20_oldest(spark, sf):
    # Scoring the oldest rows only is the feature: the reports' bounded scan.
    out = monitor.forecast_performance(_records(spark, sf), HORIZON, TOLERANCE, oldest=20_000)
    return rounded(out, "mae", "rmse")


@query("x8_matured_batch", f"""WITH {ASOF} SELECT module, event_time, target_time, matched_time, matched_value FROM m""")
def x8(spark, sf):
    out = monitor.scored_forecasts(_records(spark, sf), HORIZON, TOLERANCE)
    return out.select("module", "event_time", "target_time", "matched_time", "matched_value")


@query("f9_accuracy_grade", f"""WITH {TL}, e AS (SELECT module, avg(value) / 50 AS mae FROM tl GROUP BY module)
  SELECT module, CASE WHEN mae < 0.5 THEN 'Strong forecasting accuracy' WHEN mae < 1.0 THEN 'Good forecasting accuracy'
    ELSE 'Needs model attention' END AS accuracy FROM e""")
def f9(spark, sf):
    errors = telemetry(spark, sf).groupBy("module").agg((F.avg("value") / 50).alias("mae"))
    return errors.select("module", S.accuracy_grade(F.col("mae")).alias("accuracy"))


_LATEST = f"""{PREDICTED}, latest AS (SELECT * FROM p QUALIFY row_number() OVER
  (PARTITION BY module ORDER BY event_time DESC) = 1)"""
_SHOWN = "module, event_time, round(predicted_temperature, 6) AS predicted_temperature, risk_level"


def _shown(df):
    return rounded(
        df.select("module", "event_time", "predicted_temperature", "risk_level"),
        "predicted_temperature",
    )


@query("j3_latest_per_module", f"WITH {_LATEST} SELECT {_SHOWN} FROM latest")
def j3(spark, sf):
    return _shown(monitor.latest_per_key(prediction_table(spark, sf), ["module"], ["event_time"]))


@query("j3_latest_event_per_user", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts
  FROM events GROUP BY user_id""")
def j3_users(spark, sf):
    out = monitor.latest_per_key(events(spark, sf), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", "ts")


@query("j6_status_performance", f"""WITH {ASOF}{_ERRORS},
  s AS ({_SCORES} FROM e WHERE module <> 'Module_8_Avg_Temp' GROUP BY module),
  latest AS (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY module ORDER BY event_time DESC) = 1)
  SELECT module, l.event_time, coalesce(evaluated, 0) AS evaluated, coalesce(pending, 0) AS pending,
    coalesce(not_due, 0) AS not_due, coalesce(missed, 0) AS missed, mae,
    CASE WHEN mae < 0.5 THEN 'Strong forecasting accuracy' WHEN mae < 1.0 THEN 'Good forecasting accuracy'
      WHEN mae >= 1.0 THEN 'Needs model attention' END AS accuracy
  FROM latest l LEFT JOIN s USING (module)""")
def j6(spark, sf):
    rows = _records(spark, sf)
    status = monitor.latest_per_key(rows.select("module", "event_time"), ["module"], ["event_time"])
    scores = monitor.forecast_performance(rows, HORIZON, TOLERANCE)
    scores = scores.filter(F.col("module") != "Module_8_Avg_Temp")
    out = monitor.status_with_performance(status, scores).drop("rmse")
    return rounded(out, "mae")


@query("p17_module_filter", f"WITH {R} SELECT module, event_time, round(value, 6) AS value FROM r WHERE module = 'Module_4_Avg_Temp'")
def p17(spark, sf):
    return rounded(project.of_module(hourly(spark, sf), "Module_4_Avg_Temp"), "value")


@query("t1_time_order", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def t1(spark, sf):
    return events(spark, sf).select("event_id", "ts", "value").orderBy("ts", "event_id")


@query("t2_latest_predictions", f"WITH {PREDICTED} SELECT {_SHOWN} FROM p ORDER BY event_time DESC, module DESC LIMIT 50")
def t2(spark, sf):
    return _shown(monitor.latest_n(predictions(spark, sf), ["event_time", "module"], 50))


@query("t2_latest_events_clamped", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def t2_clamped(spark, sf):
    return monitor.latest_n(
        events(spark, sf).select("event_id", "ts"), ["ts", "event_id"], 9999, most=500
    )


@query("t3_module_history", """SELECT event_id, ts FROM events WHERE user_id % 8 = 5 ORDER BY ts DESC, event_id DESC LIMIT 100""")
def t3(spark, sf):
    rows = telemetry(spark, sf).select("module", "event_id", F.col("event_time").alias("ts"))
    return monitor.module_history(rows, "Module_6_Avg_Temp", ["ts", "event_id"]).drop("module")


@query("t4_oldest_rows", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 2000")
def t4(spark, sf):
    rows = events(spark, sf).select("event_id", "ts", "value")
    return monitor.oldest_n(rows, ["ts", "event_id"], 2000)


@query("t5_status_of_newest", """SELECT 'Module_' || (user_id % 8 + 1) || '_Avg_Temp' AS module,
  max(ts) AS event_time FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY 1""")
def t5(spark, sf):
    rows = telemetry(spark, sf).select("module", "event_time", "event_id")
    out = monitor.module_status(rows, ["module"], ["event_time", "event_id"], newest=500)
    return out.drop("event_id")


@query("t6_first_rows", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 25")
def t6(spark, sf):
    return monitor.oldest_n(events(spark, sf).select("event_id", "ts"), ["ts", "event_id"], 25)


@query("t8_active_first", f"""WITH {_LATEST.replace('ORDER BY event_time DESC', 'ORDER BY predicted_temperature DESC, event_time DESC')}
  SELECT {_SHOWN} FROM latest WHERE risk_level <> 'NORMAL'
  ORDER BY (risk_level <> 'CRITICAL'), substr(module, 8, 1)::INT""")
def t8(spark, sf):
    hottest = monitor.latest_per_key(
        prediction_table(spark, sf), ["module"], ["predicted_temperature", "event_time"]
    )
    return _shown(monitor.active_list(hottest))


@query("t8_module_order", f"""WITH {TL} SELECT module, count(*) AS readings FROM tl GROUP BY module
  ORDER BY substr(module, 8, 1)::INT""")
def t8_order(spark, sf):
    counts = telemetry(spark, sf).groupBy("module").agg(F.count(F.lit(1)).alias("readings"))
    return monitor.by_module_number(counts)


@query("f7_module_label", f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'Spare' ELSE 'Module_' || (user_id % 12 + 1) END AS label,
  CASE WHEN event_id % 9 = 0 THEN 999 ELSE user_id % 12 + 1 END::INT AS number FROM events""")
def f7(spark, sf):
    name = F.when(F.col("event_id") % 9 == 0, "Spare_Avg_Temp").otherwise(
        F.concat(F.lit("Module_"), (F.col("user_id") % 12 + 1).cast("string"), F.lit("_Avg_Temp"))
    )
    return events(spark, sf).select(
        "event_id", S.module_label(name).alias("label"), S.module_number(name).alias("number")
    )


_ALERTS = f"{EVENTS_RAISED}, al AS (SELECT *, risk_level AS alert_level FROM ev)"


def _alerts(spark, sf):
    return alerts.alert_records(alerts.alert_events(prediction_table(spark, sf)))


@query("a13_alert_summary", f"""WITH {_ALERTS} SELECT count(*) AS total_alerts,
  count(*) FILTER (WHERE alert_level = 'WARNING') AS warning_alerts,
  count(*) FILTER (WHERE alert_level = 'CRITICAL') AS critical_alerts,
  count(*) FILTER (WHERE alert_level = 'NORMAL') AS recoveries FROM al""")
def a13(spark, sf):
    return monitor.alert_summary(_alerts(spark, sf))


@query("a14_prediction_count", f"WITH {R} SELECT count(*) AS total_predictions FROM r")
def a14(spark, sf):
    return monitor.prediction_count(predictions(spark, sf))


@query("a15_summary", f"""WITH {_ALERTS} SELECT (SELECT count(*) FROM p) AS total_predictions, count(*) AS total_alerts,
  count(*) FILTER (WHERE alert_level = 'WARNING') AS warning_alerts,
  count(*) FILTER (WHERE alert_level = 'CRITICAL') AS critical_alerts FROM al""")
def a15(spark, sf):
    return monitor.summary(predictions(spark, sf), _alerts(spark, sf))


@query("a21_active_counts", f"""WITH {_LATEST.replace('ORDER BY event_time DESC', 'ORDER BY predicted_temperature DESC, event_time DESC')}
  SELECT count(*) FILTER (WHERE risk_level <> 'NORMAL') AS active, count(*) FILTER (WHERE risk_level = 'WARNING') AS warning,
  count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical FROM latest""")
def a21(spark, sf):
    hottest = monitor.latest_per_key(
        prediction_table(spark, sf), ["module"], ["predicted_temperature", "event_time"]
    )
    return monitor.active_counts(hottest)
