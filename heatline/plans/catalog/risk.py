"""Thresholds, risk, alerts and what-if shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators import alerts, monitor, project, risk, whatif
from heatline.operators.scale import bounded_broadcast, written
from heatline.operators.validate import key_differences, threshold_rows
from heatline.plans.catalog.base import (
    CHANGES,
    EVENTS_RAISED,
    MESSAGE,
    PREDICTED,
    R,
    THRESHOLDS,
    TL,
    hourly,
    lineitem,
    prediction_table,
    predictions,
    query,
    risk_sql,
    rounded,
    series,
    telemetry,
)
from heatline.schema import MODULES


@query("a10_thresholds", f"""WITH {THRESHOLDS} SELECT module, round(warning, 6) AS warning,
  round(critical, 6) AS critical, 'historical_percentiles' AS source FROM th""")
def a10(spark, sf):
    return rounded(risk.fit_thresholds(series(spark, sf)), "warning", "critical")


@query("a10_thresholds_by_rank", f"""WITH {TL} SELECT module, round(quantile_cont(value, 0.95::DOUBLE), 6) AS warning,
  round(quantile_cont(value, 0.99::DOUBLE), 6) AS critical FROM tl GROUP BY module""")
def a10_ranks(spark, sf):
    # A small bound takes the narrowing path that large groups need.
    out = risk.fit_thresholds(telemetry(spark, sf), limit=100)
    return rounded(out.drop("source"), "warning", "critical")


@query("a10_thresholds_train", f"""WITH {R}, o AS (SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS place,
    count(*) OVER ()::DOUBLE AS n FROM r),
  cut AS (SELECT max(event_time) FILTER (WHERE place = floor(0.70::DOUBLE * n)) AS a FROM o)
  SELECT module, round(quantile_cont(value, 0.95::DOUBLE), 6) AS warning,
  round(quantile_cont(value, 0.99::DOUBLE), 6) AS critical FROM r, cut WHERE event_time < a GROUP BY module""")
def a10_train(spark, sf):
    out = risk.fit_thresholds(series(spark, sf), fit_split="train")
    return rounded(out.drop("source"), "warning", "critical")


# Sketches only promise a rank, so ranks are compared: both levels lie within the bound.
@query("a10_sketched_thresholds", f"""WITH {TL} SELECT module, count(*) AS n, true AS warning_near, true AS critical_near
  FROM tl GROUP BY module""")
def a10_sketched(spark, sf):
    rows = written(telemetry(spark, sf).select("module", "event_time", "value"))
    sketches = written(risk.value_sketches(rows), "sketches")
    levels = risk.sketched_thresholds(sketches)
    ranks = rows.join(bounded_broadcast(levels.drop("source")), "module").groupBy("module", "n").agg(
        *[F.avg((F.col("value") <= F.col(c)).cast("int")).alias(c) for c in ("warning", "critical")],
        *[F.avg((F.col("value") < F.col(c)).cast("int")).alias(f"{c}_low") for c in ("warning", "critical")],
    )
    bound = risk.rank_error()

    def near(name, q):
        return ((F.col(f"{name}_low") <= q + bound) & (F.col(name) >= q - bound)).alias(f"{name}_near")

    return ranks.select("module", "n", near("warning", 0.95), near("critical", 0.99))


_LEGACY = """SELECT module, CASE WHEN substr(module, 8, 1)::INT % 2 = 0 THEN warning END AS w1,
  CASE WHEN substr(module, 8, 1)::INT % 2 = 1 THEN warning END AS w2,
  CASE WHEN module = 'Module_3_Avg_Temp' THEN warning ELSE critical END AS critical FROM th"""


@query("p10_threshold_rules", f"""WITH {THRESHOLDS}, raw AS ({_LEGACY})
  SELECT module, round(coalesce(w1, w2), 6) AS warning, round(critical, 6) AS critical,
  CASE WHEN NOT coalesce(coalesce(w1, w2) < critical, false)
    THEN 'Invalid warning/critical thresholds for ' || module END AS problem FROM raw""")
def p10(spark, sf):
    number = S.module_number(F.col("module"))
    fitted = risk.fit_thresholds(series(spark, sf))
    raw = fitted.select(
        "module",
        F.when(number % 2 == 0, F.col("warning")).alias("warning"),
        F.when(number % 2 == 1, F.col("warning")).alias("Warning_95"),
        F.when(number == 3, F.col("warning")).otherwise(F.col("critical")).alias("critical"),
    )
    return rounded(threshold_rows(raw).drop("source"), "warning", "critical")


@query("u3_key_differences", """WITH h AS (SELECT date_trunc('minute', ts) AS minute, event_type FROM events),
  a AS (SELECT DISTINCT minute FROM h WHERE event_type = 'error'),
  b AS (SELECT DISTINCT minute FROM h WHERE event_type = 'purchase')
  SELECT minute, 'left' AS side FROM a WHERE minute NOT IN (SELECT minute FROM b)
  UNION ALL SELECT minute, 'right' FROM b WHERE minute NOT IN (SELECT minute FROM a)""")
def u3(spark, sf):
    rows = telemetry(spark, sf).withColumn("minute", F.date_trunc("minute", "event_time"))
    return key_differences(
        rows.filter("channel = 'error'"), rows.filter("channel = 'purchase'"), "minute"
    )


@query("j5_threshold_lookup", f"""WITH {THRESHOLDS}, known AS (SELECT * FROM th WHERE module <> 'Module_8_Avg_Temp')
  SELECT r.module, event_time, round(warning, 6) AS warning_threshold,
  round(critical, 6) AS critical_threshold FROM r LEFT JOIN known USING (module)""")
def j5(spark, sf):
    rows = series(spark, sf)
    levels = risk.fit_thresholds(rows).filter(F.col("module") != MODULES[7])
    out = risk.with_thresholds(rows.drop("value"), levels)
    return rounded(out, "warning_threshold", "critical_threshold")


@query("j5_unknown_modules", f"""WITH {R} SELECT module, event_time FROM r WHERE module = 'Module_8_Avg_Temp'""")
def j5_unknown(spark, sf):
    rows = series(spark, sf)
    levels = risk.fit_thresholds(rows).filter(F.col("module") != MODULES[7])
    return risk.unknown_modules(rows.drop("value"), levels)


_DRIFT = "((epoch(event_time) // 3600) % 4)::DOUBLE * 0.6::DOUBLE"


def _drifting(spark, sf):
    """Forecasts whose current reading lies up to 1.8 degrees below them."""
    hour = F.expr("cast(unix_micros(event_time) div 3600000000 % 4 as double)")
    rows = series(spark, sf)
    return rows.select(
        "module", "event_time", F.col("value").alias("predicted_temperature"),
        F.when(F.col("module") != MODULES[1], F.col("value") - hour * F.lit(0.6)).alias(
            "current_temperature"
        ),
    )


_DRIFTED = f"""{THRESHOLDS}, dr AS (SELECT module, event_time, value AS predicted_temperature,
  CASE WHEN module <> 'Module_2_Avg_Temp' THEN value - {_DRIFT} END AS current_temperature FROM r)"""


@query("f4_risk_level", f"""WITH {_DRIFTED} SELECT module, event_time,
  {risk_sql('predicted_temperature', '(predicted_temperature - current_temperature)')} AS risk_level
  FROM dr JOIN th USING (module)""")
def f4(spark, sf):
    levels = risk.fit_thresholds(series(spark, sf))
    return risk.classify(_drifting(spark, sf), levels).select("module", "event_time", "risk_level")


@query("f5_temperature_delta", f"""WITH {_DRIFTED} SELECT module, event_time,
  round(predicted_temperature - current_temperature, 6) AS temperature_delta FROM dr""")
def f5(spark, sf):
    delta = F.col("predicted_temperature") - F.col("current_temperature")
    rows = _drifting(spark, sf).select("module", "event_time", delta.alias("temperature_delta"))
    return rounded(rows, "temperature_delta")


@query("f8_movement", f"""WITH {_DRIFTED}, x AS (SELECT module, event_time,
  predicted_temperature - current_temperature AS d FROM dr) SELECT module, event_time,
  CASE WHEN d > 0 THEN '↑ Expected rise' WHEN d < 0 THEN '↓ Expected fall'
    WHEN d = 0 THEN '→ Stable' ELSE 'N/A' END AS movement FROM x""")
def f8(spark, sf):
    delta = F.col("predicted_temperature") - F.col("current_temperature")
    return _drifting(spark, sf).select("module", "event_time", S.movement(delta).alias("movement"))


@query("w12_risk_transitions", f"""WITH {CHANGES} SELECT module, event_time, previous_risk, risk_level FROM ch""")
def w12(spark, sf):
    out = alerts.risk_transitions(prediction_table(spark, sf))
    return out.select("module", "event_time", "previous_risk", "risk_level")


@query("x5_alert_events_batch", f"""WITH {EVENTS_RAISED} SELECT module, event_time, event_type,
  risk_level AS severity, {MESSAGE} AS message FROM ev""")
def x5(spark, sf):
    out = alerts.alert_events(prediction_table(spark, sf))
    return out.select("module", "event_time", "event_type", "severity", "message")


@query("x6_restored_state", f"""WITH {PREDICTED}, late AS (SELECT * FROM p WHERE event_time >= TIMESTAMP '2024-01-15'),
  old AS (SELECT module, arg_max(risk_level, event_time) AS risk_level FROM p
    WHERE event_time < TIMESTAMP '2024-01-15' GROUP BY module)
  SELECT late.module, event_time, late.risk_level,
  coalesce(lag(late.risk_level) OVER (PARTITION BY late.module ORDER BY event_time), old.risk_level, 'NORMAL') AS previous_risk
  FROM late LEFT JOIN old USING (module)""")
def x6(spark, sf):
    rows = prediction_table(spark, sf)
    restart = F.lit("2024-01-15").cast("timestamp")
    before = monitor.latest_per_key(
        rows.filter(F.col("event_time") < restart).select("module", "event_time", "risk_level"),
        ["module"], ["event_time"],
    )
    out = alerts.risk_transitions(rows.filter(F.col("event_time") >= restart), initial=before)
    return out.select("module", "event_time", "risk_level", "previous_risk")


@query("f6_messages", f"""WITH {EVENTS_RAISED} SELECT module, event_time, {MESSAGE} AS message FROM ev""")
def f6(spark, sf):
    return alerts.alert_events(prediction_table(spark, sf)).select("module", "event_time", "message")


@query("p16_active_alerts", f"""WITH {PREDICTED} SELECT module, event_time, risk_level FROM p
  WHERE risk_level IN ('WARNING', 'CRITICAL')""")
def p16(spark, sf):
    return project.active_alerts(predictions(spark, sf)).select("module", "event_time", "risk_level")


@query("p18_alert_history", f"""WITH {EVENTS_RAISED} SELECT event_time AS "Timestamp", module AS "Module",
  event_type AS "Event", round(predicted_temperature, 6) AS "5-Min Forecast °C", risk_level AS "Severity" FROM ev""")
def p18(spark, sf):
    raised = alerts.alert_events(prediction_table(spark, sf))
    new = raised.filter(F.col("module") < MODULES[4])
    old = alerts.alert_records(raised.filter(F.col("module") >= MODULES[4]))
    out = project.alert_history(project.joined_history(new, old))
    forecast = "5-Min Forecast °C"
    return rounded(out.select("Timestamp", "Module", "Event", forecast, "Severity"), forecast)


@query("u5_event_layouts", f"""WITH {EVENTS_RAISED} SELECT module, event_time,
  CASE WHEN event_type = 'TEMPERATURE_ALERT' THEN risk_level END AS alert_level,
  CASE WHEN event_type = 'TEMPERATURE_RECOVERY' THEN risk_level END AS severity FROM ev""")
def u5(spark, sf):
    raised = alerts.alert_events(prediction_table(spark, sf)).select(
        "module", "event_time", "event_type", "severity"
    )
    new = raised.filter(F.col("event_type") == alerts.RECOVERY)
    old = raised.filter(F.col("event_type") == alerts.ALERT)
    old = old.withColumnRenamed("severity", "alert_level")
    return project.joined_history(new, old).drop("event_type")


_SCENARIO_ROWS = """VALUES ('NORMAL', 0.0::DOUBLE), ('WARNING', 1.0::DOUBLE), ('CRITICAL', 3.0::DOUBLE)"""


@query("p19_scenarios", f"""WITH {R}, sc AS (SELECT * FROM ({_SCENARIO_ROWS}) t(scenario, shift))
  SELECT scenario, event_time, round(CASE WHEN shift = 0 THEN value
    ELSE format('{{:.4f}}', value + shift)::DOUBLE END, 6) AS Module_6_Avg_Temp
  FROM r, sc WHERE module = 'Module_6_Avg_Temp'""")
def p19(spark, sf):
    rows = project.of_module(hourly(spark, sf), MODULES[5]).select(
        "event_time", F.col("value").alias(MODULES[5])
    )
    return rounded(whatif.scenario_rows(rows), MODULES[5])


@query("p19_scenario_risk", f"""WITH {THRESHOLDS} SELECT event_time, format('{{:.4f}}', value + 3.0::DOUBLE)::DOUBLE AS shifted,
  {risk_sql("format('{:.4f}', value + 3.0::DOUBLE)::DOUBLE", "format('{:.4f}', value + 3.0::DOUBLE)::DOUBLE - value")} AS risk_level
  FROM r JOIN th USING (module) WHERE module = 'Module_6_Avg_Temp'""")
def p19_risk(spark, sf):
    rows = series(spark, sf)
    m6 = project.of_module(rows, MODULES[5]).withColumnsRenamed({"value": MODULES[5]})
    shifted = whatif.shift_module(m6, " critical ").join(
        m6.select("event_time", F.col(MODULES[5]).alias("current_temperature")), "event_time"
    )
    forecast = shifted.withColumnRenamed(MODULES[5], "predicted_temperature")
    out = risk.classify(forecast, risk.fit_thresholds(rows))
    return out.select("event_time", F.col("predicted_temperature").alias("shifted"), "risk_level")


@query("f14_clean_names", """SELECT event_id, upper(event_type) AS scenario,
  CASE upper(event_type) WHEN 'NORMAL' THEN 0.0::DOUBLE WHEN 'WARNING' THEN 1.0 WHEN 'CRITICAL' THEN 3.0 END AS shift FROM events""")
def f14(spark, sf):
    rows = telemetry(spark, sf)
    padded = F.concat(F.lit("  "), F.col("channel"), F.lit(" "))
    return rows.select(
        "event_id", S.clean_name(padded).alias("scenario"),
        whatif.scenario_shift(padded).alias("shift"),
    )


@query("f16_round", """SELECT l_orderkey, l_linenumber,
  format('{:.4f}', l_extendedprice * (1 - l_discount) / 7.0::DOUBLE)::DOUBLE AS value FROM lineitem""")
def f16(spark, sf):
    value = F.expr("l_extendedprice * (1 - l_discount) / 7.0D")
    return lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber", S.exact_round(value, 4).alias("value")
    )
