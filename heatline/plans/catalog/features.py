"""Windows, features, splits and cross-module state."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators import baselines, features, project, split
from heatline.operators.metrics import missing_values
from heatline.operators.scale import over_ordered
from heatline.plans.catalog.base import (
    HORIZON,
    R,
    STEP,
    TL,
    WIDE,
    hourly,
    query,
    rounded,
    series,
    telemetry,
    wide,
    wide_table,
)
from heatline.plans.training import feature_table
from heatline.operators.targets import add_future_targets
from heatline.schema import (
    CHANGE_ROWS,
    LAGS,
    MEAN_ROWS,
    MODULES,
    STD_ROWS,
    TARGETS,
    TOTAL_POWER,
    feature_names,
)

_W = "WINDOW s AS (PARTITION BY module ORDER BY event_time)"


def _frame(n: int, partition: str = "PARTITION BY module ") -> str:
    return f"OVER ({partition}ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag(c: str, n: int, partition: str = "PARTITION BY module ") -> str:
    return f"lag({c}, {n}) OVER ({partition}ORDER BY event_time)"


def _series(spark, sf, columns):
    """Long-table features under the given names, rounded."""
    rows = series(spark, sf)
    out = over_ordered(rows, ["module"], ["event_time"], features.REACH, columns)
    return rounded(out, *[c for c in out.columns if c not in ("module", "event_time")], digits=9)


def _select(parts: dict[str, str]) -> str:
    cells = ", ".join(f"round({sql}, 9) AS {name}" for name, sql in parts.items())
    return f"WITH {R} SELECT module, event_time, round(value, 9) AS value, {cells} FROM r"


@query("w1_lags", _select({f"lag_{n}": _lag("value", n) for n in LAGS}))
def w1(spark, sf):
    return _series(
        spark, sf, lambda w: {f"lag_{n}": features.lagged(w, "value", n, False) for n in LAGS}
    )


@query("w2_rolling_means", _select({
    f"mean_{n}": f"CASE WHEN count(value) {_frame(n)} = {n} THEN avg(value) {_frame(n)} END"
    for n in MEAN_ROWS}))
def w2(spark, sf):
    return _series(
        spark, sf,
        lambda w: {f"mean_{n}": features.rolling_mean(w, "value", n, False) for n in MEAN_ROWS},
    )


@query("w3_rolling_stds", _select({
    f"std_{n}": f"CASE WHEN count(value) {_frame(n)} = {n} THEN stddev_samp(value) {_frame(n)} END"
    for n in STD_ROWS}))
def w3(spark, sf):
    return _series(
        spark, sf,
        lambda w: {f"std_{n}": features.rolling_std(w, "value", n, False) for n in STD_ROWS},
    )


@query("w4_changes", _select({f"change_{n}": f"value - {_lag('value', n)}" for n in CHANGE_ROWS}))
def w4(spark, sf):
    return _series(
        spark, sf, lambda w: {f"change_{n}": features.changed(w, "value", n, False) for n in CHANGE_ROWS}
    )


@query("w5_power_lag", f"""WITH {WIDE} SELECT event_time, round({TOTAL_POWER}, 6) AS {TOTAL_POWER},
  round({_lag(TOTAL_POWER, 6, '')}, 6) AS {TOTAL_POWER}_Lag_6,
  round({TOTAL_POWER} - {_lag(TOTAL_POWER, 6, '')}, 6) AS {TOTAL_POWER}_Change_6 FROM w""")
def w5(spark, sf):
    rows = wide_table(spark, sf).select("event_time", TOTAL_POWER)
    out = over_ordered(
        rows, [], ["event_time"], 6, lambda w: features.power_columns(w, TOTAL_POWER, False)
    )
    return rounded(out, *out.columns[1:])


@query("w6_moving_average", _select({"forecast": f"avg(value) {_frame(6)}"}))
def w6(spark, sf):
    out = baselines.moving_average(series(spark, sf), ["module"], columns=["value"])
    return rounded(out.withColumnRenamed("Predicted_value", "forecast"), "value", "forecast", digits=9)


@query("w8_serving_lags", _select({f"lag_{n}": f"coalesce({_lag('value', n)}, value)" for n in LAGS}))
def w8(spark, sf):
    return _series(
        spark, sf, lambda w: {f"lag_{n}": features.lagged(w, "value", n, True) for n in LAGS}
    )


@query("w9_serving_means", _select({f"mean_{n}": f"avg(value) {_frame(n)}" for n in MEAN_ROWS}))
def w9(spark, sf):
    return _series(
        spark, sf,
        lambda w: {f"mean_{n}": features.rolling_mean(w, "value", n, True) for n in MEAN_ROWS},
    )


@query("w10_serving_stds", _select({f"std_{n}": f"stddev_pop(value) {_frame(n)}" for n in [3, *STD_ROWS]}))
def w10(spark, sf):
    return _series(
        spark, sf,
        lambda w: {f"std_{n}": features.rolling_std(w, "value", n, True) for n in [3, *STD_ROWS]},
    )


@query("w11_serving_changes", _select({
    f"change_{n}": f"coalesce(value - {_lag('value', n)}, 0.0::DOUBLE)" for n in CHANGE_ROWS}))
def w11(spark, sf):
    return _series(
        spark, sf, lambda w: {f"change_{n}": features.changed(w, "value", n, True) for n in CHANGE_ROWS}
    )


def _feature_sql(serving: bool) -> dict[str, str]:
    """Every feature of the wide table as SQL, by name."""
    cells = {m: m for m in MODULES}

    def past(c, n):
        return f"coalesce({_lag(c, n, '')}, {c})" if serving else _lag(c, n, "")

    def step(c, n):
        sql = f"{c} - {_lag(c, n, '')}"
        return f"coalesce({sql}, 0.0::DOUBLE)" if serving else sql

    def full(c, n, sql):
        return sql if serving else f"CASE WHEN count({c}) {_frame(n, '')} = {n} THEN {sql} END"

    deviation = "stddev_pop" if serving else "stddev_samp"
    for m in MODULES:
        cells.update({f"{m}_Lag_{n}": past(m, n) for n in LAGS})
        cells.update({f"{m}_RollingMean_{n}": full(m, n, f"avg({m}) {_frame(n, '')}") for n in MEAN_ROWS})
        cells.update(
            {f"{m}_RollingStd_{n}": full(m, n, f"{deviation}({m}) {_frame(n, '')}") for n in STD_ROWS}
        )
        cells.update({f"{m}_Change_{n}": step(m, n) for n in CHANGE_ROWS})
    cells[TOTAL_POWER] = TOTAL_POWER
    cells[f"{TOTAL_POWER}_Lag_6"] = past(TOTAL_POWER, 6)
    cells[f"{TOTAL_POWER}_Change_6"] = step(TOTAL_POWER, 6)
    values = f"[{', '.join(MODULES)}]"
    cells["Module_Temp_Mean"] = f"list_avg({values})"
    cells["Module_Temp_STD"] = f"list_{deviation}({values})"
    cells["Module_Temp_Max"] = f"list_max({values})"
    cells["Module_Temp_Min"] = f"list_min({values})"
    cells["Hour"], cells["Minute"] = "hour(event_time)", "minute(event_time)"
    cells["Weekday"] = "isodow(event_time) - 1"
    cells["Is_Weekend"] = "(isodow(event_time) >= 6)::INT"
    return cells


def _feature_query(serving: bool) -> str:
    cells = _feature_sql(serving)
    return f"""WITH {WIDE} SELECT event_time,
      {', '.join(f'round(({cells[n]})::DOUBLE, 9) AS {n}' for n in feature_names())} FROM w"""


def _features(spark, sf, mode):
    out = features.add_features(wide_table(spark, sf), [], mode=mode)
    names = feature_names()
    return rounded(out.withColumns({n: F.col(n).cast("double") for n in names}), *names, digits=9)


@query("w14_feature_set", _feature_query(False))
def w14(spark, sf):
    return _features(spark, sf, "training")


@query("w14_feature_set_serving", _feature_query(True))
def w14_serving(spark, sf):
    return _features(spark, sf, "serving")


_SERIES = {
    **{f"value_Lag_{n}": _lag("value", n) for n in LAGS},
    **{f"value_RollingMean_{n}": f"CASE WHEN count(value) {_frame(n)} = {n} THEN avg(value) {_frame(n)} END" for n in MEAN_ROWS},
    **{f"value_RollingStd_{n}": f"CASE WHEN count(value) {_frame(n)} = {n} THEN stddev_samp(value) {_frame(n)} END" for n in STD_ROWS},
    **{f"value_Change_{n}": f"value - {_lag('value', n)}" for n in CHANGE_ROWS},
}


@query("w14_series_features", _select(_SERIES))
def w14_long(spark, sf):
    out = features.add_series_features(series(spark, sf), ["module"], "event_time", "value")
    return rounded(out, "value", *_SERIES, digits=9)


@query("a11_cross_state", f"""WITH {R} SELECT event_time, round(avg(value), 9) AS temp_mean,
  round(stddev_samp(value), 9) AS temp_std, round(max(value), 9) AS temp_max,
  round(min(value), 9) AS temp_min FROM r GROUP BY event_time""")
def a11(spark, sf):
    out = features.cross_state(hourly(spark, sf), ["event_time"]).drop("temp_std_serving")
    return rounded(out, "temp_mean", "temp_std", "temp_max", "temp_min", digits=9)


@query("a12_cross_state_serving", f"""WITH {R} SELECT event_time,
  round(stddev_pop(value), 6) AS temp_std_serving FROM r GROUP BY event_time""")
def a12(spark, sf):
    out = features.cross_state(hourly(spark, sf), ["event_time"])
    return rounded(out.select("event_time", "temp_std_serving"), "temp_std_serving")


@query("f1_time_parts", f"""WITH {TL} SELECT event_id, hour(event_time)::FLOAT AS Hour,
  minute(event_time)::FLOAT AS Minute, (isodow(event_time) - 1)::FLOAT AS Weekday,
  (isodow(event_time) >= 6)::INT::FLOAT AS Is_Weekend FROM tl""")
def f1(spark, sf):
    parts = S.time_parts(F.col("event_time"))
    return telemetry(spark, sf).select("event_id", *[c.alias(n) for n, c in parts.items()])


# Rows with a full 31-row history and a target, in the float32 of a stored model.
_SUPERVISED = f"""{WIDE}, j AS (SELECT a.*, {', '.join(f'b.{m} AS {t}' for m, t in zip(MODULES, TARGETS))}
  FROM w a JOIN w b ON a.event_time + INTERVAL 30 HOUR = b.event_time
  WHERE {' AND '.join(f'b.{m} IS NOT NULL' for m in MODULES)}),
  c AS (SELECT event_time, {', '.join(f'({sql})::DOUBLE AS {n}' for n, sql in _feature_sql(False).items())},
  {', '.join(TARGETS)} FROM j),
  x AS (SELECT * FROM c WHERE {' AND '.join(f'{n} IS NOT NULL' for n in [*feature_names(), *TARGETS])})"""
_SPLIT = f"""{_SUPERVISED}, n AS (SELECT count(*)::DOUBLE AS n FROM x),
  o AS (SELECT *, row_number() OVER (ORDER BY event_time) - 1 AS place FROM x),
  s AS (SELECT o.*, CASE WHEN place < floor(0.70::DOUBLE * n) THEN 'train'
    WHEN place < floor(0.85::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM o, n)"""
_SHOWN = ["Module_1_Avg_Temp_Lag_30", "Module_8_Avg_Temp_RollingStd_6", "Target_Module_3"]


@query("p13_complete_features", f"""WITH {_SUPERVISED} SELECT event_time,
  {', '.join(f'{n}::FLOAT AS {n}' for n in _SHOWN)} FROM x""")
def p13(spark, sf):
    return feature_table(wide(spark, sf), horizon_seconds=5 * STEP).select("event_time", *_SHOWN)


@query("t9_chronological_split", f"WITH {_SPLIT} SELECT event_time, split FROM s")
def t9(spark, sf):
    rows = feature_table(wide(spark, sf), horizon_seconds=5 * STEP)
    return split.chronological_split(rows).select("event_time", "split")


@query("t9_split_by_time", f"""WITH {TL}, o AS (SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS place,
    count(*) OVER ()::DOUBLE AS n FROM tl),
  cut AS (SELECT max(event_time) FILTER (WHERE place = floor(0.70::DOUBLE * n)) AS a,
    max(event_time) FILTER (WHERE place = floor(0.85::DOUBLE * n)) AS b FROM o)
  SELECT CASE WHEN event_time < a THEN 'train' WHEN event_time < b THEN 'validation' ELSE 'test' END AS split,
    count(*) AS rows, min(event_time) AS first_time, max(event_time) AS last_time FROM tl, cut GROUP BY 1""")
def t9_report(spark, sf):
    return split.split_report(split.chronological_split(telemetry(spark, sf)))


@query("u1_production_rows", f"WITH {_SPLIT} SELECT event_time, split FROM s WHERE split <> 'test'")
def u1(spark, sf):
    rows = split.chronological_split(feature_table(wide(spark, sf), horizon_seconds=5 * STEP))
    return split.production_rows(rows).select("event_time", "split")


@query("a19_missing_values", f"""WITH {R} SELECT
  (SELECT sum(least(n, 1) + least(n, 3) + least(n, 6) + least(n, 18) + least(n, 30))::BIGINT
    FROM (SELECT count(*) AS n FROM r GROUP BY module)) AS missing_features,
  (SELECT count(*) FILTER (WHERE b.value IS NULL) FROM r a LEFT JOIN r b
    ON a.module = b.module AND a.event_time + INTERVAL 5 HOUR = b.event_time) AS missing_targets""")
def a19(spark, sf):
    rows = series(spark, sf)
    lagged = over_ordered(
        rows, ["module"], ["event_time"], features.REACH,
        lambda w: {f"lag_{n}": features.lagged(w, "value", n, False) for n in LAGS},
    )
    target = add_future_targets(rows, ["module"], columns=["value"], seconds=HORIZON, names={"value": "target"})
    joined = lagged.join(target.select("module", "event_time", "target"), ["module", "event_time"], "left")
    return missing_values(joined, [f"lag_{n}" for n in LAGS], ["target"])


@query("p15_json_safe", f"""WITH {TL} SELECT event_id,
  CASE WHEN event_id % 5 <> 0 THEN value END AS value,
  CASE WHEN event_id % 2 = 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S')
    WHEN epoch_us(event_time) % 1000000 = 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END AS event_time FROM tl""")
def p15(spark, sf):
    rows = telemetry(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", "event_time"))
        .otherwise(F.col("event_time")).alias("event_time"),
    )
    return project.json_safe(rows)
