"""Driver-table adapters, in Spark and in SQL, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.operators.scale import written
from heatline.operators.risk import classify, fit_thresholds
from heatline.operators.timeline import resample_mean, resampled_modules
from heatline.schema import MODULES, TOTAL_POWER
from heatline.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = 3600
STEP = 6 * HOUR
HORIZON = 5 * HOUR
TOLERANCE = HOUR // 2

EVENTS = (
    "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
)
LINEITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp"
)


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a Spark query and, if SQL can say it, its twin."""
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")


def module_name(user_id: Column) -> Column:
    return F.concat(F.lit("Module_"), (user_id % 8 + 1).cast("string"), F.lit("_Avg_Temp"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long telemetry: one reading per event."""
    return events(spark, sf_dir).select(
        "event_id", module_name(F.col("user_id")).alias("module"),
        F.col("ts").alias("event_time"), F.col("event_type").alias("channel"), "value", "user_id",
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean per module."""
    return resample_mean(telemetry(spark, sf_dir), ["module"], "event_time", HOUR, ["value"])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly table written out, for queries that read it more than once."""
    return written(hourly(spark, sf_dir), "hourly")


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(wide(spark, sf_dir), "wide")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per six hours with all modules and a power column."""
    return resampled_modules(wide_rows(spark, sf_dir), [], "event_time", STEP)


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.select(
        "event_time",
        *[F.when(F.col("module") == m, F.col("value")).alias(m) for m in MODULES],
        F.col("user_id").cast("double").alias(TOTAL_POWER),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction history: the hourly value is forecast and reading at once."""
    rows = series(spark, sf_dir)
    hour = F.expr("cast(unix_micros(event_time) div 3600000000 as bigint)")
    number = F.substring("module", 8, 1).cast("int")
    forecast = rows.select(
        "event_time", hour.alias("replay_id"), (number % 3).alias("kafka_partition"),
        hour.alias("kafka_offset"), "module", F.col("value").alias("current_temperature"),
        F.col("value").alias("predicted_temperature"),
    )
    return classify(forecast, fit_thresholds(rows))


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a stored table, as monitoring reads find it."""
    return written(predictions(spark, sf_dir), "predictions")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums depend on row order in the last bits; results are compared rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


TL = """tl AS (SELECT event_id, 'Module_' || (user_id % 8 + 1) || '_Avg_Temp' AS module,
  ts AS event_time, event_type AS channel, value, user_id FROM events)"""
R = f"""{TL}, r AS (SELECT module, time_bucket(INTERVAL '1 hour', event_time) AS event_time,
  avg(value) AS value FROM tl GROUP BY ALL)"""
WIDE = f"""{TL}, w AS (SELECT * FROM (SELECT time_bucket(INTERVAL '6 hours', event_time) AS event_time,
  {', '.join(f"avg(value) FILTER (WHERE module = '{m}') AS {m}" for m in MODULES)},
  avg(user_id::DOUBLE) AS {TOTAL_POWER} FROM tl GROUP BY 1)
  WHERE coalesce({', '.join(MODULES)}) IS NOT NULL)"""
THRESHOLDS = f"""{R}, th AS (SELECT module, quantile_cont(value, 0.95::DOUBLE) AS warning,
  quantile_cont(value, 0.99::DOUBLE) AS critical FROM r GROUP BY module)"""


def risk_sql(predicted: str, delta: str, warning: str = "warning", critical: str = "critical") -> str:
    return f"""CASE WHEN {predicted} >= {critical} THEN 'CRITICAL'
    WHEN {predicted} >= {warning} THEN CASE WHEN {delta} >= 1.0::DOUBLE THEN 'CRITICAL' ELSE 'WARNING' END
    WHEN {delta} >= 0.5::DOUBLE AND {predicted} >= {warning} * 0.98::DOUBLE THEN 'WARNING'
    ELSE 'NORMAL' END"""


PREDICTED = f"""{THRESHOLDS}, p AS (SELECT event_time, (epoch(event_time) // 3600)::BIGINT AS replay_id,
  (substr(module, 8, 1)::INTEGER % 3)::INTEGER AS kafka_partition,
  (epoch(event_time) // 3600)::BIGINT AS kafka_offset, module, value AS current_temperature,
  value AS predicted_temperature, 0.0::DOUBLE AS temperature_delta, warning AS warning_threshold,
  critical AS critical_threshold, {risk_sql('value', '0.0::DOUBLE')} AS risk_level
  FROM r JOIN th USING (module))"""
CHANGES = f"""{PREDICTED}, ch AS (SELECT *, lag(risk_level, 1, 'NORMAL')
  OVER (PARTITION BY module ORDER BY event_time) AS previous_risk FROM p)"""
EVENTS_RAISED = f"""{CHANGES}, ev AS (SELECT * FROM (SELECT *,
  CASE WHEN previous_risk = 'NORMAL' AND risk_level <> 'NORMAL' THEN 'TEMPERATURE_ALERT'
       WHEN previous_risk = 'WARNING' AND risk_level = 'CRITICAL' THEN 'TEMPERATURE_ALERT'
       WHEN previous_risk <> 'NORMAL' AND risk_level = 'NORMAL' THEN 'TEMPERATURE_RECOVERY' END AS event_type,
  FROM ch) WHERE event_type IS NOT NULL)"""
MESSAGE = """CASE WHEN event_type = 'TEMPERATURE_RECOVERY' THEN module || ' returned to normal.'
  ELSE risk_level || ' temperature risk detected in ' || module || '. 5-minute forecast: '
  || format('{:.2f}', predicted_temperature) || '°C, ' || lower(risk_level) || ' threshold: '
  || format('{:.2f}', CASE risk_level WHEN 'CRITICAL' THEN critical_threshold ELSE warning_threshold END)
  || '°C.' END"""
