"""Names, column order and table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# Module names, feature windows and thresholds every table and
# saved model agrees on.
MODULES = [f"Module_{i}_Avg_Temp" for i in range(1, 9)]
TARGETS = [f"Target_Module_{i}" for i in range(1, 9)]
TOTAL_POWER = "Total_Power"
POWER_CHANNELS = ["Power Ch 1 (W)", "Power Ch 2 (W)", "Power Ch 3 (W)"]
PROBE_PREFIX = "Temperature mod {module} ch "
SOURCE_TIME = "Time [Date/Time]"
LAGS = [1, 3, 6, 18, 30]
MEAN_ROWS = [3, 6, 30]
STD_ROWS = [6, 30]
CHANGE_ROWS = [1, 3, 6, 30]
POWER_ROWS = 6
CADENCE_SECONDS = 10
HORIZON_SECONDS = 300
TOLERANCE_SECONDS = 30
WARNING_QUANTILE = 0.95
CRITICAL_QUANTILE = 0.99
RISE_TO_WARNING = 0.5
RISE_TO_CRITICAL = 1.0
NEAR_WARNING = 0.98
SCENARIOS = {"NORMAL": 0.0, "WARNING": 1.0, "CRITICAL": 3.0}
SCENARIO_MODULE = "Module_6_Avg_Temp"
SPLIT_FRACTIONS = (0.70, 0.85)
MOVING_AVERAGE_ROWS = 6


def feature_names(modules: list[str] = MODULES, power: str | None = TOTAL_POWER) -> list[str]:
    """The ordered model inputs: 131 names for eight modules and power."""
    names = list(modules)
    for suffix, sizes in (
        ("Lag", LAGS),
        ("RollingMean", MEAN_ROWS),
        ("RollingStd", STD_ROWS),
        ("Change", CHANGE_ROWS),
    ):
        names += [f"{m}_{suffix}_{n}" for n in sizes for m in modules]
    if power:
        names += [power, f"{power}_Lag_{POWER_ROWS}", f"{power}_Change_{POWER_ROWS}"]
    names += ["Module_Temp_Mean", "Module_Temp_STD", "Module_Temp_Max", "Module_Temp_Min"]
    return names + ["Hour", "Minute", "Weekday", "Is_Weekend"]


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def raw_telemetry(probes_per_module: dict[int, int]) -> T.StructType:
    """Raw CSV layout; the probe count of each module is site-specific."""
    probes = [
        (PROBE_PREFIX.format(module=m) + str(c), T.DoubleType())
        for m, count in probes_per_module.items()
        for c in range(1, count + 1)
    ]
    return _table(
        (SOURCE_TIME, T.StringType()),
        *[(name, T.DoubleType()) for name in POWER_CHANNELS],
        *probes,
    )


MODULE_TABLE = _table(
    ("event_time", T.TimestampType()),
    *[(m, T.DoubleType()) for m in MODULES],
    (TOTAL_POWER, T.DoubleType()),
)

# The Kafka source's columns, so a file stream can stand in for a topic.
ENVELOPE = _table(
    ("key", T.StringType()),
    ("value", T.StringType()),
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("offset", T.LongType()),
    ("timestamp", T.TimestampType()),
)

_RECORD = (
    ("event_time", T.TimestampType()),
    ("replay_id", T.LongType()),
    ("kafka_partition", T.IntegerType()),
    ("kafka_offset", T.LongType()),
    ("module", T.StringType()),
    ("current_temperature", T.DoubleType()),
    ("predicted_temperature", T.DoubleType()),
)
_LIMITS = (
    ("warning_threshold", T.DoubleType()),
    ("critical_threshold", T.DoubleType()),
)

PREDICTIONS = _table(
    *_RECORD, ("temperature_delta", T.DoubleType()), *_LIMITS, ("risk_level", T.StringType())
)
ALERTS = _table(
    *_RECORD,
    *_LIMITS,
    ("alert_level", T.StringType()),
    ("event_type", T.StringType()),
    ("message", T.StringType()),
)
SYSTEM_EVENTS = _table(
    ("event_time", T.TimestampType()),
    ("event_type", T.StringType()),
    ("status", T.StringType()),
    ("message", T.StringType()),
)
THRESHOLDS = _table(
    ("module", T.StringType()),
    ("warning", T.DoubleType()),
    ("critical", T.DoubleType()),
    ("source", T.StringType()),
)
