"""Column checks, selections and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.functions import scalars as S
from heatline.schema import MODULES, PROBE_PREFIX, TARGETS, TOTAL_POWER


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """U4: required names the table lacks, in the order asked for."""
    return [name for name in required if name not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """P1."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))
    return df


def prepare_time(
    df: DataFrame, source: str, target: str = "event_time", on_invalid: str = "drop",
    formats: list[str] = S.TIME_FORMATS,
) -> DataFrame:
    """Parse a text clock; drop rows that have none, or fail on them."""
    time = F.col(source)
    if isinstance(df.schema[source].dataType, T.StringType):
        time = S.parse_time(time, formats)
    parsed = df.withColumn(target, time)
    if on_invalid == "fail":
        invalid = parsed.filter(F.col(target).isNull()).count()
        if invalid:
            raise ValueError(f"Found {invalid} invalid timestamps.")
        return parsed
    return parsed.filter(F.col(target).isNotNull())


def event_time(
    df: DataFrame, candidates: list[str], ingested: str, target: str = "event_time"
) -> DataFrame:
    """Source time if one parses, else arrival time; ``time_source`` says which."""
    source = S.parse_time(S.first_filled(*[F.col(c).cast("string") for c in candidates]))
    return df.withColumns(
        {
            target: F.coalesce(source, F.col(ingested)),
            "time_source": F.when(source.isNotNull(), "event").otherwise("ingest"),
        }
    )


def drop_targets(df: DataFrame) -> DataFrame:
    """P4."""
    return df.drop(*[c for c in df.columns if c in TARGETS])


def numeric_columns(df: DataFrame, without: list[str] = TARGETS) -> list[str]:
    """P5."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in without
    ]


def probe_columns(df: DataFrame, module: int) -> list[str]:
    """P6."""
    prefix = PROBE_PREFIX.format(module=module)
    found = [c for c in numeric_columns(df) if c.startswith(prefix)]
    if not found:
        raise ValueError(f"No temperature channels found for Module {module}")
    return found


def probes_long(df: DataFrame, ids: list[str], modules=range(1, 9)) -> DataFrame:
    """Wide probe columns to ``module, channel, value`` rows, in one pass."""
    columns = [c for m in modules for c in probe_columns(df, m)]
    return df.unpivot(ids, columns, "probe", "value").select(
        *ids,
        F.regexp_extract("probe", r"mod (\d+) ch", 1).cast("int").alias("module"),
        F.regexp_extract("probe", r"ch (\d+)", 1).cast("int").alias("channel"),
        S.known(F.col("value")).alias("value"),
    )


def target_names(columns: list[str]) -> dict[str, str]:
    """Module column to target column."""
    return {c: "Target_" + c.removesuffix("_Avg_Temp") for c in columns}


def with_all_targets(df: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """P8."""
    return df.dropna(how="any", subset=targets)


def with_any_module(df: DataFrame, modules: list[str] = MODULES) -> DataFrame:
    """P9."""
    return df.dropna(how="all", subset=modules)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every feature and target known."""
    return df.dropna(how="any", subset=columns)


def as_float32(df: DataFrame, columns: list[str]) -> DataFrame:
    """P14."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to NULL, times to ISO text, other non-JSON values to text."""
    safe = {}
    for field in df.schema:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            safe[field.name] = S.known(column)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            safe[field.name] = S.iso_text(column.cast("timestamp"))
        elif not isinstance(kind, (T.NumericType, T.StringType, T.BooleanType)):
            safe[field.name] = column.cast("string")
    return df.withColumns(safe)


def active_alerts(status: DataFrame) -> DataFrame:
    """P16."""
    return status.filter(F.col("risk_level").isin("WARNING", "CRITICAL"))


def of_module(df: DataFrame, module: str) -> DataFrame:
    """P17."""
    return df.filter(F.col("module") == module)


# History headings in display order.
HISTORY_HEADINGS = {
    "event_time": "Timestamp",
    "module": "Module",
    "event_type": "Event",
    "current_temperature": "Current °C",
    "predicted_temperature": "5-Min Forecast °C",
    "temperature_delta": "Delta °C",
    "warning_threshold": "Warning Threshold °C",
    "critical_threshold": "Critical Threshold °C",
}


def alert_history(events: DataFrame) -> DataFrame:
    """Either event layout under display headings, severity last."""
    shown = [F.col(c).alias(h) for c, h in HISTORY_HEADINGS.items() if c in events.columns]
    levels = [F.col(c) for c in ("severity", "alert_level") if c in events.columns]
    if levels:
        shown.append(F.coalesce(*levels).alias("Severity"))
    return events.select(*shown)


def joined_history(*layouts: DataFrame) -> DataFrame:
    """Events of different layouts in one table."""
    result = layouts[0]
    for other in layouts[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def replay_table(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Time, module temperatures and power only."""
    return df.select(time, *MODULES, TOTAL_POWER)
