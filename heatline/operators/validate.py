"""Record, threshold and dataset rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.functions import scalars as S
from heatline.schema import HORIZON_SECONDS, MODULES, SOURCE_TIME

_SHOWN_BY_WORKER = 5
_SHOWN_BY_REQUEST = 20


def _parsed(
    df: DataFrame, value: str, required: list[str], extra: list[str] = []
) -> DataFrame:
    """Read a JSON object column as text fields and find its rule violations.

    A column for each feature's number and one verdict over all, the first that breaks a
    rule; built in steps, each used several times by the next, so that one record is
    parsed once. Its keys are read again only where some field came back empty.
    """
    layout = T.StructType(
        [T.StructField(n, T.StringType()) for n in dict.fromkeys([*required, *extra])]
    )
    names = F.array(*[F.lit(n) for n in required]).cast("array<string>")
    none = F.array().cast("array<string>")
    keys = F.map_keys(F.from_json(value, "map<string,string>"))
    parsed = df.withColumn("_fields", F.from_json(value, layout))
    texts = [F.col("_fields").getField(n) for n in required]
    numbers = [F.col(c) for c in _numbers(required)]
    broken = [
        F.when(n.isNull(), f"Feature {name} is not numeric").when(~S.is_finite(n), f"Feature {name} must be finite")
        for name, n in zip(required, numbers)
    ]
    return (
        parsed.withColumns(
            {
                **dict(zip(_numbers(required), map(S.text_to_double, texts))),
                "_empty": _any([t.isNull() for t in texts]),
            }
        )
        .withColumn("_keys", F.when(F.col("_empty"), keys))
        .withColumns(
            {
                "_is_object": ~F.col("_empty") | F.col("_keys").isNotNull(),
                "_missing": F.when(
                    F.col("_empty"), F.array_except(names, F.coalesce("_keys", none))
                ).otherwise(none),
                "_broken": F.coalesce(*broken, F.lit(None).cast("string")),
                "_not_numeric": _any([n.isNull() for n in numbers]),
            }
        )
    )


def _numbers(required: list[str]) -> list[str]:
    return [f"_n{i}" for i in range(len(required))]


def _any(tests: list[Column]) -> Column:
    return F.greatest(*tests, F.lit(False), F.lit(False))


def _payload(required: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(n) for c, n in zip(_numbers(required), required)])


def _once(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` and ``columns``, behind a generator no later filter is pushed through.

    Pushed down, a filter on the verdict would parse every record again.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))


def _shown(names: Column) -> Column:
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def checked_records(df: DataFrame, required: list[str], value: str = "value") -> DataFrame:
    """Add ``payload`` (numbers), ``replay_id``, event time and ``reject_reason``.

    ``reject_reason`` is NULL for a valid record. Needs the envelope's
    ``timestamp`` as the arrival time.
    """
    parsed = _parsed(df, value, required, [SOURCE_TIME, "timestamp", "_replay_id"])
    is_json = F.col("_is_object") | F.get_json_object(value, "$").isNotNull()
    reason = (
        F.when(~is_json, F.lit("Telemetry payload is not valid JSON"))
        .when(~F.col("_is_object"), F.lit("Telemetry payload must be a JSON object"))
        .when(
            F.size("_missing") > 0,
            F.concat(
                F.lit("Missing "),
                F.size("_missing"),
                F.lit(" model features: "),
                _shown(F.slice("_missing", 1, _SHOWN_BY_WORKER)),
            ),
        )
        .otherwise(F.col("_broken"))
    )
    field = F.col("_fields").getField
    timed = parsed.withColumn(
        "_time", S.parse_time(S.first_filled(field(SOURCE_TIME), field("timestamp")))
    )
    return _once(
        timed,
        {
            "payload": _payload(required),
            "replay_id": field("_replay_id").try_cast("long"),
            "event_time": F.coalesce("_time", "timestamp"),
            "time_source": F.when(F.col("_time").isNotNull(), "event").otherwise("ingest"),
            "reject_reason": reason,
        },
        df.columns,
    )


def split_valid(df: DataFrame, required: list[str], value: str = "value"):
    """(valid records, rejected records)."""
    checked = checked_records(df, required, value)
    return (
        checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.filter(F.col("reject_reason").isNotNull()).drop("payload"),
    )


def checked_requests(df: DataFrame, required: list[str], value: str = "value") -> DataFrame:
    """Status, message and the missing names of a scoring request: those shown, and all."""
    parsed = _parsed(df, value, required)
    gone, bad = F.size("_missing"), F.col("_broken").isNotNull()
    not_object = ~F.col("_is_object")
    return _once(
        parsed,
        {
            "payload": _payload(required),
            "status_code": F.when(not_object, 422).when(gone > 0, 400).when(bad, 422).otherwise(200),
            "detail": F.when(not_object, "Request must be a JSON object.")
            .when(gone > 0, "Missing required features")
            .when(F.col("_not_numeric"), "All model features must be numeric.")
            .when(bad, "All model features must be finite."),
            "missing_count": gone,
            "missing_features": F.slice("_missing", 1, _SHOWN_BY_REQUEST),
            "all_missing_features": F.col("_missing"),
        },
        df.columns,
    )


def rejection_events(rejected: DataFrame, keep: list[Column] = []) -> DataFrame:
    """Rejected records as system events, with any columns to ``keep``."""
    return rejected.select(
        F.col("timestamp").alias("event_time"),
        F.lit("TELEMETRY_REJECTED").alias("event_type"),
        F.lit("ERROR").alias("status"),
        F.concat_ws(
            "",
            F.lit("Rejected telemetry partition="),
            F.coalesce(F.col("partition").cast("string"), F.lit("None")),
            F.lit(" offset="),
            F.coalesce(F.col("offset").cast("string"), F.lit("None")),
            F.lit(": "),
            F.col("reject_reason"),
        ).alias("message"),
        *keep,
    )


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right"))
    )


def threshold_rows(raw: DataFrame) -> DataFrame:
    """P10: accept either pair of names; NULL ``problem`` marks a usable row."""
    def pick(*names: str) -> Column:
        found = [F.col(n).try_cast("double") for n in names if n in raw.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    rows = raw.select(
        "module",
        pick("warning", "Warning_95").alias("warning"),
        pick("critical", "Critical_99").alias("critical"),
        F.col("source") if "source" in raw.columns else F.lit(None).cast("string").alias("source"),
    )
    usable = F.col("warning") < F.col("critical")
    return rows.withColumn(
        "problem",
        F.when(
            ~F.coalesce(usable, F.lit(False)),
            F.concat(F.lit("Invalid warning/critical thresholds for "), F.col("module")),
        ),
    )


def check_thresholds(raw: DataFrame, modules: list[str] = MODULES) -> DataFrame:
    """The threshold table, or an error naming what is wrong."""
    rows = threshold_rows(raw)
    wanted = raw.sparkSession.createDataFrame([(m,) for m in modules], "module string")
    problem = rows.filter(F.col("problem").isNotNull()).select("problem").head()
    if problem:
        raise ValueError(problem[0])
    if not key_differences(rows, wanted, "module").isEmpty():
        raise ValueError(f"Threshold configuration must define exactly {len(modules)} modules")
    return rows.drop("problem")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """J7."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"Rows are not unique by {', '.join(keys)}")
    return df


def horizon_report(
    df: DataFrame, time: str = "event_time", target: str = "target_time",
    seconds: float = HORIZON_SECONDS,
) -> DataFrame:
    """rows and how far any target time lies from time + horizon."""
    off = F.abs(S.seconds_between(F.col(target), F.col(time)) - F.lit(float(seconds)))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(off).alias("max_difference_seconds"),
        F.count_if(off != 0).alias("wrong_rows"),
    )


def check_horizon(df: DataFrame, *names: str, seconds: float = HORIZON_SECONDS) -> DataFrame:
    """F3."""
    if horizon_report(df, *names, seconds=seconds).head()["wrong_rows"]:
        raise ValueError(f"Target time is not exactly {seconds} seconds after prediction time.")
    return df
