"""Reads over stored predictions, alerts and system events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators.asof import asof_nearest
from heatline.operators.project import active_alerts, of_module
from heatline.operators.scale import BROADCAST_ROWS, bounded_broadcast, same, stored
from heatline.schema import HORIZON_SECONDS, TOLERANCE_SECONDS

RECENT = ["event_time", "kafka_partition", "kafka_offset"]


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; rows without a first order column come last.

    The newest values come from a narrow hashed aggregate. Only rows that hold
    one are read whole, from times the scan can prune by; ties go by the rest of
    the order. With too many keys to broadcast it is one aggregate over all.
    """
    lead = order[0]
    edges = stored(df.groupBy(*keys).agg(F.max(lead).alias("_newest")))
    edges = edges.withColumnsRenamed({k: f"_e_{k}" for k in keys})
    rows = df
    found, unknown, oldest = edges.agg(
        F.count(F.lit(1)), F.count_if(F.col("_newest").isNull()), F.min("_newest")
    ).head()
    if found <= BROADCAST_ROWS:
        # A key whose rows all lack the time keeps them, so nothing can be pruned.
        recent = df if unknown or oldest is None else df.filter(F.col(lead) >= F.lit(oldest))
        edges = F.broadcast(edges)
        match = same(recent, edges, [(k, f"_e_{k}") for k in keys] + [(lead, "_newest")])
        rows = recent.join(edges, match, "left_semi")
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def latest_n(df: DataFrame, order: list[str], n: int = 50, most: int | None = None) -> DataFrame:
    """The newest ``n`` rows, newest first; at least one, and ``most`` if that is given."""
    n = max(1, n if most is None else min(n, most))
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def module_history(
    df: DataFrame, module: str, order: list[str], n: int = 100, most: int | None = None
) -> DataFrame:
    """The newest ``n`` rows of one module, oldest first."""
    return latest_n(of_module(df, module), order, n, most).orderBy(*order)


def oldest_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in time."""
    return df.orderBy(*order).limit(n)


def module_status(
    df: DataFrame, keys: list[str], order: list[str], newest: int | None = None
) -> DataFrame:
    """T5: the newest row per module, optionally seen only in the newest rows."""
    seen = latest_n(df, order, newest, None) if newest else df
    return latest_per_key(seen, keys, order)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Recoveries are stored as alerts and count in the total."""
    level = F.col("alert_level")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(level == "WARNING").alias("warning_alerts"),
        F.count_if(level == "CRITICAL").alias("critical_alerts"),
        F.count_if(level == "NORMAL").alias("recoveries"),
    )


def prediction_count(predictions: DataFrame) -> DataFrame:
    """A14."""
    return predictions.agg(F.count(F.lit(1)).alias("total_predictions"))


def summary(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row from two one-row aggregates."""
    counts = alert_summary(alerts).drop("recoveries")
    return prediction_count(predictions).crossJoin(F.broadcast(counts))


def active_counts(status: DataFrame) -> DataFrame:
    """A21."""
    risk = F.col("risk_level")
    return status.agg(
        F.count_if(risk.isin("WARNING", "CRITICAL")).alias("active"),
        F.count_if(risk == "WARNING").alias("warning"),
        F.count_if(risk == "CRITICAL").alias("critical"),
    )


def active_list(status: DataFrame) -> DataFrame:
    """Active modules, critical first, then by module number."""
    first = F.when(F.col("risk_level") == "CRITICAL", 0).otherwise(1)
    return active_alerts(status).orderBy(first, S.module_number(F.col("module")), "module")


def by_module_number(df: DataFrame) -> DataFrame:
    """T8."""
    return df.orderBy(S.module_number(F.col("module")), "module")


def scored_forecasts(
    predictions: DataFrame, horizon_seconds: float = HORIZON_SECONDS,
    tolerance_seconds: float = TOLERANCE_SECONDS, keys: list[str] = ["module"],
    order: list[str] = [], limit: int | None = None,
) -> DataFrame:
    """Each forecast with the reading near its target time, if there is one."""
    timed = predictions.filter(F.col("event_time").isNotNull())
    readings = timed.select(
        *keys, "event_time", S.known(F.col("current_temperature")).alias("current_temperature"),
        *[c for c in order if c not in (*keys, "event_time", "current_temperature")],
    )
    forecasts = timed.select(
        *keys, "event_time",
        S.shifted(F.col("event_time"), horizon_seconds).alias("target_time"),
        S.known(F.col("predicted_temperature")).alias("predicted_temperature"),
    )
    return asof_nearest(
        forecasts, readings, keys, "target_time", "event_time", "current_temperature",
        tolerance_seconds, order, limit,
    )


def forecast_performance(
    predictions: DataFrame, horizon_seconds: float = HORIZON_SECONDS,
    tolerance_seconds: float = TOLERANCE_SECONDS, oldest: int | None = None,
    order: list[str] = [], limit: int | None = None,
) -> DataFrame:
    """Evaluated, pending, MAE and RMSE by module and ``overall``.

    Of the pending ones, ``not_due`` have a target beyond their module's newest reading,
    and ``missed`` one that readings have passed. The overall row pools errors. ``oldest`` scores only the first rows in time.
    """
    if oldest:
        predictions = oldest_n(predictions, ["event_time"], oldest)
    scored = scored_forecasts(
        predictions, horizon_seconds, tolerance_seconds, ["module"], order, limit
    )
    forecast = F.col("predicted_temperature").isNotNull()
    error = F.col("matched_value") - F.col("predicted_temperature")
    pending = forecast & F.col("matched_value").isNull()
    reading = F.when(S.known(F.col("current_temperature")).isNotNull(), F.col("event_time"))
    newest = predictions.groupBy(F.col("module").alias("_module")).agg(F.max(reading).alias("_newest"))
    newest = bounded_broadcast(newest)
    scored = scored.join(newest, same(scored, newest, [("module", "_module")]), "left")
    early = F.col("_newest").isNull() | (F.col("target_time") > F.col("_newest"))
    counts = ("evaluated", "pending", "not_due", "missed")
    per_module = scored.groupBy("module").agg(
        F.count(error).alias("evaluated"),
        F.count_if(pending).alias("pending"),
        F.count_if(pending & early).alias("not_due"),
        F.count_if(pending & ~early).alias("missed"),
        F.sum(F.abs(error)).alias("_abs"),
        F.sum(error * error).alias("_sq"),
    )
    total = per_module.agg(
        F.lit("overall").alias("module"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.sum("_abs").alias("_abs"),
        F.sum("_sq").alias("_sq"),
    )
    n = F.nullif(F.col("evaluated"), F.lit(0))
    return per_module.unionByName(total).select(
        "module", "evaluated", "pending",
        (F.col("_abs") / n).alias("mae"), F.sqrt(F.col("_sq") / n).alias("rmse"),
        "not_due", "missed",
    )


def status_with_performance(status: DataFrame, performance: DataFrame) -> DataFrame:
    """Module status beside its scores; no scores count as zero rows."""
    scores = bounded_broadcast(performance.filter(F.col("module") != "overall"))
    counts = [c for c in ("evaluated", "pending", "not_due", "missed") if c in scores.columns]
    joined = status.join(scores, "module", "left").fillna(0, counts)
    return joined.withColumn("accuracy", S.accuracy_grade(F.col("mae")))


def new_records(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Records not stored yet, each (partition, offset, module) once.

    Records without a partition or offset cannot be told apart and all stay.
    """
    keys = ["kafka_partition", "kafka_offset", "module"]
    traced = F.col("kafka_partition").isNotNull() & F.col("kafka_offset").isNotNull()
    fresh = records.filter(traced).dropDuplicates(keys)
    if stored is not None:
        fresh = fresh.join(stored.select(*keys), keys, "left_anti")
    return fresh.select(*records.columns).unionByName(records.filter(~traced))
