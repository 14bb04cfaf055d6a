"""Risk transitions to alert and recovery events (W12, X5 in batch form, F6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatline.functions.scalars import fixed_text
from heatline.operators.scale import bounded_broadcast, over_ordered, same

ALERT, RECOVERY = "TEMPERATURE_ALERT", "TEMPERATURE_RECOVERY"


def risk_transitions(
    decisions: DataFrame, keys: list[str] = ["module"], order: list[str] = ["event_time"],
    initial: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """Add ``previous_risk``; the first is the restored one, or NORMAL.

    Rows without a risk (of unknown modules) change no state and are left out.
    """
    def build(w):
        return {"previous_risk": F.lag("risk_level").over(w)}

    decisions = decisions.filter(F.col("risk_level").isNotNull())
    rows = over_ordered(decisions, keys, order, 1, build, limit=limit)
    start = F.lit("NORMAL")
    if initial is not None:
        side = bounded_broadcast(
            initial.select(
                *[F.col(k).alias(f"_i_{k}") for k in keys], F.col("risk_level").alias("_start")
            )
        )
        rows = rows.join(side, same(rows, side, [(k, f"_i_{k}") for k in keys]), "left")
        start = F.coalesce(F.col("_start"), start)
    rows = rows.withColumn("previous_risk", F.coalesce("previous_risk", start))
    return rows.drop("_start", *[f"_i_{k}" for k in keys])


def event_type(previous: Column, current: Column) -> Column:
    """The event a change of risk raises, or NULL."""
    raised = (previous == "NORMAL") & current.isin("WARNING", "CRITICAL")
    raised = raised | ((previous == "WARNING") & (current == "CRITICAL"))
    recovered = (current == "NORMAL") & previous.isin("WARNING", "CRITICAL")
    return F.when(raised, ALERT).when(recovered, RECOVERY)


def event_message() -> Column:
    """F6."""
    def degrees(name: str) -> Column:
        return F.concat(fixed_text(F.col(name), 2), F.lit("°C"))

    level = F.col("risk_level")
    bound = F.when(level == "CRITICAL", degrees("critical_threshold")).otherwise(
        degrees("warning_threshold")
    )
    alert = F.concat(
        level, F.lit(" temperature risk detected in "), F.col("module"),
        F.lit(". 5-minute forecast: "), degrees("predicted_temperature"),
        F.lit(", "), F.lower(level), F.lit(" threshold: "), bound, F.lit("."),
    )
    recovery = F.concat(F.col("module"), F.lit(" returned to normal."))
    return F.when(F.col("event_type") == ALERT, alert).otherwise(recovery)


def as_events(changes: DataFrame) -> DataFrame:
    """Decisions with ``previous_risk`` to the events they raise."""
    typed = changes.withColumn(
        "event_type", event_type(F.col("previous_risk"), F.col("risk_level"))
    ).filter(F.col("event_type").isNotNull())
    return (
        typed.withColumn("message", event_message())
        .withColumnRenamed("risk_level", "severity")
        .drop("previous_risk")
    )


def alert_events(
    decisions: DataFrame, keys: list[str] = ["module"], order: list[str] = ["event_time"],
    initial: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """X5, batch: the alert and recovery events of a decision history."""
    return as_events(risk_transitions(decisions, keys, order, initial, limit))


def alert_records(events: DataFrame) -> DataFrame:
    """Events in the layout of the alert table."""
    return events.withColumnRenamed("severity", "alert_level").drop("temperature_delta")
