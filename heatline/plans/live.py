"""The scoring path on a batch of messages; streams run it per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.operators.ml import module_forecasts
from heatline.operators.risk import classify
from heatline.operators.validate import checked_records, rejection_events
from heatline.schema import MODULES, PREDICTIONS


def decisions(
    messages: DataFrame, features: list[str], forecast: Callable[[DataFrame], DataFrame],
    thresholds: DataFrame, modules: list[str] = MODULES,
) -> tuple[DataFrame, DataFrame]:
    """Messages to (prediction rows with risk, rejection events with partition and offset).

    ``forecast`` adds ``Predicted_<module>`` to a table of the feature columns. A module
    without thresholds has no prediction but a rejection (J5).
    """
    checked = checked_records(messages, features)
    good = checked.filter(F.col("reject_reason").isNull())
    bad = checked.filter(F.col("reject_reason").isNotNull())
    trace = [F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset")]
    keep = ["event_time", "replay_id", "kafka_partition", "kafka_offset", "_arrived"]
    inputs = good.select(
        "event_time", "replay_id", *trace, F.col("timestamp").alias("_arrived"), "payload.*"
    )
    rows = classify(module_forecasts(forecast(inputs), keep, modules), thresholds)
    known = F.col("warning_threshold").isNotNull() & F.col("critical_threshold").isNotNull()
    strange = rows.filter(~known).select(
        F.col("_arrived").alias("timestamp"),
        F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"),
        F.concat(F.lit("No threshold found for "), F.col("module")).alias("reject_reason"),
    )
    rejected = bad.select(*strange.columns).unionByName(strange)
    return rows.filter(known).select(*PREDICTIONS.names), rejection_events(rejected, trace)
