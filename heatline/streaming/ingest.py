"""Messages to stored predictions, alerts and rejections, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from heatline.operators.risk import ready_thresholds
from heatline.operators.scale import written
from heatline.plans.live import decisions
from heatline.schema import MODULES
from heatline.streaming.store import BatchStore


def scoring_stream(
    messages: DataFrame, features: list[str], forecast: Callable[[DataFrame], DataFrame],
    thresholds: DataFrame, root: str, checkpoint: str, modules: list[str] = MODULES,
) -> DataStreamWriter:
    """Validate, score, classify, raise alerts and store every micro-batch.

    The tables are a ``BatchStore`` at ``root``. A batch that fails is run again whole
    from the checkpoint; none of its rows were visible, and rows of an earlier delivery
    are left out. Modules without thresholds are quarantined as rejections.
    """
    levels = ready_thresholds(thresholds)
    store = BatchStore(messages.sparkSession, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, rejected = decisions(written(batch, "messages"), features, forecast, levels, modules)
        store.write(rows, rejected)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def deduplicated(
    df: DataFrame, delay: str = "10 minutes",
    keys: list[str] = ["kafka_partition", "kafka_offset", "module"],
    traced_by: list[str] = ["kafka_partition", "kafka_offset"],
) -> DataFrame:
    """Repeats of a key within the watermark delay dropped, across batches.

    As in the batch form, records without one of ``traced_by`` cannot be told apart and
    all stay.
    """
    df = df.withWatermark("event_time", delay)
    known = F.lit(True)
    for name in traced_by:
        known = known & F.col(name).isNotNull()
    return df.filter(known).dropDuplicatesWithinWatermark(keys).unionByName(df.filter(~known))
