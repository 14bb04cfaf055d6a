"""Query lifecycle as system events."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from heatline.schema import SYSTEM_EVENTS


class LifecycleListener(StreamingQueryListener):
    """Turns starts and ends of streaming queries into system events.

    ``sink`` gets a one-row table; ``append_records`` to the event table fits.
    """

    def __init__(self, spark: SparkSession, sink: Callable[[DataFrame], None]):
        self._spark, self._sink = spark, sink

    def _record(self, name: str | None, status: str, message: str) -> None:
        now = datetime.now(timezone.utc)
        row = (now, name or "TELEMETRY_STREAM", status, message)
        self._sink(self._spark.createDataFrame([row], SYSTEM_EVENTS))

    def onQueryStarted(self, event) -> None:
        self._record(event.name, "STARTED", f"Streaming query {event.id} started")

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._record(None, "ERROR", event.exception)
        else:
            self._record(None, "STOPPED", f"Streaming query {event.id} stopped")
