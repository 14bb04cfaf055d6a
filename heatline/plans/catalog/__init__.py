"""Every operator as a query on the driver tables, with its SQL twin.

Telemetry is read out of the ``events`` table: a user id picks one of eight
modules, the event type stands for the probe channel. Rows with repeated times
come from ``lineitem``.
"""

from __future__ import annotations

from importlib import import_module

from heatline.plans.catalog.base import ORACLES, QUERIES

for _part in (
    "timeline", "features", "records", "risk", "monitor", "models", "sinks", "streams",
):
    import_module(f"heatline.plans.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
